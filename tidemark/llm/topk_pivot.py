"""Exact top-k inner products by a pivot-distance index.

Vectors of whole numbers get one more coordinate, sqrt(M^2 - |v|^2) with M the largest norm (zero
for queries), which turns the largest inner product into the smallest distance. Every vector is
keyed by its nearest pivot and its distance r from it. A pivot's vectors are cut by r into annuli,
and those packed into chunks of bounded size.

Each query first takes a floor for its k-th score from the chunk that it lies in. For a pivot at
distance d from the query, the triangle inequality bounds the score of everything between r0 and
r1 from the pivot; a block of queries goes to a chunk only if some query's bound reaches its
floor. There the annuli are taken outwards from the queries' distance, floors rise with what is
found, and queries whose bound falls short stop. Nothing is approximate.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.aggregates import global_rank

from .common import discard, staged

TOP = 20
SCALE = 64
PIVOTS = 48
#: Vectors that the pivots are fitted on, at most: a range of hashes of the id.
PIVOT_SAMPLE = 20_000
#: Vectors of a chunk and of an annulus within it; chunks grow when there would be over MAX_CHUNKS of them.
CHUNK, ANNULUS, MAX_CHUNKS = 4096, 512, 8192
QUERY_BLOCK, BLOCKS_PER_TASK = 256, 32
#: From this norm on, a score need not fit in 64 bits.
LARGEST_NORM = float(2**31)


def whole_numbers(table: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(row, id, v array<long>) of every row: its number in the order of id and vector, and floor(scale * x).

    Ids or vectors that are null, empty or hold null or non-finite components are left out, and so
    are vectors whose scaled norm is LARGEST_NORM or more.
    """
    x = F.col("x")
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("x"))
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    norm = F.aggregate(F.transform(x, lambda c: F.floor(c * scale).cast("double")), F.lit(0.0), lambda a, c: a + c * c)
    rows = rows.where(F.col("id").isNotNull() & (F.size(x) > 0) & fine).where(norm < LARGEST_NORM**2)
    return global_rank(rows.select("id", F.transform(x, lambda c: F.floor(c * scale)).alias("v")), ["id", "v"], "row")


def fit_pivots(sample: np.ndarray, count: int, rounds: int = 8) -> np.ndarray:
    """Centres of a few rounds of k-means over a sample, from a fixed seed."""
    rng = np.random.default_rng(11)
    pivots = sample[rng.choice(len(sample), min(count, len(sample)), replace=False)]
    for _ in range(rounds):
        near = distances(sample, pivots).argmin(1)
        sums = np.zeros_like(pivots)
        np.add.at(sums, near, sample)
        n = np.bincount(near, minlength=len(pivots))
        pivots = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], pivots)
    return pivots


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (pivots * pivots).sum(1) - 2 * x @ pivots.T, 0))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of whole numbers as rows, zero-filled to a width."""
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = column.flatten().to_numpy()
    return out


def products(queries: np.ndarray, vectors: np.ndarray, exact_floats: bool) -> np.ndarray:
    return np.rint(queries.astype(float) @ vectors.astype(float).T).astype(np.int64) if exact_floats else queries @ vectors.T


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of each row's k best scores, ties to smaller ids."""
    order = np.lexsort((np.broadcast_to(ids, scores.shape), ~scores), axis=1)  # ~ as the smallest has no negative and would come first
    return order[:, :k]


class Geometry:
    """What every task needs: pivots, the largest squared norm and the width. Bounded by the pivot count."""

    def __init__(self, pivots: np.ndarray, top: int, width: int) -> None:
        self.pivots, self.top, self.width = pivots, top, width
        self.exact_floats = top < 1 << 52

    def lift(self, v: np.ndarray) -> np.ndarray:
        f = v.astype(float)
        return np.column_stack((f, np.sqrt(np.maximum(self.top - (f * f).sum(1), 0))))

    def of_queries(self, v: np.ndarray) -> np.ndarray:
        return distances(np.column_stack((v.astype(float), np.zeros(len(v)))), self.pivots)

    def ceiling(self, norms: np.ndarray, d: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """No score between low and high from a pivot at distance d exceeds this; rounding errors are allowed for."""
        slack = 1e-6 * (1 + math.sqrt(self.top))
        gap = np.maximum(np.maximum(d - high, low - d) - slack, 0)
        return (norms + self.top - gap * gap) / 2 + 1e-9 * (1 + self.top) + 0.5


def search_chunk(geometry: Geometry, queries: dict, ids: np.ndarray, vectors: np.ndarray, r: np.ndarray, pivot: int, k: int):
    """(query place, id, score) of all vectors of a chunk, sorted by r, that may be among a query's k best."""
    floor = queries["floor"].copy()
    d, norms = queries["d"][:, pivot], queries["norm"]
    edges = list(range(0, len(ids), ANNULUS))
    middle = float(np.median(d)) if len(d) else 0.0
    held = [np.zeros((len(d), 0), np.int64), np.zeros((len(d), 0), np.int64)]
    none = np.iinfo(np.int64).min
    for a in sorted(edges, key=lambda a: abs(float(r[min(a + ANNULUS // 2, len(r) - 1)]) - middle)):
        b = min(a + ANNULUS, len(ids))
        live = np.flatnonzero(geometry.ceiling(norms, d, r[a], r[b - 1]) >= floor)
        if not len(live):
            continue
        scores = products(queries["v"][live], vectors[a:b], geometry.exact_floats)
        own = ids[a:b] == queries["id"][live][:, None]
        scores[own] = none
        new_s, new_i = np.full((len(d), b - a), none), np.broadcast_to(ids[a:b], (len(d), b - a))
        new_s[live] = scores
        s, i = np.concatenate((held[0], new_s), 1), np.concatenate((held[1], new_i), 1)
        at = best(s, i, k)
        held = [np.take_along_axis(s, at, 1), np.take_along_axis(i, at, 1)]
        if held[0].shape[1] == k:
            floor = np.maximum(floor, held[0][:, -1])
    s, i = held
    row, column = np.nonzero((s > none) & (s >= queries["floor"][:, None]))
    return row, i[row, column], s[row, column]


def top_k(table: DataFrame, queries: "F.Column", id_col: str = "vec_id", vector_col: str = "embedding", k: int = TOP, scale: int = SCALE, pivots: int = PIVOTS) -> DataFrame:
    """(query_id, rank, id_col, score): each query's k best rows other than its own, by inner product of floor(scale * x).

    queries is a condition on id_col. Ties go to smaller ids; a query gets fewer rows if there are
    fewer others. Vectors that are null, empty, or hold null or non-finite components take no part,
    nor do null ids, nor vectors whose scaled norm is 2^31 or more, as their scores need not fit in
    64 bits. Rows that repeat an id stay apart: each is a query and a candidate of its own, and its
    copies are among its other rows. Shorter vectors count as filled with zeros. An empty table gives
    none. Only the two columns named are read.
    """
    spark = table.sparkSession
    numbered = whole_numbers(table, id_col, vector_col, scale)
    rows = staged(numbered.withColumn("is_query", queries_on(queries, id_col)), "vectors")
    square = F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x * x)
    whole = rows.agg(F.count("*").alias("n"), F.max(square).alias("top"), F.max(F.size("v")).alias("width"), F.count_if("is_query").alias("asking")).first()
    n, width = whole.n, whole.width or 1
    # a share of all hashes that holds about half of the bound; any sample gives the same results
    few = F.pmod(F.xxhash64("row"), F.lit(1 << 30)) < (1 << 30) * min(1.0, PIVOT_SAMPLE / 2 / max(n, 1))
    sample = rows.where(few).select("v").limit(PIVOT_SAMPLE).toArrow().column("v").combine_chunks() if n else None
    geometry = Geometry(np.zeros((1, width + 1)), whole.top or 0, width)
    if n:
        sample = sample if isinstance(sample, pa.Array) else sample.chunk(0)
        geometry.pivots = fit_pivots(geometry.lift(_matrix(sample, width)), pivots)
    shared = spark.sparkContext.broadcast(geometry)

    def key(batches):
        g = shared.value
        for batch in batches:
            if batch.num_rows:
                d = distances(g.lift(_matrix(batch.column("v"), g.width)), g.pivots)
                near = d.argmin(1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(near)), near])], [*batch.schema.names, "pivot", "r"])

    keyed = staged(rows.mapInArrow(key, "id long, v array<long>, row long, is_query boolean, pivot int, r double"), "keyed")
    # annuli of equal width per pivot, as many over all as the driver's summary may have; one that holds more
    # than a chunk is dealt over several, so that no chunk grows with the table
    chunk = max(CHUNK, -(-n // MAX_CHUNKS))
    cells = keyed.groupBy("pivot").agg(F.count("*").alias("m"), F.min("r").alias("r0"), F.max("r").alias("r1"))
    ring = F.when(F.col("r1") > F.col("r0"), F.least(F.floor((F.col("r") - F.col("r0")) / (F.col("r1") - F.col("r0")) * F.ceil(F.col("m") / chunk)), F.ceil(F.col("m") / chunk) - 1)).otherwise(0).cast("int")
    ringed = keyed.join(F.broadcast(cells), "pivot").withColumn("ring", ring).drop("m", "r0", "r1")  # a row for each pivot
    sizes = ringed.groupBy("pivot", "ring").agg(F.count("*").alias("m"))
    chunked = ringed.join(sizes, ["pivot", "ring"]).withColumn("part", F.pmod(F.xxhash64("row"), F.ceil(F.col("m") / CHUNK)).cast("int")).drop("m")

    def pack(key, table):
        g = shared.value
        table = table.sort_by([("r", "ascending"), ("row", "ascending")]).combine_chunks()
        ids, names, r = (table.column(c).to_numpy() for c in ("row", "id", "r"))
        v = _matrix(table.column("v").chunk(0), g.width)
        pivot, ask = table.column("pivot")[0].as_py(), table.column("is_query").to_numpy()
        ring, name = (int(uuid.uuid5(uuid.NAMESPACE_OID, "-".join(str(x) for x in part)).int & (1 << 62) - 1) for part in (key[:2], key))
        q = {"id": ids[ask], "v": v[ask], "norm": (v[ask].astype(float) ** 2).sum(1), "d": g.of_queries(v[ask]), "floor": np.full(int(ask.sum()), np.iinfo(np.int64).min)}
        floors = np.full(len(ids), np.iinfo(np.int64).min)
        if len(q["id"]) and len(ids) > k:
            row, _, s = search_chunk(g, q, ids, v, r, pivot, k)
            by = np.lexsort((s, row))
            row, s = row[by], s[by]
            first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
            full = np.diff(np.append(first, len(row))) >= k
            floors[np.flatnonzero(ask)[row[first[full]]]] = s[first[full]]
        return pa.table({"annulus": pa.array([ring], pa.int64()), "chunk": pa.array([name], pa.int64()), "pivot": pa.array([pivot], pa.int32()), "low": pa.array([r[0]]), "high": pa.array([r[-1]]), "ids": pa.array([ids]), "names": pa.array([names]), "r": pa.array([r]), "v": pa.array([v.astype("<i8").tobytes()], pa.binary()), "is_query": pa.array([ask.tolist()]), "floors": pa.array([floors])})

    schema = "annulus long, chunk long, pivot int, low double, high double, ids array<long>, names array<long>, r array<double>, v binary, is_query array<boolean>, floors array<long>"
    chunks = staged(chunked.groupBy("pivot", "ring", "part").applyInArrow(pack, schema), "chunks")
    discard(numbered, rows, keyed)
    # a row for each annulus, at most MAX_CHUNKS + PIVOTS
    summary = chunks.groupBy("annulus", "pivot").agg(F.min("low").alias("low"), F.max("high").alias("high")).toPandas().sort_values("annulus")
    bounds = spark.sparkContext.broadcast(tuple(summary[c].to_numpy() for c in ("annulus", "pivot", "low", "high")))

    # a chunk is sent once for each group of about BLOCKS_PER_TASK full blocks of queries
    groups = -(-whole.asking // (QUERY_BLOCK * BLOCKS_PER_TASK)) or 1

    def ask(batches):
        """Blocks of a chunk's queries, each with the annuli that its bounds don't rule out."""
        g = shared.value
        names, at, low, high = bounds.value
        for batch in batches:
            for row in batch.to_pylist():
                v = np.frombuffer(row["v"], "<i8").reshape(len(row["ids"]), -1)
                places = np.flatnonzero(np.array(row["is_query"], bool))
                for i in range(0, len(places), QUERY_BLOCK):
                    own = places[i : i + QUERY_BLOCK]
                    d, norms, floors = g.of_queries(v[own]), (v[own].astype(float) ** 2).sum(1), np.array(row["floors"])[own]
                    open_ = (g.ceiling(norms[:, None], d[:, at], low, high) >= floors[:, None]).any(0)
                    group = pa.array(names[open_])
                    m = len(group)
                    blob = np.column_stack((np.array(row["ids"])[own], np.array(row["names"])[own], floors, v[own])).astype("<i8").tobytes()
                    task = (row["chunk"] + i) % groups
                    yield pa.RecordBatch.from_arrays([group, pa.array([task] * m, pa.int32()), pa.array([blob] * m, pa.binary())], ["annulus", "task", "queries"])

    open_ = chunks.select("chunk", "ids", "names", "v", "is_query", "floors").mapInArrow(ask, "annulus long, task int, queries binary")
    asked = staged(open_.join(chunks.select("annulus", "chunk"), "annulus").drop("annulus"), "asked")
    tasks = asked.select("chunk", "task").distinct().join(chunks.select("chunk", "pivot", "ids", "names", "r", "v"), "chunk").toDF("of", "turn", "pivot", "ids", "names", "r", "v")

    def answer(key, left, right):
        g = shared.value
        out = [np.zeros((0, 5), np.int64)]
        if left.num_rows and right.num_rows:
            row = right.slice(0, 1).to_pylist()[0]
            ids, names, r = (np.array(row[c]) for c in ("ids", "names", "r"))
            v = np.frombuffer(row["v"], "<i8").reshape(len(ids), -1)
            order = np.argsort(ids)
            for blob in left.column("queries").to_pylist():
                own = np.frombuffer(blob, "<i8").reshape(-1, g.width + 3)
                q = {"id": own[:, 0], "floor": own[:, 2], "v": own[:, 3:], "norm": (own[:, 3:].astype(float) ** 2).sum(1), "d": g.of_queries(own[:, 3:])}
                place, i, s = search_chunk(g, q, ids, v, r, row["pivot"], k)
                out.append(np.column_stack((own[place, :2], i, names[order[np.searchsorted(ids[order], i)]], s)))
        return pa.table(list(np.concatenate(out).T.copy()), ["query", "query_id", "row", "id", "score"])

    found = asked.groupBy("chunk", "task").cogroup(tasks.groupBy("of", "turn")).applyInArrow(answer, "query long, query_id long, row long, id long, score long")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "row")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(id_col), "score")


def queries_on(condition: "F.Column", id_col: str) -> "F.Column":
    return F.coalesce(condition(F.col("id")) if callable(condition) else condition, F.lit(False))
