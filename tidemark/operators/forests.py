"""Tree models of which only summaries of bounded size leave the tasks: isolation forests and boosted trees."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.models import feature_columns
from tidemark.storage import discard, written

#: A bin of features that are null or NaN, and how many bins others have at most.
MISSING, MAX_BINS = 255, 255
#: Bags are bits of one number.
MAX_BAGS = 62
HASHES = 1 << 30


def share_of(*parts: Column) -> Column:
    """A number in [0, 1) that a digest of the parts draws: the same on every run and machine."""
    return F.pmod(F.xxhash64(*parts), F.lit(HASHES)) / HASHES


# --- isolation forest


def expected_path(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search among n values."""
    n = np.asarray(n, float)
    m = np.maximum(n, 2.0)
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, 2 * (np.log(m - 1) + np.euler_gamma) - 2 * (m - 1) / m))


def grow_isolation_tree(x: np.ndarray, rng: np.random.Generator, limit: int) -> tuple[np.ndarray, ...]:
    """(feature, split, left, right, length) of each node: a random feature that varies and a random split between its ends, down to one row or the limit.

    Nodes come in preorder, left before right. Leaves have feature -1 and the length of a path that
    ends there; rows with x <= split go left.
    """
    nodes: list[list[float]] = []
    todo = [(np.arange(len(x)), 0, -1, 0)]
    while todo:
        rows, depth, parent, side = todo.pop()
        at = len(nodes)
        if parent >= 0:
            nodes[parent][2 + side] = at
        own = x[rows]
        low, high = (own.min(0), own.max(0)) if len(rows) else (np.zeros(x.shape[1]),) * 2
        varied = np.flatnonzero(high > low)
        if len(rows) <= 1 or depth >= limit or not len(varied):
            nodes.append([-1, 0.0, at, at, depth + float(expected_path(len(rows)))])
            continue
        f = int(varied[rng.integers(len(varied))])
        split = float(rng.uniform(low[f], high[f]))
        nodes.append([f, split, -1, -1, 0.0])
        goes = own[:, f] <= split
        todo += [(rows[~goes], depth + 1, at, 1), (rows[goes], depth + 1, at, 0)]
    table = np.array(nodes)
    return table[:, 0].astype(np.int32), table[:, 1], table[:, 2].astype(np.int32), table[:, 3].astype(np.int32), table[:, 4]


def path_lengths(x: np.ndarray, tree: Sequence[np.ndarray], limit: int) -> np.ndarray:
    """The length of every row's path, all rows a step at a time."""
    feature, split, left, right, length = tree
    at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
    for _ in range(limit):
        f = feature[at]
        at = np.where(x[rows, np.maximum(f, 0)] <= split[at], left[at], right[at])  # leaves lead to themselves
    return length[at]


def isolation_scores(train: DataFrame, score: DataFrame, features: Sequence[str], row_id: Sequence[str], trees: int = 100, sample: int = 256, seed: int = 0, name: str = "anomaly") -> DataFrame:
    """score with a column in (0, 1]: the higher, the sooner random splits fitted on train set a row apart.

    A tree sees `sample` rows, drawn by a digest from a pool of trees * sample rows that a digest
    draws from train: row_id tells rows apart, and the same rows are drawn on every run. The pool, and
    what is broadcast, a tree for every draw, are bounded by the parameters, whatever the tables
    hold. Nulls and NaN count as the exact medians of train. Without training rows every score is 0.5.
    """
    names, pool_size = feature_columns(features), trees * sample
    clean = [F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in names]
    middle = train.agg(*(F.median(c).alias(f"m{i}") for i, c in enumerate(clean))).first()
    filled = [F.coalesce(c, F.lit(0.0 if middle[i] is None else float(middle[i]))) for i, c in enumerate(clean)]
    held = train.select(*(c.alias(f"x{i}") for i, c in enumerate(filled)), F.struct(*(F.col(c) for c in row_id)).alias("key"))
    n = train.count()
    near = share_of(F.lit(seed), "key") < min(1.0, 2 * pool_size / max(n, 1))
    pool = written(held.where(near).orderBy(F.xxhash64(F.lit(seed), "key"), "key").limit(pool_size), "pool")
    drawn = pool.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).withColumn("h", F.xxhash64(F.lit(seed), "tree", "key"))
    ranked = drawn.withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy("h", "key"))).where(F.col("rank") <= sample)
    size = min(sample, pool.count())
    limit = math.ceil(math.log2(max(size, 2)))

    def grow(key, table):
        table = table.sort_by("rank")
        x = np.column_stack([table.column(f"x{i}").to_numpy() for i in range(len(names))])
        made = grow_isolation_tree(x, np.random.default_rng([seed, key[0].as_py()]), limit)
        return pa.table({"tree": pa.array([key[0].as_py()], pa.int32()), **{c: [v.tolist()] for c, v in zip(columns, made)}}, schema=schema)

    columns = ("feature", "split", "left", "right", "length")
    kinds = ("int", "double", "int", "int", "double")
    schema = pa.schema([("tree", pa.int32()), *((c, pa.list_({"int": pa.int32(), "double": pa.float64()}[k])) for c, k in zip(columns, kinds))])
    grown = ranked.groupBy("tree").applyInArrow(grow, "tree int, " + ", ".join(f"{c} array<{k}>" for c, k in zip(columns, kinds))).orderBy("tree").collect()
    discard(pool)
    forest = score.sparkSession.sparkContext.broadcast([tuple(np.array(r[c], np.int32 if k == "int" else float) for c, k in zip(columns, kinds)) for r in grown])
    per_path = float(expected_path(size)) or 1.0

    @F.pandas_udf("double")
    def anomaly(*values: pd.Series) -> pd.Series:
        x = np.column_stack([v.to_numpy(float) for v in values])
        total = sum((path_lengths(x, t, limit) for t in forest.value), np.zeros(len(x)))
        return pd.Series(2.0 ** (-total / max(len(forest.value), 1) / per_path) if forest.value else np.full(len(x), 0.5))

    return score.withColumn(name, anomaly(*filled))


# --- gradient boosting


class Boosting:
    """Boosted trees of several bags over binned features.

    A tree is arrays over a heap of nodes: feature (-1: a leaf), the last bin that goes left,
    whether missing values do, and the value of a leaf.
    """

    def __init__(self, features: list[str], edges: list[np.ndarray], base: list[float], depth: int) -> None:
        self.features, self.edges, self.depth = features, edges, depth
        self.base, self.trees = base, [[] for _ in base]  # of each bag

    def bins(self, columns: Sequence[np.ndarray]) -> np.ndarray:
        out = np.full((len(columns[0]), len(columns)), MISSING, np.uint8)
        for f, (x, edges) in enumerate(zip(columns, self.edges)):
            known = ~np.isnan(x)
            out[known, f] = np.searchsorted(edges, x[known])  # x <= edges[k] exactly if its bin is k or lower
        return out

    def margins(self, bins: np.ndarray, start: int = 0, held: np.ndarray | None = None) -> np.ndarray:
        """Log odds of every row by every bag: `held` has those of the first `start` trees."""
        out = np.tile(self.base, (len(bins), 1)) if held is None else held.copy()
        for b, trees in enumerate(self.trees):
            for tree in trees[start:]:
                out[:, b] += tree["value"][leaves(bins, tree, self.depth)]
        return out


def leaves(bins: np.ndarray, tree: dict, depth: int) -> np.ndarray:
    """The node that every row ends on."""
    at, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
    for _ in range(depth):
        f = tree["feature"][at]
        own = bins[rows, np.maximum(f, 0)]
        left = np.where(own == MISSING, tree["missing_left"][at], own <= tree["last"][at])
        at = np.where(f >= 0, 2 * at + 2 - left, at)
    return at


def best_split(g: np.ndarray, h: np.ndarray, n: np.ndarray, allowed: np.ndarray, l2: float, least: int) -> tuple | None:
    """(gain, feature, last bin on the left, missing left) from sums (feature, bin) of gradients, hessians and rows; ties to the first."""
    best = None
    for f in np.flatnonzero(allowed):
        known, lost = slice(0, MISSING), MISSING
        sums = [np.cumsum(a[f, known]) for a in (g, h, n)]
        whole = [float(a[f].sum()) for a in (g, h, n)]
        for missing_left in (True, False) if n[f, lost] else (False,):
            gl, hl, nl = (s + (a[f, lost] if missing_left else 0.0) for s, a in zip(sums, (g, h, n)))
            gr, hr, nr = (w - s for w, s in zip(whole, (gl, hl, nl)))
            gain = np.where((nl >= least) & (nr >= least), gl * gl / (hl + l2) + gr * gr / (hr + l2) - whole[0] ** 2 / (whole[1] + l2), -np.inf)
            k = int(np.argmax(np.round(gain, 9)))
            if gain[k] > 1e-9 and (best is None or gain[k] > best[0] + 1e-9):
                best = float(gain[k]), int(f), k, missing_left
    return best


def in_bags(label: Column, keys: Sequence[Column], shares: Sequence[float], seed: int) -> Column:
    """The bags that a row is in, a bit for each: positives in all, others by their digest."""
    bit = lambda b, share: F.when((label == 1) | (share_of(F.lit(seed), F.lit(b), *keys) < share), F.lit(1 << b)).otherwise(0)
    return sum((bit(b, s) for b, s in enumerate(shares)), F.lit(0)).cast("long")


def fit_boosting(
    train: DataFrame, features: Sequence[str], label: str, row_id: Sequence[str], bags: int = 1, ratio: float | None = None, trees: int = 100, depth: int = 2, rate: float = 0.1,
    bins: int = 64, l2: float = 1.0, least: int = 10, subsample: float = 1.0, columns: float = 1.0, seed: int = 0, rewrite: int = 10,
) -> tuple[Boosting, Column]:
    """Boosted trees by log loss, and the column of bags that each row of train is in.

    With `ratio`, every bag holds all positive rows and about ratio times as many others, which a
    digest of row_id draws: bagging of unlabelled rows. All bags grow together: a level of trees is one
    pass in which tasks sum gradients by bag, node, feature and bin, and only those sums reach the
    driver, at most bags * 2^depth * features * 256. Bins are quantiles of train, made once; nulls
    and NaN have a bin of their own, that a split sends to the better side. Rows keep their bins and
    log odds in a table written every `rewrite` trees. Rows without a label are left out. A tree may
    see a share `subsample` of rows and `columns` of features.
    """
    names = feature_columns(features)
    if not 1 <= bags <= MAX_BAGS:
        raise ValueError(f"1 to {MAX_BAGS} bags")
    rows = train.where(F.col(label).isNotNull())
    keys, y = [F.col(c) for c in row_id], F.col(label).cast("int")
    clean = {c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in names}
    shares = [i / bins for i in range(1, bins)][: MAX_BINS - 1]
    whole = rows.agg(F.count("*").alias("n"), F.count_if(y == 1).alias("p"), *(F.percentile_approx(v, shares, 10_000).alias(f"q{i}") for i, v in enumerate(clean.values()))).first()
    positive, other = whole.p, whole.n - whole.p
    share = 1.0 if ratio is None else min(1.0, ratio * positive / max(other, 1))
    mask = in_bags(y, keys, [share] * bags, seed)
    base = math.log(max(positive, 0.5) / max(other * share, 0.5))
    model = Boosting(names, [np.unique(np.array(whole[f"q{i}"] or [], float)) for i in range(len(names))], [base] * bags, depth)

    def binned(batches):
        for batch in batches:
            if batch.num_rows:
                b = model.bins([batch.column(f"x{i}").to_numpy(zero_copy_only=False).astype(float) for i in range(len(names))])
                width = pa.array(np.arange(len(b) + 1) * b.shape[1], pa.int32())
                m = pa.array(np.tile(model.base, len(b)))
                yield pa.RecordBatch.from_arrays([batch.column("y"), batch.column("mask"), batch.column("draw"), pa.Array.from_buffers(pa.binary(), len(b), [None, width.buffers()[1], pa.py_buffer(b.tobytes())]), pa.ListArray.from_arrays(pa.array(np.arange(len(b) + 1) * bags, pa.int32()), m)], schema.names)

    schema = pa.schema([("y", pa.int32()), ("mask", pa.int64()), ("draw", pa.int64()), ("bins", pa.binary()), ("margins", pa.list_(pa.float64()))])
    ddl = "y int, mask long, draw long, bins binary, margins array<double>"
    state = written(rows.select(y.alias("y"), mask.alias("mask"), F.xxhash64(F.lit(seed + 1), *keys).alias("draw"), *(v.alias(f"x{i}") for i, v in enumerate(clean.values()))).mapInArrow(binned, ddl), "boosting")

    def parts(batch):
        b = np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
        return batch.column("y").to_numpy(), batch.column("mask").to_numpy(), batch.column("draw").to_numpy(), b, batch.column("margins").flatten().to_numpy().reshape(batch.num_rows, -1)

    def level_sums(start, turn, level, growing):
        """Tasks' sums of a level of the trees that grow: (bag, node, feature, bin, g, h, n)."""
        first = 2**level - 1

        def run(batches):
            sums = np.zeros((bags, 2**level, len(names), MISSING + 1, 3))
            for batch in batches:
                if not batch.num_rows:
                    continue
                labels, bagged, draw, b, held = parts(batch)
                odds = model.margins(b, start, held)
                mixed = (draw.view(np.uint64) ^ np.uint64(turn * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
                taken = (mixed >> np.uint64(34)) < np.uint64(int(subsample * HASHES)) if subsample < 1 else np.ones(len(b), bool)
                for k in range(bags):
                    node = leaves(b, growing[k], level) - first
                    own = taken & ((bagged >> k) & 1 > 0) & (node >= 0)
                    if not own.any():
                        continue
                    p = 1 / (1 + np.exp(-odds[own, k]))
                    at = ((node[own, None] * len(names) + np.arange(len(names))) * (MISSING + 1) + b[own]).ravel()
                    for i, w in enumerate((p - labels[own], p * (1 - p), np.ones(len(p)))):
                        sums[k, ..., i] += np.bincount(at, np.repeat(w, len(names)), sums[k, ..., i].size).reshape(sums[k, ..., i].shape)
            k, node, f, c = np.nonzero(sums[..., 2])
            values = sums[k, node, f, c]
            yield pa.RecordBatch.from_arrays([*(pa.array(v.astype(np.int32)) for v in (k, node, f, c)), *(pa.array(v) for v in values.T.copy())], ["bag", "node", "feature", "bin", "g", "h", "n"])

        made = state.mapInArrow(run, "bag int, node int, feature int, bin int, g double, h double, n double")
        found = made.groupBy("bag", "node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n")).toPandas()
        out = np.zeros((3, bags, 2**level, len(names), MISSING + 1))
        for i, c in enumerate(("g", "h", "n")):
            out[i, found.bag, found.node, found.feature, found["bin"]] = found[c]
        return out

    start, rng = 0, np.random.default_rng(seed)
    for turn in range(trees):
        size = 2 ** (depth + 1) - 1
        growing = [{"feature": np.full(size, -1), "last": np.zeros(size, np.int64), "missing_left": np.zeros(size, bool), "value": np.zeros(size)} for _ in range(bags)]
        allowed = np.zeros((bags, len(names)), bool)
        for k in range(bags):
            allowed[k, rng.permutation(len(names))[: max(1, round(columns * len(names)))]] = True
        for level in range(depth):
            g, h, n = level_sums(start, turn, level, growing)
            for k, tree in enumerate(growing):
                for i in range(2**level):
                    node = 2**level - 1 + i
                    tree["value"][node] = -rate * g[k, i, 0].sum() / (h[k, i, 0].sum() + l2)
                    found = best_split(g[k, i], h[k, i], n[k, i], allowed[k], l2, least)
                    if found is None:
                        continue
                    _, f, last, missing_left = found
                    tree["feature"][node], tree["last"][node], tree["missing_left"][node] = f, last, missing_left
                    for side in (0, 1):
                        gs, hs = (a[k, i, f, : last + 1].sum() + missing_left * a[k, i, f, MISSING] for a in (g, h))
                        gs, hs = (gs, hs) if side == 0 else (g[k, i, f].sum() - gs, h[k, i, f].sum() - hs)
                        tree["value"][2 * node + 1 + side] = -rate * gs / (hs + l2)
        for k, tree in enumerate(growing):
            model.trees[k].append(tree)
        if (turn + 1) % rewrite == 0 and turn + 1 < trees:

            def moved(batches, start=start):
                for batch in batches:
                    if batch.num_rows:
                        _, _, _, b, held = parts(batch)
                        m = model.margins(b, start, held)
                        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.ListArray.from_arrays(pa.array(np.arange(len(b) + 1) * bags, pa.int32()), pa.array(m.ravel()))], schema.names)

            last, state = state, written(state.mapInArrow(moved, ddl), "boosting")
            discard(last)
            start = turn + 1
    discard(state)
    return model, mask


def boosted_scores(model: Boosting, df: DataFrame, bags: Column | None = None, name: str = "score") -> DataFrame:
    """df with the mean probability over the bags; given the bags that rows are in, over those that haven't seen a row, if there are any."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def mean(seen: pd.Series, *values: pd.Series) -> pd.Series:
        m = shared.value
        p = 1 / (1 + np.exp(-m.margins(m.bins([v.to_numpy(float) for v in values]))))
        new = (seen.to_numpy(np.int64)[:, None] >> np.arange(p.shape[1])) & 1 == 0
        new |= ~new.any(1, keepdims=True)
        return pd.Series((p * new).sum(1) / new.sum(1))

    return df.withColumn(name, mean(F.coalesce(F.lit(0) if bags is None else bags, F.lit(0)).cast("long"), *(F.col(c).cast("double") for c in model.features)))
