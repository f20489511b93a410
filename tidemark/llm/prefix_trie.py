"""The trie of conversations' prefixes, rolled up by centroid decomposition of its parent edges.

A prefix is known by its depth and the sums of four 32-bit lanes of a digest of (place, role, text)
over its turns, running sums over ranges of turns: no task needs a whole conversation, and none
waits for the turn before. Equal prefixes are one node, named by its smallest member and its depth.

Sums over subtrees come from a centroid decomposition. A node weighs as many conversations as run
through it, so a subtree's weight is the sum of what its members still have to go: known when nodes
are made. Within a component, the nodes of over half its weight are a chain from its top down to its
centroid. What hangs under the centroid in the component is summed, and added along that chain;
without the centroid the component falls apart, each part with at most half of the weight. An
ancestor and a descendant meet in exactly one such sum, that of the first centroid between them.
Components too large for a task are split by joins, all at once, a round for each halving; from
LOCAL nodes down a task decomposes each in memory. Deep chains and wide nodes cost the same.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.aggregates import totals_before

from .common import discard, partitions, staged

#: Nodes of a component that one task may hold.
LOCAL = 1 << 16
#: Characters of a piece of a list of members.
PIECE = 1 << 20
LANES = ("s0", "s1", "s2", "s3")
NODE = ["conv_id", "depth"]
EMPTY = hashlib.sha256(b"").hexdigest()
SCHEMA = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def ordered_turns(table: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv_id, n, digest, bytes): each conversation's turns numbered from 0; the texts themselves go no further."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = table.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), F.octet_length(text).cast("long").alias("bytes"),
        F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256).alias("digest"),
    )
    numbered = totals_before(rows, [F.col("turn").asc_nulls_first(), "role", "digest"], {"n": F.lit(1)}, ["conv_id"])
    out = numbered.select("conv_id", F.col("n").cast("long").alias("n"), "digest", "bytes")
    out.written_to = numbered.written_to
    return out


def rebuilt(turns: DataFrame, family: int, rests: int) -> tuple[DataFrame, DataFrame]:
    """Conversations (c, total) and their turns (c, pos, digest, bytes, total) after each has taken its first turns from its family's first."""
    own = F.col("conv_id")
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("n_own"))
    asked = sizes.select(own.alias("c"), "n_own", (own - own % family).alias("base"), (F.crc32(own.cast("string").cast("binary")) % rests).alias("h"))
    base = sizes.select(own.alias("base"), F.col("n_own").alias("n_base"))
    taken = F.least("h", F.coalesce("n_base", F.lit(0)))
    convs = staged(asked.join(base, "base", "left").select("c", "base", "h", taken.alias("taken"), (taken + F.greatest(F.col("n_own") - F.col("h"), F.lit(0))).alias("total")), "convs")
    head = turns.where(F.col("n") < rests - 1).withColumnRenamed("conv_id", "base")
    first = head.join(convs.where("h > 0"), "base").where("n < h").select("c", F.col("n").alias("pos"), "digest", "bytes", "total")
    rest = turns.withColumnRenamed("conv_id", "c").join(convs, "c").where("n >= h").select("c", (F.col("taken") + F.col("n") - F.col("h")).alias("pos"), "digest", "bytes", "total")
    return convs, first.unionByName(rest)


def key_of(depth: Column, *sums: Column) -> Column:
    return F.unhex(F.md5(F.concat_ws("|", depth, *sums).cast("binary")))


def prefixes(turns: DataFrame) -> DataFrame:
    """(c, depth, key, parent_key, bytes, total): every prefix of every conversation, the textless one left out."""
    mixed = F.sha2(F.concat_ws("|", F.col("pos").cast("string"), F.col("digest")), 256)
    lanes = {s: F.conv(F.substring(mixed, 1 + 8 * i, 8), 16, 10).cast("long") for i, s in enumerate(LANES)}
    rows = turns.withColumns({f"own_{s}": lane for s, lane in lanes.items()}).drop("digest")
    before = totals_before(rows, ["pos"], {s: F.col(f"own_{s}") for s in LANES}, ["c"])
    depth = F.col("pos") + 1
    out = before.select("c", depth.alias("depth"), key_of(depth, *(F.col(s) + F.col(f"own_{s}") for s in LANES)).alias("key"), key_of(F.col("pos"), *(F.col(s) for s in LANES)).alias("parent_key"), "bytes", "total")
    out.written_to = before.written_to
    return out


def decompose(parent: list[int], w: list[int], values: list[list[int]]) -> list[list[int]]:
    """Sums of each list of values over the subtrees of one tree in memory; parents come before their children, w has subtree weights."""
    n = len(parent)
    children: list[list[int]] = [[] for _ in range(n)]
    for i in range(1, n):
        children[parent[i]].append(i)
    got, gone, tops = [[0] * n for _ in values], bytearray(n), [0]
    while tops:
        top = z = tops.pop()
        chain, total = [top], w[top]
        while (z := next((k for k in children[chain[-1]] if not gone[k] and 2 * w[k] > total), -1)) >= 0:
            chain.append(z)
        z = chain[-1]
        under = [z]
        for u in under:
            under += [k for k in children[u] if not gone[k]]
        for v, g in zip(values, got):
            amount = sum(v[u] for u in under)
            if amount:
                for u in chain:
                    g[u] += amount
        for u in chain[:-1]:
            w[u] -= w[z]
        gone[z] = 1
        tops += [k for k in children[z] if not gone[k]]
        if z != top:
            tops.append(top)
    return got


def decompose_in_tasks(state: DataFrame) -> DataFrame:
    """(conv_id, depth, n_leaves, saved_tokens) of components that fit in a task, each decomposed where its nodes have come together."""

    def run(batches):
        held: list[dict] = []

        def flush():
            at = {(r["conv_id"], r["depth"]): i for i, r in enumerate(held)}
            parent = [at.get((r["parent"], r["depth"] - 1), -1) for r in held]
            leaves, saved = decompose(parent, [r["w"] for r in held], [[r["leaf"] for r in held], [r["saved"] for r in held]])
            ready.extend({"conv_id": r["conv_id"], "depth": r["depth"], "n_leaves": r["got_leaves"] + a, "saved_tokens": r["got_saved"] + b} for r, a, b in zip(held, leaves, saved))
            held.clear()

        ready: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if held and (held[0]["top"], held[0]["top_depth"]) != (row["top"], row["top_depth"]):
                    flush()
                held.append(row)
            if ready:
                yield pa.RecordBatch.from_pylist(ready, schema)
                ready.clear()
        if held:
            flush()
            yield pa.RecordBatch.from_pylist(ready, schema)

    schema = pa.schema([(c, pa.int64()) for c in (*NODE, "n_leaves", "saved_tokens")])
    together = state.repartition("top", "top_depth").sortWithinPartitions("top", "top_depth", "depth", "conv_id")
    return together.mapInArrow(run, "conv_id long, depth long, n_leaves long, saved_tokens long")


def rolled_up(nodes: DataFrame, ways: DataFrame, root: int, local: int) -> DataFrame:
    """(conv_id, depth, n_leaves, saved_tokens): sums of leaf and saved over the subtree of each of nodes (conv_id, depth, parent, w, leaf, saved).

    ways has (c, depth, at, below): the node that each conversation stands on at a depth, and the one after it.
    """
    part, zero = ["top", "top_depth"], F.lit(0).cast("long")
    state, done = nodes.select(*NODE, "parent", "w", "leaf", "saved", zero.alias("got_leaves"), zero.alias("got_saved"), F.lit(root).cast("long").alias("top"), zero.alias("top_depth")), []
    columns = state.columns
    last = None
    while True:
        sizes = state.groupBy(*part).agg(F.count("*").alias("size"), F.max("w").alias("all"))
        sized = staged(state.join(sizes, part), "components")
        if last is not None:
            discard(last)
        done.append(staged(decompose_in_tasks(sized.where(F.col("size") <= local).select(*columns)), "sums"))
        large = sized.where(F.col("size") > local)
        if large.isEmpty():
            discard(sized)
            break
        heavy = 2 * F.col("w") > F.col("all")
        centre = large.where(heavy).groupBy(*part).agg(F.min(F.struct("w", *NODE)).alias("z")).select(*part, F.col("z.w").alias("z_w"), F.col("z.conv_id").alias("z_conv"), F.col("z.depth").alias("z_depth"))
        met = large.join(centre, part).join(ways.select(F.col("c").alias("conv_id"), F.col("depth").alias("z_depth"), "at", "below"), ["conv_id", "z_depth"], "left")
        under = (F.col("depth") >= F.col("z_depth")) & F.col("at").eqNullSafe(F.col("z_conv"))
        placed = staged(met.withColumn("under", under), "placed")
        sums = placed.where("under").groupBy(*part).agg(F.sum("leaf").alias("leaves"), F.sum("saved").alias("saves"))
        is_centre = (F.col("conv_id") == F.col("z_conv")) & (F.col("depth") == F.col("z_depth"))
        given = placed.join(sums, part).withColumns({
            "got_leaves": F.col("got_leaves") + F.when(heavy, F.col("leaves")).otherwise(0), "got_saved": F.col("got_saved") + F.when(heavy, F.col("saves")).otherwise(0),
            "w": F.col("w") - F.when(heavy & ~is_centre, F.col("z_w")).otherwise(0),
        })
        last = staged(given, "split")
        done.append(staged(last.where(is_centre).select(*NODE, F.col("got_leaves").alias("n_leaves"), F.col("got_saved").alias("saved_tokens")), "sums"))
        apart = {"top": F.when(F.col("under"), F.col("below")).otherwise(F.col("top")), "top_depth": F.when(F.col("under"), F.col("z_depth") + 1).otherwise(F.col("top_depth"))}
        state = last.where(~is_centre).withColumns(apart).select(*columns)
        discard(sized, placed)
    out = done[0]
    for df in done[1:]:
        out = out.unionByName(df)
    return out


def member_digests(members: DataFrame) -> DataFrame:
    """(conv_id, depth, ends_sha256): SHA-256 of the sorted ids c of each node of members (conv_id, depth, c), joined by commas.

    Ids are joined into pieces in ranges of (node, id); a node's pieces pass through one task as a
    stream, as a digest has to, and none is held.
    """

    def join(batches):
        key, first, ids, size = None, None, [], 0
        piece = lambda: pa.RecordBatch.from_pylist([{"conv_id": key[0], "depth": key[1], "first": first, "ids": ",".join(ids)}], schema)
        for batch in batches:
            for conv_id, depth, c in zip(*(batch.column(i).to_pylist() for i in ("conv_id", "depth", "c"))):
                if ids and ((conv_id, depth) != key or size > PIECE):
                    yield piece()
                    ids, size = [], 0
                if not ids:
                    key, first = (conv_id, depth), c
                ids.append(str(c))
                size += len(ids[-1]) + 1
        if ids:
            yield piece()

    def digest(batches):
        key, state = None, None
        done = lambda: pa.RecordBatch.from_pylist([{"conv_id": key[0], "depth": key[1], "ends_sha256": state.hexdigest()}])
        for batch in batches:
            for row in batch.to_pylist():
                if (row["conv_id"], row["depth"]) != key:
                    if key:
                        yield done()
                    key, state = (row["conv_id"], row["depth"]), hashlib.sha256(row["ids"].encode())
                else:
                    state.update(b"," + row["ids"].encode())
        if key:
            yield done()

    schema = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("first", pa.int64()), ("ids", pa.string())])
    ranges = members.select(*NODE, "c").repartitionByRange(partitions(members.sparkSession), *NODE, "c").sortWithinPartitions(*NODE, "c")
    pieces = ranges.mapInArrow(join, "conv_id long, depth long, first long, ids string")
    return pieces.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(digest, "conv_id long, depth long, ends_sha256 string")


def prefix_trie(table: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", family: int = 5, rests: int = 9, local: int = LOCAL) -> DataFrame:
    """SCHEMA: a row for each distinct prefix of the rebuilt conversations, its counts, and sums over its subtree.

    Turns are ordered by turn, null first, ties by role and by a digest of the text; null roles and
    texts are empty, rows with a null conversation are left out. Conversation c gets the first h
    turns of conversation c - c % family (fewer if it has fewer, none if there is none), h being
    crc32 of c's decimal text modulo `rests`, and its own turns after its first h. With rests = 1
    conversations stay as they are. Repeated rows are turns of their own. The root belongs to all
    conversations; an empty table has none, and gives no rows. Only the columns named are read.
    """
    spark = table.sparkSession
    counted = ordered_turns(table, conv_col, turn_col, role_col, text_col)
    turns = staged(counted, "turns")
    convs, new_turns = rebuilt(turns, family, rests)
    whole = convs.agg(F.count("*").alias("n"), F.min("c").alias("least"), F.sum("total").alias("turns")).first()
    if not whole.n:
        return spark.createDataFrame([], SCHEMA)
    made = prefixes(new_turns)
    rows = staged(made, "prefixes")
    discard(counted, made, turns)
    named = staged(rows.groupBy("key").agg(F.min("c").alias("conv_id"), F.max("depth").alias("depth"), F.min("parent_key").alias("parent_key"), F.count("*").alias("n_convs"), F.max("bytes").alias("bytes"), F.sum(F.col("total") - F.col("depth") + 1).alias("w")), "nodes")
    number = lambda x: F.lit(x).cast("long")
    above = named.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent"))
    lower = named.where("depth > 1").join(above, "parent_key").unionByName(named.where("depth = 1").withColumn("parent", number(whole.least)))
    top = spark.range(1).select(number(whole.least).alias("conv_id"), number(0).alias("depth"), number(None).alias("parent"), number(whole.n).alias("n_convs"), number(0).alias("bytes"), number((whole.turns or 0) + whole.n).alias("w"))
    linked = lower.select(*top.columns).unionByName(top)
    children = linked.where("depth > 0").groupBy(F.col("parent").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    nodes = staged(linked.join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long")).withColumns({"leaf": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("bytes")}), "nodes")
    stands = staged(rows.join(named.select("key", F.col("conv_id").alias("at")), "key").select("c", "depth", "at", "total"), "stands")
    discard(rows, named)
    here = stands.select("c", "depth", "at").unionByName(convs.select("c", number(0).alias("depth"), number(whole.least).alias("at")))
    ways = here.join(stands.select("c", (F.col("depth") - 1).alias("depth"), F.col("at").alias("below")), ["c", "depth"], "left")
    sums = rolled_up(nodes, ways, whole.least, local)
    ends = stands.where("depth = total").select(F.col("at").alias("conv_id"), "depth", "c").unionByName(convs.where("total = 0").select(number(whole.least).alias("conv_id"), number(0).alias("depth"), "c"))
    out = nodes.join(sums, NODE).join(member_digests(ends), NODE, "left")
    return out.select(*NODE, F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"))


ORACLE = """
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS n
  FROM conversations WHERE conv_id IS NOT NULL),
sizes AS (SELECT conv_id, count(*) AS n_own, CAST(conv_id AS VARCHAR) AS s FROM t GROUP BY conv_id),
h AS (SELECT conv_id AS c, conv_id - conv_id % 5 AS base, n_own,
  xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, length(s) + 1), lambda i: ascii(s[i])::BIGINT)), lambda r, b: list_reduce(list_concat([xor(r, b)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, z: xor(x >> 1, 3988292384 * (x & 1))))) % 9 AS h FROM sizes),
k AS (SELECT h.*, least(h, coalesce(b.n_own, 0)) AS taken FROM h LEFT JOIN sizes b ON b.conv_id = h.base),
r AS (SELECT c, n + 1 AS d, role, text FROM k JOIN t ON t.conv_id = base AND n < h UNION ALL SELECT c, taken + n - h + 1, role, text FROM k JOIN t ON t.conv_id = c AND n >= h),
p AS (SELECT c, d, octet_length(encode(text)) AS bytes, list(sha256(length(role) || ':' || role || text)) OVER (PARTITION BY c ORDER BY d) AS path FROM r UNION ALL SELECT c, 0, 0, [] FROM k),
a AS (SELECT c, d, bytes, min(c) OVER (PARTITION BY d, path) AS rep, max(d) OVER (PARTITION BY c) AS total FROM p),
n0 AS (SELECT rep AS conv_id, d AS depth, count(*) AS n_convs, max(bytes) AS bytes FROM a GROUP BY rep, d),
n1 AS (SELECT n0.*, a.rep AS parent_conv_id FROM n0 LEFT JOIN a ON a.c = n0.conv_id AND a.d = n0.depth - 1),
n2 AS (SELECT n1.*, coalesce(k.n_children, 0) AS n_children FROM n1 LEFT JOIN (SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n_children FROM n1 WHERE depth > 0 GROUP BY ALL) k USING (conv_id, depth)),
sums AS (SELECT a.rep AS conv_id, a.d AS depth, sum(CAST(n_children = 0 AS BIGINT)) AS n_leaves, sum((n_convs - 1) * n2.bytes) AS saved_tokens FROM n2 JOIN a ON a.c = n2.conv_id AND a.d <= n2.depth GROUP BY ALL),
ends AS (SELECT rep AS conv_id, d AS depth, sha256(string_agg(c, ',' ORDER BY c)) AS ends_sha256 FROM a WHERE d = total GROUP BY ALL)
SELECT conv_id, CAST(depth AS BIGINT) AS depth, parent_conv_id, n_convs, n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, coalesce(ends_sha256, sha256('')) AS ends_sha256
FROM n2 JOIN sums USING (conv_id, depth) LEFT JOIN ends USING (conv_id, depth)
"""
