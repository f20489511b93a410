"""Hard-negative mining: Strassen products of anchor and candidate tiles, then mergeable heaps.

Vectors become whole numbers. Anchors are packed into blocks and all rows into tiles, each a row of
bounded size; a group of blocks meets a subset of tiles in one task, so what a task holds doesn't
grow with the table. There a tile product is Strassen's recursion over int64, with zero padding
where a side is odd: additions, subtractions and products wrap around alike, so that a result is
exact whenever it fits in 64 bits itself, whatever the recursion's own sums do.

A first pass keeps, for each anchor, a heap of its best rows of the same label; heaps of tiles merge
in the task, heaps of tasks by rank. A second pass takes the positives found, and keeps for each of
them a heap of the best rows of other labels whose scores lie in the window that it opens.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.aggregates import global_rank

from .common import discard, partitions, staged

SCALE = 256
POSITIVES, NEGATIVES = 5, 10
#: A negative's score is between these hundredths of the positive's.
WINDOW = (30, 90)
#: Rows of a tile and of a block of anchors, and how many of them meet in a task at most.
TILE, BLOCK, TILES_PER_TASK, BLOCKS_PER_TASK = 1024, 256, 128, 64
#: Strassen's recursion ends where a side is no longer than this.
LEAF = 16
#: From this norm on, 100 times a score need not fit in 64 bits.
LARGEST_NORM = float(2**28)
NONE = np.iinfo(np.int64).min


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """a @ b over int64 by Strassen's seven products, sides padded with zeros to even lengths."""
    (m, k), n = a.shape, b.shape[1]
    if min(m, k, n) <= leaf:
        return a @ b
    a, b = np.pad(a, ((0, m % 2), (0, k % 2))), np.pad(b, ((0, k % 2), (0, n % 2)))
    i, j, l = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:i, :j], a[:i, j:], a[i:, :j], a[i:, j:]
    b11, b12, b21, b22 = b[:j, :l], b[:j, l:], b[j:, :l], b[j:, l:]
    p1 = strassen(a11 + a22, b11 + b22, leaf)
    p2 = strassen(a21 + a22, b11, leaf)
    p3 = strassen(a11, b12 - b22, leaf)
    p4 = strassen(a22, b21 - b11, leaf)
    p5 = strassen(a11 + a12, b22, leaf)
    p6 = strassen(a21 - a11, b11 + b12, leaf)
    p7 = strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * i, 2 * l), np.int64)
    out[:i, :l] = p1 + p4 - p5 + p7
    out[:i, l:] = p3 + p5
    out[i:, :l] = p2 + p4
    out[i:, l:] = p1 - p2 + p3 + p6
    return out[:m, :n]


class Heaps:
    """The k best (score, row) of each of n slots, higher scores first and ties by smaller rows; those of further tiles merge into them."""

    def __init__(self, n: int, k: int) -> None:
        self.n, self.k = n, k
        self.slot, self.score, self.row = (np.zeros(0, np.int64) for _ in range(3))
        self.floor = np.full(n, NONE)  # a full slot's last score

    def offer(self, scores: np.ndarray, allowed: np.ndarray, rows: np.ndarray, start: int = 0) -> None:
        """Takes a line of scores for each slot from `start` on, where allowed; a line's own k-th best spares the rest the merge."""
        masked = np.where(allowed, scores, NONE)
        n, width = masked.shape
        kth = np.partition(masked, width - self.k, axis=1)[:, width - self.k] if width > self.k else np.full(n, NONE)
        slot, place = np.nonzero(allowed & (masked >= np.maximum(kth, self.floor[start : start + n])[:, None]))
        self.merge(slot + start, masked[slot, place], rows[place])

    def merge(self, slot: np.ndarray, score: np.ndarray, row: np.ndarray) -> None:
        slot, score, row = (np.concatenate(x) for x in ((self.slot, slot), (self.score, score), (self.row, row)))
        order = np.lexsort((row, ~score, slot))  # ~x falls as x rises, without the overflow of -x
        slot, score, row = slot[order], score[order], row[order]
        rank = np.arange(len(slot)) - np.searchsorted(slot, np.arange(self.n))[slot]
        keep, last = rank < self.k, rank == self.k - 1
        self.slot, self.score, self.row = slot[keep], score[keep], row[keep]
        self.floor[slot[last]] = score[last]


def smallest_ints(v: np.ndarray) -> bytes:
    """A matrix as little-endian numbers of the fewest bytes that hold them all; the first byte says how many."""
    top = int(max(v.max(initial=0), -(v.min(initial=0) + 1)))
    size = next(s for s in (1, 2, 4, 8) if top < 1 << (8 * s - 1))
    return bytes([size]) + v.astype(f"<i{size}").tobytes()


def wide_ints(blob: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(blob, f"<i{blob[0]}", offset=1).reshape(rows, -1).astype(np.int64)


def whole_rows(table: DataFrame, id_col: str, label_col: str, vector_col: str, scale: int, label: Column | None) -> DataFrame:
    """(row, id, label, v): a number for each row that takes part, and its vector as floor(scale * x)."""
    x = F.col("x")
    kind = F.col(label_col) if label is None else label
    rows = table.select(F.col(id_col).cast("long").alias("id"), kind.cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("x"))
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    norm = F.aggregate(F.transform(x, lambda c: F.floor(c * scale).cast("double")), F.lit(0.0), lambda a, c: a + c * c)
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size(x) > 0) & fine).where(norm < LARGEST_NORM**2)
    return global_rank(rows.select("id", "label", F.transform(x, lambda c: F.floor(c * scale)).alias("v")), ["id", "label", "v"], "row")


def matrices(rows: DataFrame, size: int, by: str, number: str) -> DataFrame:
    """(number, rows, ids, labels, v): rows of consecutive numbers `by` packed `size` at a time, vectors zero-filled to the longest of them."""

    def pack(key, table):
        table = table.sort_by("row").combine_chunks()
        column = table.column("v").chunk(0)
        lengths = np.diff(column.offsets.to_numpy())
        v = np.zeros((len(lengths), max(lengths)), np.int64)
        v[np.arange(v.shape[1]) < lengths[:, None]] = column.flatten().to_numpy()
        return pa.table({number: pa.array([key[0].as_py()], pa.int64()), "rows": [table.column("row").to_pylist()], "ids": [table.column("id").to_pylist()], "labels": [table.column("label").to_pylist()], "v": pa.array([smallest_ints(v)], pa.binary())})

    return rows.groupBy(F.floor((F.col(by) - 1) / size).alias(number)).applyInArrow(pack, f"{number} long, rows array<long>, ids array<long>, labels array<string>, v binary")


class Tile:
    """Packed rows in a task; labels are numbers that the task gives them."""

    def __init__(self, row: dict, numbers: dict) -> None:
        self.rows, self.ids = np.array(row["rows"]), np.array(row["ids"])
        self.labels = np.array([numbers.setdefault(x, len(numbers)) for x in row["labels"]])
        self.v = wide_ints(row["v"], len(self.rows))
        self.positives = row.get("positives")

    def scores(self, other: "Tile") -> np.ndarray:
        width = max(self.v.shape[1], other.v.shape[1])
        a, b = (np.pad(x.v, ((0, 0), (0, width - x.v.shape[1]))) for x in (self, other))
        return strassen(a, b.T)


def meet(blocks: DataFrame, tiles: DataFrame, answer, names: list[str]) -> DataFrame:
    """The numbers that answer(block, tiles) gives for every block of anchors and every subset of tiles.

    A task gets at most BLOCKS_PER_TASK blocks and TILES_PER_TASK tiles; a tile is sent once for each
    group of blocks and a block once for each subset of tiles.
    """
    n_blocks, n_tiles = ((df.agg(F.max(c)).first()[0] or 0) + 1 for df, c in ((blocks, "block"), (tiles, "tile")))
    groups = -(-n_blocks // BLOCKS_PER_TASK)
    each = min(TILES_PER_TASK, max(1, n_tiles * groups // (2 * partitions(tiles.sparkSession))))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = blocks.withColumn("group", F.floor(F.col("block") / BLOCKS_PER_TASK).cast("int")).withColumn("subset", every(-(-n_tiles // each)))
    right = tiles.withColumn("subset", F.floor(F.col("tile") / each).cast("int")).withColumn("group", every(groups))

    def run(key, mine, theirs):
        out = [np.zeros((0, len(names)), np.int64)]
        if mine.num_rows and theirs.num_rows:
            numbers: dict = {}
            others = [Tile(r, numbers) for r in theirs.to_pylist()]
            out += [answer(Tile(r, numbers), others) for r in mine.to_pylist()]
        return pa.table(list(np.concatenate(out).T.copy()), names)

    return left.groupBy("group", "subset").cogroup(right.groupBy("group", "subset")).applyInArrow(run, ", ".join(f"{n} long" for n in names))


def ids_of(found: np.ndarray, tiles: list[Tile]) -> np.ndarray:
    rows, ids = np.concatenate([t.rows for t in tiles]), np.concatenate([t.ids for t in tiles])
    order = np.argsort(rows)
    return ids[order[np.searchsorted(rows[order], found)]]


def first_per(df: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The heaps of all tasks merged: each key's k first rows by score and row, with their rank; Spark drops others before it moves them."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "row")
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(
    table: DataFrame, anchors, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", label: Column | None = None,
    scale: int = SCALE, positives: int = POSITIVES, negatives: int = NEGATIVES, window: tuple[int, int] = WINDOW,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): each positive's first rows of other labels in its window.

    anchors is a condition on the id, given as a function of its column. A row's score is its inner
    product with the anchor, over floor(scale * x); higher scores come first, ties go to smaller
    ids. An anchor's positives are its first `positives` other rows of the same label, and a
    negative's score n satisfies window[0] * p <= 100 * n <= window[1] * p. Where there are fewer
    rows than asked for, there are fewer in the result.

    Rows with a null id, label or vector, an empty vector, or a null or non-finite component take no
    part; nor do vectors whose scaled norm is 2^28 or more, as 100 times their scores need not fit
    in 64 bits. Rows that repeat an id stay apart: each is an anchor, a positive or a negative of
    its own, and has its copies among its other rows. Shorter vectors count as filled with zeros. An
    empty table gives none. Only the columns named are read; `label` may say what label counts.
    """
    ranked = whole_rows(table, id_col, label_col, vector_col, scale, label)
    rows = staged(ranked, "rows")
    chosen = global_rank(rows.where(F.coalesce(anchors(F.col("id")), F.lit(False))), ["row"], "n")
    blocks, tiles = staged(matrices(chosen, BLOCK, "n", "block"), "blocks"), staged(matrices(rows, TILE, "row", "tile"), "tiles")
    discard(ranked, chosen, rows)
    low, high = window

    def same_label(block: Tile, others: list[Tile]) -> np.ndarray:
        heaps = Heaps(len(block.rows), positives)
        for tile in others:
            allowed = (block.labels[:, None] == tile.labels) & (block.rows[:, None] != tile.rows)
            if allowed.any():
                heaps.offer(block.scores(tile), allowed, tile.rows)
        return np.column_stack((block.rows[heaps.slot], heaps.row, ids_of(heaps.row, others), heaps.score))

    first = first_per(meet(blocks, tiles, same_label, ["anchor", "row", "id", "score"]), ["anchor"], positives)
    of_block = blocks.select("block", F.explode("rows").alias("anchor")).join(first, "anchor")
    lists = of_block.groupBy("block").agg(F.collect_list(F.struct("anchor", "row", "id", "score")).alias("positives"))  # at most BLOCK * positives
    asked = staged(blocks.join(lists, "block"), "asked")

    def in_window(block: Tile, others: list[Tile]) -> np.ndarray:
        slots = np.array([[x["anchor"], x["row"], x["id"], x["score"]] for x in block.positives], np.int64)
        at = np.searchsorted(block.rows, slots[:, 0])
        p = slots[:, 3]
        # the window in whole scores: from ceil(low * p / 100) to floor(high * p / 100)
        least, most = -(-low * p // 100), high * p // 100
        heaps = Heaps(len(slots), negatives)
        for tile in others:
            scores, other = block.scores(tile), block.labels[:, None] != tile.labels
            for i in range(0, len(slots), BLOCK):
                s = scores[at[i : i + BLOCK]]
                fits = other[at[i : i + BLOCK]] & (s >= least[i : i + BLOCK, None]) & (s <= most[i : i + BLOCK, None])
                heaps.offer(s, fits, tile.rows, i)
        return np.column_stack((block.ids[at[heaps.slot]], slots[heaps.slot], heaps.row, ids_of(heaps.row, others), heaps.score))

    names = ["anchor_id", "anchor", "positive", "positive_id", "positive_score", "row", "negative_id", "score"]
    out = first_per(meet(asked, tiles, in_window, names), ["anchor", "positive"], negatives)
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", F.col("score").alias("negative_score"))
