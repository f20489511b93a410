"""Helpers that several corpus operators share: chunks of text, staged tables and connected components."""

from __future__ import annotations

import contextlib
import ctypes
import functools
from collections.abc import Callable, Hashable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.storage import discard, shared_folder  # noqa: F401  (used by the operators)
from tidemark.storage import written as staged

#: A word in every operator here: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Text bytes that a Python worker handles at a time.
CHUNK_BYTES = 4 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_chunks(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into pieces of at most `limit` bytes of text, or one row where a row is longer.

    A piece is a copy and not a view: Arrow's kernels misread some sliced string arrays.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            base = sizes[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(sizes, base + limit, side="right")))
            yield batch if stop - start == batch.num_rows else batch.take(pa.array(np.arange(start, stop)))
            start = stop


def split_words(texts: pa.Array) -> list[list[bytes]]:
    """The words of each text, ASCII letters in lower case; none for a null."""
    return [t.split() for t in pc.ascii_lower(texts.fill_null("")).cast(pa.binary()).to_pylist()]  # bytes.split() parts at ASCII white space only


_KEPT: dict = {}


def give_back() -> None:
    """Returns what the allocators of a Python worker no longer use to the machine; workers stay for a while after their tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not in every C library
        ctypes.CDLL(None).malloc_trim(0)


def trimmed(run: Callable) -> Callable:
    """A function of batches that gives its memory back when it is done."""

    @functools.wraps(run)
    def tidy(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidy


def kept(key: Hashable, make: Callable):
    """What a Python worker keeps from task to task, such as a cache: one thing at a time.

    Workers outlive the stages that they serve. What the last stage kept is freed when another one
    asks for something of its own, if only for None.
    """
    if key not in _KEPT:
        _KEPT.clear()
        give_back()
        _KEPT[key] = make()
    return _KEPT[key]


class WordHashes(dict):
    """XXH64 of words, each computed once."""

    def __missing__(self, word: bytes) -> int:
        self[word] = found = xxhash.xxh64_intdigest(word)
        return found


def crc32_of_id(column: str = "doc_id") -> "F.Column":
    """crc32 of the id's decimal text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges (a, b): component is the smallest node reachable.

    Alternates large-star and small-star steps, each a grouped minimum (combined before its
    shuffle, so that a hub is no hot key) joined back to the edges, and stages the edges after
    each round. Work is proportional to the edges; nothing is collected but one number a round.
    """
    pairs = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    for _ in range(rounds):
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: each node's smaller neighbours and the node itself join the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        last, pairs = pairs, staged(small, "edges")
        discard(last)
        now = pairs.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long")), F.count_distinct("a")).first()
        if now == before or now[0] == now[2] and not pairs.join(pairs.select(F.col("b").alias("a")).distinct(), "a", "left_semi").head(1):
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(pairs.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
