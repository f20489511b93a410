"""Documents in blocks, and the question "which of my keys occur in another document?" over all of them.

Some operators look at every position of a corpus but need to exchange only what recurs. They work
on blocks: a few megabytes of whole documents, packed into one compressed row and staged once in a
bucketed table, so that later joins by block_id move the small side only. A pass over blocks first
sends sorted 64-bit keys, delta-coded, to the task that owns a range of keys; that answers each
block with one bit per key. Rows of that exchange are bounded by a block, whatever a key's
frequency: a key that a third of all documents holds is one number per block.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, partitions, shared_folder, staged, text_chunks

BLOCK_BYTES = 4 << 20
#: Ranges of keys for each shuffle partition: a range is what a task holds at a time, and several in a task even out.
RANGES = 4


def squeeze(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def expand(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def to_blob(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return squeeze(sink.getvalue().to_pybytes())


def from_blob(blob: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(expand(blob)).read_next_batch()


def build(docs: DataFrame, columns: dict[str, str], limit: int = BLOCK_BYTES) -> DataFrame:
    """(block_id long, blob binary) of docs: the columns named, under new names, "text" among them.

    block_id is unique; the table is bucketed by it and lies in the shared folder.
    """
    spark = docs.sparkSession

    def run(batches):
        from pyspark import TaskContext

        n, held, size = TaskContext.get().partitionId() << 32, [], 0

        def flush():
            nonlocal n, held, size
            table = pa.Table.from_batches(held).combine_chunks()
            n, held, size = n + 1, [], 0
            return pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([to_blob(table.to_batches()[0])], pa.binary())], ["block_id", "blob"])

        for part in text_chunks(batches, limit=limit // 4):
            held.append(part)
            size += part.column("text").nbytes
            if size >= limit:
                yield flush()
        if held:
            yield flush()

    frame = docs.select(*(F.col(old).alias(new) for new, old in columns.items())).mapInArrow(run, "block_id long, blob binary")
    buckets, name = partitions(spark), f"blocks_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/{name}"
    frame.repartition(buckets, "block_id").write.bucketBy(buckets, "block_id").option("path", path).saveAsTable(name)
    out = spark.table(name)
    out.written_to, out.table_name = path, name
    return out


def drop(blocks: DataFrame) -> None:
    """Drops a table of blocks and its files, once everything that reads it is written itself."""
    blocks.sparkSession.sql(f"DROP TABLE {blocks.table_name}")
    discard(blocks)


def delta_code(keys: np.ndarray) -> bytes:
    """Sorted unique 64-bit keys as variable-length differences."""
    gaps = np.diff(keys, prepend=np.uint64(0))
    if not len(gaps):
        return b""
    sizes = np.ones(len(gaps), np.int64)
    for k in range(1, 8):
        sizes += gaps >= np.uint64(1 << 8 * k)
    octets = gaps.astype("<u8").view(np.uint8).reshape(-1, 8)
    return len(gaps).to_bytes(8, "little") + sizes.astype(np.uint8).tobytes() + octets[np.arange(8) < sizes[:, None]].tobytes()


def delta_decode(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, np.uint64)
    n = int.from_bytes(data[:8], "little")
    sizes = np.frombuffer(data, np.uint8, n, 8)
    octets = np.zeros((n, 8), np.uint8)
    octets[np.arange(8) < sizes[:, None]] = np.frombuffer(data, np.uint8, offset=8 + n)
    return np.cumsum(octets.view("<u8").ravel(), dtype=np.uint64)


def _cuts(ranges: int) -> np.ndarray:
    return np.array([(i << 64) // ranges for i in range(1, ranges)], np.uint64)


def recurring(blocks: DataFrame, keys: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]], ranges: int | None = None) -> DataFrame:
    """(block_id, marks binary): for the sorted unique keys of each block, packed bits of which recur.

    keys gives a block's (64-bit key, document number) pairs, in any order and with repeats. A key
    recurs if it is in two documents of a block or in two blocks.
    """
    ranges = ranges or RANGES * partitions(blocks.sparkSession)

    def ask(batches):
        for batch in batches:
            for block, blob in zip(batch.column("block_id").to_pylist(), batch.column("blob")):
                key, owner = keys(from_blob(blob.as_py()))
                unique, inside = unique_and_shared(key, owner)
                bounds = np.concatenate(([0], np.searchsorted(unique, _cuts(ranges)), [len(unique)]))
                parts = [(i, a, b) for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())) if b > a]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([i for i, _, _ in parts], pa.int32()),
                        pa.array([block] * len(parts), pa.int64()),
                        pa.array([delta_code(unique[a:b]) for _, a, b in parts], pa.binary()),
                        pa.array([np.packbits(inside[a:b]).tobytes() for _, a, b in parts], pa.binary()),
                    ],
                    ["part", "block_id", "keys", "inside"],
                )

    def answer(key, table):
        owned = [delta_decode(x) for x in table.column("keys").to_pylist()]
        sizes = [len(x) for x in owned]
        flat = np.concatenate(owned)
        inside = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(table.column("inside").to_pylist(), sizes)]).astype(bool)
        order = np.argsort(flat, kind="stable")
        s = flat[order]
        same = s[1:] == s[:-1]
        again = np.zeros(len(s), bool)
        again[1:] |= same
        again[:-1] |= same
        marks = np.empty(len(s), bool)
        marks[order] = again
        marks |= inside
        cuts = np.cumsum(sizes)[:-1]
        return pa.table({"block_id": table.column("block_id"), "part": table.column("part"), "marks": pa.array([np.packbits(m).tobytes() for m in np.split(marks, cuts)], pa.binary()), "n": pa.array(sizes, pa.int64())})

    asked = blocks.mapInArrow(ask, "part int, block_id long, keys binary, inside binary")
    told = asked.groupBy("part").applyInArrow(answer, "block_id long, part int, marks binary, n long")
    # a block has one row for each range at most
    each = told.groupBy("block_id").agg(F.array_sort(F.collect_list(F.struct("part", "n", "marks"))).alias("marks"))
    return staged(each, "marks")


def columns_blob(arrays: list[np.ndarray]) -> bytes:
    """Several integer arrays of a length, small numbers mostly, as one compressed piece."""
    return squeeze(b"".join(x.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes() for x in arrays))


def blob_columns(blob: bytes, n: int) -> list[np.ndarray]:
    raw = np.frombuffer(expand(blob), np.uint8).reshape(n, 8, -1)
    return [np.ascontiguousarray(x.T).view("<i8").ravel() for x in raw]


def first_holders(blocks: DataFrame, keys: Callable[[dict], tuple[np.ndarray, np.ndarray, np.ndarray]], ranges: int | None = None) -> DataFrame:
    """(block_id, holders): for the sorted unique keys of each block, who holds each key first in the whole corpus.

    keys gives a block's (64-bit key, id, place) in any order, repeats included. The holder of a key
    is its smallest (id, place); keys with one id alone have none. `holders_of` reads the result.
    As in `recurring`, a key is one number per block, however often it occurs.
    """
    ranges = ranges or RANGES * partitions(blocks.sparkSession)

    def ask(batches):
        for row in (r for batch in batches for r in batch.to_pylist()):
            key, owner, place = keys(row)
            order = np.lexsort((place, owner, key))
            key, owner, place = key[order], owner[order], place[order]
            first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
            several = owner[np.append(first[1:], len(key)) - 1] != owner[first] if len(key) else np.zeros(0, bool)
            key, owner, place = key[first], owner[first], place[first]
            bounds = np.concatenate(([0], np.searchsorted(key, _cuts(ranges)), [len(key)])).tolist()
            parts = [(i, a, b) for i, (a, b) in enumerate(zip(bounds, bounds[1:])) if b > a]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([i for i, _, _ in parts], pa.int32()),
                    pa.array([row["block_id"]] * len(parts), pa.int64()),
                    pa.array([delta_code(key[a:b]) for _, a, b in parts], pa.binary()),
                    pa.array([columns_blob([owner[a:b], 2 * place[a:b] + several[a:b]]) for _, a, b in parts], pa.binary()),
                ],
                ["part", "block_id", "keys", "held"],
            )

    def answer(key, table):
        owned = [delta_decode(x) for x in table.column("keys").to_pylist()]
        sizes = [len(x) for x in owned]
        flat = np.concatenate(owned)
        del owned
        owner, place = (np.concatenate(x) for x in zip(*(blob_columns(x, 2) for x in table.column("held").to_pylist())))
        order = np.lexsort((place, owner, flat))
        k, o = flat[order], owner[order]
        first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
        group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(k))))
        several = np.logical_or.reduceat((place[order] & 1).astype(bool), first) | (o[np.append(first[1:], len(k)) - 1] != o[first])
        at = np.empty(len(k), np.int64)
        at[order] = order[first][group]
        shared = np.empty(len(k), bool)
        shared[order] = several[group]
        best, where = owner[at], place[at] >> 1
        cuts = np.cumsum([0, *sizes])
        pieces = [(shared[a:b], best[a:b], where[a:b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
        return pa.table(
            {
                "block_id": table.column("block_id"),
                "part": table.column("part"),
                "n": pa.array(sizes, pa.int64()),
                "marks": pa.array([np.packbits(m).tobytes() for m, _, _ in pieces], pa.binary()),
                "held": pa.array([columns_blob([x[m], y[m]]) for m, x, y in pieces], pa.binary()),
            }
        )

    asked = blocks.mapInArrow(ask, "part int, block_id long, keys binary, held binary")
    told = asked.groupBy("part").applyInArrow(answer, "block_id long, part int, n long, marks binary, held binary")
    # a block has one row for each range at most
    return staged(told.groupBy("block_id").agg(F.array_sort(F.collect_list(F.struct("part", "n", "marks", "held"))).alias("holders")), "holders")


def holders_of(key: np.ndarray, holders: list[dict] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a block's keys, as given to `first_holders`: which have a holder, its id, and its place."""
    if not len(key) or not holders:
        return np.zeros(len(key), bool), np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
    shared = np.concatenate([np.unpackbits(np.frombuffer(h["marks"], np.uint8), count=h["n"]) for h in holders]).astype(bool)
    owner, place = np.zeros(len(shared), np.int64), np.zeros(len(shared), np.int64)
    owner[shared], place[shared] = (np.concatenate(x) for x in zip(*(blob_columns(h["held"], 2) for h in holders)))
    at = np.unique(key, return_inverse=True)[1]
    return shared[at], owner[at], place[at]


def unique_and_shared(key: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted unique keys, and which of them have more than one owner."""
    if not len(key):
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    order = np.argsort(key, kind="stable")
    k, o = key[order], owner[order]
    first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
    return k[first], np.minimum.reduceat(o, first) != np.maximum.reduceat(o, first)


def marked(key: np.ndarray, marks: list[dict]) -> np.ndarray:
    """Which of a block's keys, as given to `recurring`, recur."""
    if not len(key):
        return np.zeros(0, bool)
    bits = np.concatenate([np.unpackbits(np.frombuffer(m["marks"], np.uint8), count=m["n"]) for m in marks]).astype(bool)
    return bits[np.searchsorted(np.unique(key), key)]
