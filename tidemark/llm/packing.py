"""Best-fit packing of documents into fixed-length sequences, with certified repacking.

Documents become pieces of at most `capacity` tokens. Pieces are dealt into partitions of bounded
size, each packed by best-fit decreasing over lengths. Dual-feasible-function lower bounds then
tell which partitions provably can't use fewer bins; they are final. The others have a gap: they
keep their nearly full bins and exchange the pieces of the rest, which are dealt anew, into fewer
and so richer partitions, and packed again.
"""

from __future__ import annotations

import os
import zlib
from struct import pack as pack_ids

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .bpe_rank_queue import ChunkIds
from .common import kept, staged, text_chunks, trimmed

VOCABULARY = "byte_bpe_50k.json"
CAPACITY = 1024
END_ID = 2
#: Pieces that one task packs at a time; memory is bounded by it.
PIECES_PER_PARTITION = 200_000
ROUNDS = 3


class TokenIds:
    """Ids of a text as little-endian 32-bit integers, by a tokenizers file without its added ends; special tokens' strings get their ids.

    Byte-level pre-tokenization has a border at every chunk border, so chunks are encoded once and
    kept. Texts that hold the string of an added token are encoded whole, as it may stand across borders.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a task on each core already
        self.tokenizer = Tokenizer.from_file(path)
        self.chunks = ChunkIds(self.many)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def many(self, texts: list[str]) -> list[bytes]:
        return [pack_ids(f"<{len(x.ids)}I", *x.ids) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        whole = [i for i, t in enumerate(texts) if t and any(a in t for a in self.added)]
        if not whole:
            return self.chunks.encode(texts)
        out = self.chunks.encode(["" if i in set(whole) else t for i, t in enumerate(texts)])
        for i, ids in zip(whole, self.many([texts[i] for i in whole])):
            out[i] = ids
        return out


def _tokenizer(name: str) -> TokenIds:
    return kept(("tokenizer", name), lambda: TokenIds(public_tokenizers.path(name)))


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, row, piece, start, length, ids_crc32): every document's ids and an end id, cut where longer than capacity.

    All but the first piece of a document hold exactly `capacity` tokens. row tells repeated rows apart.
    """
    end = int(end_id).to_bytes(4, "little")

    def run(batches):
        own = _tokenizer(vocabulary)
        for batch in text_chunks(batches):
            at, piece, start, length, crc = [], [], [], [], []
            for i, ids in enumerate(own.encode(batch.column("text").to_pylist())):
                ids += end
                n = len(ids) // 4
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    at.append(i)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(ids[4 * a : 4 * b]))
            index = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(index), batch.column("row").take(index), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                ["id", "row", "piece", "start", "length", "ids_crc32"],
            )

    frame = docs.select(F.col(id_col).cast("long").alias("id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("text"))
    return frame.mapInArrow(trimmed(run), "id long, row long, piece int, start long, length long, ids_crc32 long")


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """Bins that any packing needs: the best of the dual feasible functions.

    For a threshold k up to half of the capacity: lengths over capacity - k count as a whole bin
    each, lengths under k as nothing, the others as themselves. For a divisor: f(x) rounds
    (d + 1) x / capacity down to whole dths of a bin, unless it is whole already. Both families
    are dual feasible, so the sum of f, rounded up, is a lower bound.
    """
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1)[: capacity + 1].astype(np.int64)
    sizes = np.arange(capacity + 1, dtype=np.int64)
    number, weight = np.cumsum(count), np.cumsum(count * sizes)
    k = np.arange(0, capacity // 2 + 1)
    below = np.where(k > 0, k - 1, 0)
    middle = weight[capacity - k] - np.where(k > 0, weight[below], 0)
    best = int(np.max(number[-1] - number[capacity - k] + -(-middle // capacity)))
    for d in range(1, 101):
        scaled = (d + 1) * sizes
        f = np.where(scaled % capacity == 0, sizes * d, (scaled // capacity) * capacity)  # in units of 1 / (d * capacity)
        best = max(best, int(-(-np.dot(count, f) // (d * capacity))))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """The bin of each piece: longest first, into the bin with the least room that holds it.

    Bins wait in stacks by their room; a bitmap of the rooms in use finds the best fit at once.
    """
    bins = np.empty(len(lengths), np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, opened = 0, 0
    order = np.argsort(-lengths, kind="stable")
    for i, size in zip(order.tolist(), lengths[order].tolist()):
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            stack = stacks[room]
            b = stack.pop()
            if not stack:
                rooms ^= 1 << room
        else:
            room, b = capacity, opened
            opened += 1
        bins[i] = b
        left = room - size
        if left:
            if not stacks[left]:
                rooms |= 1 << left
            stacks[left].append(b)
    return bins


def _pack_group(capacity: int, last: bool):
    """Packs one partition; final pieces get a bin of at least 0, those to exchange get -1."""

    def run(key, table):
        table = table.sort_by([("length", "descending"), ("id", "ascending"), ("row", "ascending"), ("piece", "ascending")])
        lengths = table.column("length").to_numpy().astype(np.int64)
        bins = best_fit_decreasing(lengths, capacity)
        used = int(bins.max()) + 1
        if not last and used > lower_bound(lengths, capacity):
            filled = np.bincount(bins, lengths, minlength=used).astype(np.int64)
            bins = np.where(filled[bins] < capacity, -1, bins)
        order = np.argsort(bins, kind="stable")
        b, n = bins[order], lengths[order]
        ends = np.cumsum(n)
        first = np.concatenate(([True], b[1:] != b[:-1]))
        offset = ends - n - np.repeat((ends - n)[first], np.diff(np.append(np.flatnonzero(first), len(b))))
        table = table.take(pa.array(order))
        return table.append_column("bin", pa.array(b)).append_column("offset", pa.array(offset))

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, vocabulary: str = VOCABULARY, rounds: int = ROUNDS, per_partition: int = PIECES_PER_PARTITION) -> DataFrame:
    """(id_col, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every row.

    A null or empty text is its end id alone. Rows with null or repeated ids are packed like any
    other; an empty table gives none. Only the two columns named are read. Full pieces are
    sequences of their own; sequence_id is unique and without further meaning.
    """
    cut = staged(pieces(docs, id_col, text_col, capacity, end_id, vocabulary), "pieces")
    columns = ["id", "row", "piece", "start", "length", "ids_crc32"]
    final = cut.where(F.col("length") == capacity).select(*columns, F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    final = final.withColumn("sequence_id", F.col("sequence_id") * 4)
    open_pieces = cut.where(F.col("length") < capacity)
    schema = "id long, row long, piece int, start long, length long, ids_crc32 long, part long, bin long, offset long"
    for turn in range(rounds):
        n = open_pieces.count()
        if not n:
            break
        parts = -(-n // per_partition)
        # a random but repeatable deal: copies and hot sources spread evenly
        dealt = open_pieces.withColumn("part", F.pmod(F.xxhash64(F.lit(turn), "id", "row", "piece"), F.lit(parts)))
        packed = staged(dealt.groupBy("part").applyInArrow(_pack_group(capacity, turn == rounds - 1 or parts == 1), schema), "packed")
        done = packed.where("bin >= 0").withColumn("sequence_id", ((F.col("part") * (1 << 31) + F.col("bin")) * 4 + turn + 1))
        final = final.unionByName(done.select(*columns, "sequence_id", "offset"))
        open_pieces = packed.where("bin < 0").select(*columns)
        if parts == 1:
            break
    return final.select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
