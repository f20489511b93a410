"""Byte-level BPE with a hierarchical-bitmap rank queue.

A pre-token is a linked list of byte positions. Every adjacent pair that the vocabulary can merge
sits in the bucket of its merge rank, as the position of its left end. The queue of non-empty
ranks is a bitmap of three levels of machine words: find-first-set on each level gives the lowest
rank. Merging there takes bucket positions from left to right; entries whose pair has changed
since are stale and skipped. A pre-token of n bytes costs O(n) queue operations plus the sort of
each bucket, so very long ones (no separator for megabytes) need no quadratic rescans.

Spark deals out the rows; each task keeps a bounded cache from chunks of text to their ids.
"""

from __future__ import annotations

import base64
import hashlib
import re
from heapq import heappop, heappush
from struct import pack

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_chunks

VOCABULARY = "byte_bpe_50k.tiktoken"
CACHE_ENTRIES = 600_000


#: The bitmap's words, empty between calls: ranks below 2^18 on the lowest level, 64 to a word.
_LOW = [0] * (1 << 12)
_MIDDLE = [0] * (1 << 6)


def merge(token: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: lowest rank first, leftmost first within a rank."""
    rank_of = ranks.get
    if (whole := rank_of(token)) is not None:
        return [whole]
    n = len(token)
    after = list(range(1, n + 1))  # start of the next piece, by start of a piece
    before = list(range(-1, n - 1))
    waiting = [-1] * n  # rank of the piece with its successor, -1 if none or gone
    low, middle, top = _LOW, _MIDDLE, 0
    buckets: dict[int, list[int]] = {}  # positions by rank, each a heap
    for i in range(n - 1):
        rank = rank_of(token[i : i + 2], -1)
        if rank >= 0:
            waiting[i] = rank
            if rank in buckets:
                buckets[rank].append(i)
            else:
                buckets[rank] = [i]
                low[rank >> 6] |= 1 << (rank & 63)
                middle[rank >> 12] |= 1 << (rank >> 6 & 63)
                top |= 1 << (rank >> 12)
    while top:
        # find-first-set on each level
        block = (top & -top).bit_length() - 1
        bits = middle[block]
        word = block << 6 | (bits & -bits).bit_length() - 1
        bits = low[word]
        rank = word << 6 | (bits & -bits).bit_length() - 1
        bucket = buckets[rank]
        lower = False
        while bucket and not lower:
            i = heappop(bucket)
            if waiting[i] != rank:
                continue  # stale
            j = after[i]
            end = after[i] = after[j]
            waiting[j] = -1
            left = before[i]
            if end < n:
                before[end] = i
                new = rank_of(token[i : after[end]], -1)
            else:
                new = -1
            waiting[i] = new
            wide = rank_of(token[left:end], -1) if left >= 0 else -1
            for at, new in ((i, new), (left, wide)):
                if at < 0 or at == left and new == waiting[at]:
                    continue
                waiting[at] = new
                if new < 0:
                    continue
                lower |= new < rank
                if new in buckets:
                    heappush(buckets[new], at)
                else:
                    buckets[new] = [at]
                    low[new >> 6] |= 1 << (new & 63)
                    middle[new >> 12] |= 1 << (new >> 6 & 63)
                    top |= 1 << (new >> 12)
        if not bucket:
            del buckets[rank]
            low[word] ^= 1 << (rank & 63)
            if not low[word]:
                middle[block] ^= 1 << (word & 63)
                if not middle[block]:
                    top ^= 1 << block
    ids, i = [], 0
    while i < n:
        ids.append(ranks[token[i : after[i]]])
        i = after[i]
    return ids


class ChunkIds:
    """The ids of texts by way of their chunks, each encoded once and kept while it is in use.

    encode_many gets texts and returns their ids as little-endian 32-bit integers. Two generations
    of at most `limit` chunks each, and what one batch of texts adds, bound the memory.
    """

    def __init__(self, encode_many, limit: int = CACHE_ENTRIES) -> None:
        self.encode_many, self.limit = encode_many, limit
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.split = Splitter()

    def encode(self, texts: list[str]) -> list[bytes]:
        parts = [self.split.parts(t) if t else [] for t in texts]
        young, old, new = self.young, self.old, []
        for chunk in set().union(*parts) - young.keys():
            ids = old.get(chunk)
            if ids is None:
                new.append(chunk)
            else:
                young[chunk] = ids
        # a chunk that starts with NUL stands for the rest of it, any other for a space and itself
        young.update(zip(new, self.encode_many([c[1:] if c[:1] == "\0" else " " + c for c in new])))
        out = [b"".join(map(young.__getitem__, p)) for p in parts]
        for chunk in new:
            if len(chunk) > 64:
                del young[chunk]
        if len(young) > self.limit:
            self.young, self.old = {}, young
        return out


class Splitter:
    """Cuts a text where every split by the pattern has a border, so that chunks can be encoded alone.

    A space or newline between two characters that aren't white space always starts a pre-token,
    and such a newline is one by itself. Texts with other white space, or NUL, go as one chunk.
    """

    #: White space other than space and newline, and the controls that some count as such.
    OTHER = re.compile("[\0\t\x0b\x0c\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")

    def parts(self, text: str) -> list[str]:
        ends = text[0] in " \n" or text[-1] in " \n"
        if not (ends or "  " in text or "\n\n" in text or " \n" in text or "\n " in text or self.OTHER.search(text)):
            return ("\0" + text.replace("\n", " \0\n \0")).split(" ")
        return ["\0" + text]


class Encoder:
    """Ids by merge ranks, as bytes of little-endian 32-bit integers."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN) -> None:
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.table = {rank: token for token, rank in self.ranks.items()}
        self.pattern = regex.compile(pattern)
        self.chunks = ChunkIds(lambda texts: list(map(self.encode_chunk, texts)))

    def encode_chunk(self, text: str) -> bytes:
        ids = [i for token in self.pattern.findall(text) for i in merge(token.encode(), self.ranks)]
        return pack(f"<{len(ids)}I", *ids)

    def encode(self, texts: list[str]) -> list[bytes]:
        return self.chunks.encode(texts)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.table.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per worker process and vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(id_col, ids array<int>) of every row; null texts count as empty and get no ids."""

    def run(batches):
        own = encoder(public_tokenizers.path(vocabulary))
        for batch in text_chunks(batches):
            ids = own.encode(batch.column("text").to_pylist())
            sizes = np.fromiter((len(x) // 4 for x in ids), np.int32, len(ids))
            values = pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32))
            offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(offsets, values)], ["id", "ids"])

    frame = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return frame.mapInArrow(run, "id long, ids array<int>").withColumnRenamed("id", id_col)


def decode_documents(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """(id_col, bytes binary) of every row of ids; null ids give null."""

    def run(batches):
        own = encoder(public_tokenizers.path(vocabulary))
        for batch in batches:
            rows = [None if x is None else own.decode(np.asarray(x, "<u4").tobytes()) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(rows, pa.binary())], ["id", "bytes"])

    frame = encoded.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).alias("ids"))
    return frame.mapInArrow(run, "id long, bytes binary").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """Digests of every text's encoding and of its decoding: (id_col, n_tokens, ids_sha256, decoded_sha256).

    The ids never leave the task that makes them. Null and empty texts give no tokens; rows with a
    null or repeated id are kept; an empty table gives none; only the two columns named are read.
    """

    def run(batches):
        own = encoder(public_tokenizers.path(vocabulary))
        for batch in text_chunks(batches):
            ids = own.encode(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(own.decode(x)).hexdigest() for x in ids], pa.string()),
                ],
                ["id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    frame = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return frame.mapInArrow(run, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
