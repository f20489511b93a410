"""SimHash near-duplicates by covering locality-sensitive hashing.

Every text becomes a 64-bit fingerprint: the majority, bit by bit, of the XXH64 hashes of its word
shingles. For a radius r, bit i gets a random vector m(i) of r + 1 bits; each of the 2^(r+1) - 1
non-zero vectors v makes one mask, the bits with <m(i), v> = 1. Any r differing bits leave some v
orthogonal to all of their vectors, so every pair within the radius agrees under some mask: no
pair can be missed.

Fingerprints that meet another one under a mask go on to the exact check, which emits no pairs.
Two fingerprints are within 2 bits if and only if both are within 1 bit of a common midpoint, and
the midpoint of a pair that agrees under a mask differs from both outside that mask only. Each
fingerprint so lists itself and its flips outside the mask, and those that share a midpoint (65
different ones at most) link to the smallest. Work is linear in the fingerprints for any bucket.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, components, kept, staged, text_chunks, trimmed

SHINGLE = 3
RADIUS = 2
SEED = 42
_BITS = np.array([[sum(((byte >> bit) & 1) << (8 * bit) for bit in range(8))] for byte in range(256)], dtype=np.uint64).ravel()


def masks(radius: int = RADIUS, seed: int = 7) -> list[int]:
    """The covering masks of 64 bits for a radius, as signed longs."""
    rows = np.random.default_rng(seed).integers(0, 1 << (radius + 1), 64)
    found = []
    for v in range(1, 1 << (radius + 1)):
        mask = sum(1 << i for i, m in enumerate(rows) if bin(int(m) & v).count("1") % 2)
        found.append(mask - (1 << 64) if mask >> 63 else mask)
    return found


def shingle_hashes(text: bytes, size: int = SHINGLE) -> list[int]:
    """XXH64 of each run of `size` words joined by spaces, or of the whole sequence if it is shorter."""
    words = text.split()  # bytes.split() parts at ASCII white space only
    if not words:
        return []
    joined = b" ".join(words)
    hashed = xxhash.xxh64_intdigest
    if len(words) <= size:
        return [hashed(joined, SEED)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-size]))
    return [hashed(joined[a:b], SEED) for a, b in zip(starts.tolist(), (ends[size - 1 :] - 1).tolist())]


def majority(hashes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Per document, the 64-bit majority of its hashes; zero where it has none."""
    out = np.zeros(len(lengths), dtype=np.uint64)
    full = np.flatnonzero(lengths)
    if not len(full):
        return out
    n = lengths[full]
    begins = np.concatenate(([0], np.cumsum(n)[:-1]))
    # blocks of at most 255 hashes, so that eight counters of a byte each fit a word
    parts = (n + 254) // 255
    first = np.concatenate(([0], np.cumsum(parts)[:-1]))
    starts = np.repeat(begins, parts) + 255 * (np.arange(parts.sum()) - np.repeat(first, parts))
    octets = hashes.view(np.uint8).reshape(-1, 8)
    bits = np.zeros(len(full), dtype=np.uint64)
    for byte in range(8):
        packed = np.add.reduceat(_BITS[octets[:, byte]], starts)
        counts = np.add.reduceat(packed.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
        more = (2 * counts > n[:, None]).astype(np.uint64)
        for bit in range(8):
            bits |= more[:, bit] << np.uint64(8 * byte + bit)
    out[full] = bits
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(id, key long, fp long) of every row; key is a digest of the text, and null and wordless texts get fingerprint zero. chunk_bytes: text that a task handles at a time."""

    def run(batches):
        kept("fingerprints", lambda: None)
        for batch in text_chunks(batches, limit=chunk_bytes):
            texts = pc.ascii_lower(batch.column("text")).cast(pa.binary())
            own = [shingle_hashes(t) if t else [] for t in texts.to_pylist()]
            lengths = np.fromiter(map(len, own), np.int64, len(own))
            hashes = np.fromiter((h for x in own for h in x), np.uint64, int(lengths.sum()))
            yield pa.RecordBatch.from_arrays([batch.column("id").cast(pa.int64()), batch.column("key"), pa.array(majority(hashes, lengths).view(np.int64))], ["id", "key", "fp"])

    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text")).mapInArrow(trimmed(run), "id long, key long, fp long")


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b) edges between different fingerprints fp: their closure is that of all pairs within the radius.

    radius is at most 2 (midpoints one flip away make the exact check).
    """
    if not 1 <= radius <= 2:
        raise ValueError("radius must be 1 or 2")
    table = F.explode(F.array(*(F.struct(F.lit(m).alias("mask"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for m in masks(radius)))).alias("t")
    rows = prints.select("fp", table).select("fp", "t.mask", "t.key")
    met = rows.groupBy("mask", "key").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low <> high").select("mask", "key")
    near = rows.join(met, ["mask", "key"], "left_semi").groupBy("fp").agg(F.bit_or(F.bitwise_not("mask")).alias("free"))
    one = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i))
    flips = F.filter(one, lambda f: F.col("free").bitwiseAND(f) != 0)
    if radius == 1:  # one flip apart: a pair's midpoint is its smaller member
        flips = F.filter(flips, lambda f: F.col("fp").bitwiseAND(f) != 0)
    mids = near.select("fp", F.explode(F.concat(F.array("fp"), F.transform(flips, lambda f: F.col("fp").bitwiseXOR(f)))).alias("mid"))
    groups = mids.groupBy("mid").agg(F.min("fp").alias("b"), F.collect_list("fp").alias("all")).where("size(all) > 1")
    return groups.select(F.explode("all").alias("a"), "b").where("a <> b").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, chunk_bytes: int = CHUNK_BYTES, keys: bool = False) -> DataFrame:
    """(id_col, fingerprint, component_id) of every row of docs; text_key and group_key too, if asked for.

    text_key is XXH64 of the text (seed 42), group_key a fingerprint of the component: the same for all of it, and for no other.
    component_id is the smallest id reachable over links between fingerprints of `radius` or fewer
    differing bits. Null and wordless texts share fingerprint zero and link like any other. A row
    whose id is null gets its fingerprint and the component of its group, null if the group has no
    id at all; repeated rows are kept. An empty table gives none. Only the two columns named are
    read, so others may have any names.
    """
    prints = staged(fingerprints(docs, id_col, text_col, chunk_bytes), "fingerprints")
    least = prints.groupBy("fp").agg(F.min("id").alias("least"))
    group = components(links(least, radius))
    labelled = least.join(group, least.fp == group.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("label"))
    label = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    own = staged(labelled.join(label, "label").select("fp", "component_id", "label"), "components")
    more = (F.col("key").alias("text_key"), F.col("label").alias("group_key")) if keys else ()
    return prints.join(own, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", *more)
