"""N-gram language-model scoring from an Elias-Fano trie.

The model is a word bigram with absolute discounting, interpolated with add-one unigrams:
p(w | v) = max(c(v w) - D, 0) / c(v) + D * N(v) / c(v) * p(w), where N(v) counts the words seen
after v. It is learnt from the training documents of the whole corpus and never gathered in one
place. Words are numbered by the task that owns their range of hashes; bigrams go to the task that
owns the range of their context. That task builds one part of the trie:

* level 1, the contexts: an Elias-Fano sequence of word numbers;
* pointers from each context to its successors: an Elias-Fano sequence of running counts;
* level 2, the successors: each context's word numbers relative to the context's predecessor sum,
  which makes the whole level one monotone Elias-Fano sequence;
* codes of 16 bits into a codebook of discounted log probabilities, and of back-off weights.

The levels are written to an unlinked temporary file and mapped into memory; blocks of documents
ask for their distinct bigrams, found by successor search within the context, and get codes back.
"""

from __future__ import annotations

import mmap
import tempfile
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import RANGES, _cuts, blob_columns, build, columns_blob, delta_code, delta_decode, expand, from_blob, squeeze
from .common import partitions, split_words, staged

DISCOUNT = 0.75
#: Steps of a natural-log probability that one code stands for: within 0.0005 of the exact value.
CODE_STEP = 1e-3
#: Numbers of a level that are decoded at a time.
SEGMENT = 1 << 16
#: Hashes of what is no word, and so can't be one: the end of a text, and what comes before its first word.
END, BEGIN = (np.uint64(xxhash.xxh64_intdigest(x)) for x in (b" end", b" begin"))


class EliasFano:
    """A monotone sequence of n numbers below 2^63: low bits packed as they are, high bits in unary."""

    def __init__(self, low: np.ndarray, high: np.ndarray, ranks: np.ndarray, n: int, shift: int) -> None:
        self.low, self.high, self.ranks, self.n, self.shift = low, high, ranks, n, shift

    @staticmethod
    def parts(values: np.ndarray) -> tuple[list[np.ndarray], int]:
        """(low bits, high bits, set bits before each 512 bits) as arrays to store, and the shift."""
        n, top = len(values), int(values[-1]) + 1 if len(values) else 1
        shift = max(0, (top // max(n, 1)).bit_length() - 1)
        bits = ((values[:, None] >> np.arange(shift, dtype=values.dtype)) & 1).astype(np.uint8) if shift else np.zeros((n, 0), np.uint8)
        low = np.concatenate((np.packbits(bits.ravel(), bitorder="little"), np.zeros(9, np.uint8)))
        where = (values >> np.array(shift, values.dtype)).astype(np.int64) + np.arange(n)
        unary = np.zeros((int(where[-1]) if n else 0) // 512 * 512 + 512, np.uint8)
        unary[where] = 1
        ranks = np.concatenate(([0], np.cumsum(unary.reshape(-1, 512).sum(1, dtype=np.int64))))
        return [low, np.packbits(unary, bitorder="little"), ranks], shift

    def decode(self, a: int, b: int) -> np.ndarray:
        """The values at places [a, b)."""
        first = int(np.searchsorted(self.ranks, a, side="right")) - 1
        last = int(np.searchsorted(self.ranks, b - 1, side="right"))
        ones = np.flatnonzero(np.unpackbits(self.high[64 * first : 64 * last], bitorder="little"))
        skip = a - int(self.ranks[first])
        values = (ones[skip : skip + b - a] + 512 * first - np.arange(a, b)) << self.shift
        if self.shift:
            bit = a * self.shift
            bits = np.unpackbits(self.low[bit >> 3 : (b * self.shift + 7) >> 3], bitorder="little")[bit & 7 :][: (b - a) * self.shift]
            values |= bits.reshape(-1, self.shift).astype(np.int64) @ (np.int64(1) << np.arange(self.shift))
        return values

    def select(self, places: np.ndarray) -> np.ndarray:
        """The values at sorted places, a segment at a time."""
        out = np.empty(len(places), np.int64)
        for a in range(0, self.n, SEGMENT):
            b = min(a + SEGMENT, self.n)
            x, y = np.searchsorted(places, (a, b))
            if y > x:
                out[x:y] = self.decode(a, b)[places[x:y] - a]
        return out

    def find(self, targets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of sorted targets, the place of the first value that isn't below each, and whether it is equal."""
        place, hit = np.full(len(targets), self.n), np.zeros(len(targets), bool)
        done = 0
        for a in range(0, self.n, SEGMENT):
            b = min(a + SEGMENT, self.n)
            values = self.decode(a, b)
            upto = int(np.searchsorted(targets, values[-1], side="right"))
            if upto > done:
                at = np.searchsorted(values, targets[done:upto])
                place[done:upto], hit[done:upto] = a + at, values[at] == targets[done:upto]
                done = upto
        return place, hit


class Trie:
    """The part of the model that holds a range of contexts, in one memory-mapped file."""

    def __init__(self, first: np.ndarray, second: np.ndarray, count: np.ndarray) -> None:
        """Bigrams sorted by (first, second) with their counts."""
        starts = np.flatnonzero(np.concatenate(([True], first[1:] != first[:-1]))) if len(first) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(starts, len(first)))
        totals = np.add.reduceat(count, starts) if len(first) else np.zeros(0, np.int64)
        self.span = int(second.max()) + 1 if len(second) else 1
        # a context's successors, shifted by its rank times the span of word numbers, go on rising
        relative = second + np.repeat(np.arange(len(starts)), sizes) * self.span
        levels = [EliasFano.parts(x) for x in (first[starts], np.append(starts, len(first)), relative)]
        with np.errstate(divide="ignore"):
            found = np.log(np.maximum(count - DISCOUNT, 1e-12) / np.repeat(totals, sizes))
            weight = np.log(DISCOUNT * sizes / totals)
        codes = [np.round(-x / CODE_STEP).astype("<u2") for x in (found, weight)]
        arrays = [x for parts, _ in levels for x in parts] + codes
        self.file = tempfile.TemporaryFile()
        places = []
        for x in arrays:
            places.append((self.file.tell(), x.dtype, len(x)))
            self.file.write(x.tobytes() + b"\0" * (-x.nbytes % 8))
        self.file.write(b"\0" * 8)
        self.file.flush()
        self.map = mmap.mmap(self.file.fileno(), 0, access=mmap.ACCESS_READ)
        views = [np.frombuffer(self.map, kind, n, at) for at, kind, n in places]
        lengths = (len(starts), len(starts) + 1, len(first))
        self.contexts, self.pointers, self.successors = (EliasFano(*views[3 * k : 3 * k + 3], lengths[k], levels[k][1]) for k in range(3))
        self.found, self.weight = views[9:]

    def look_up(self, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of each bigram's discounted probability and of its context's back-off weight; 65535 where not seen.

        second is looked for among the successors of its context alone.
        """
        found, weight = (np.full(len(first), 0xFFFF, np.uint16) for _ in range(2))
        if not self.contexts.n or not len(first):
            return found, weight
        own, back = np.unique(first, return_inverse=True)
        at, seen = self.contexts.find(own)
        safe = np.where(seen, at, 0)
        weight = np.where(seen, self.weight[safe], 0xFFFF).astype(np.uint16)[back]
        starts = np.zeros((2, len(own)), np.int64)
        starts[:, seen] = self.pointers.select(at[seen]), self.pointers.select(at[seen] + 1)
        ask = np.flatnonzero(seen[back] & (second < self.span))
        target = safe[back[ask]] * self.span + second[ask]
        order = np.argsort(target, kind="stable")
        ask = ask[order]
        place, hit = self.successors.find(target[order])
        hit &= (place >= starts[0, back[ask]]) & (place < starts[1, back[ask]])
        found[ask[hit]] = self.found[place[hit]]
        return found, weight


def _tokens(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct token hashes, every token's place among them, tokens per document): words, then one end each."""
    lists = split_words(batch.column("text"))
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    codes: dict[bytes, int] = {}
    flat_codes = np.fromiter((codes.setdefault(w, len(codes)) for x in lists for w in x), np.int64, int(sizes.sum()))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, codes), np.uint64, len(codes))
    table, number = np.unique(np.append(hashes, END), return_inverse=True)
    flat = np.empty(len(flat_codes) + len(sizes), np.int64)
    last = np.cumsum(sizes + 1) - 1
    slot = np.ones(len(flat), bool)
    slot[last] = False
    flat[slot] = number[flat_codes]
    flat[last] = number[-1]
    return table, flat, sizes + 1


def _training(ids: list, modulus: int = 7, held: int = 2) -> np.ndarray:
    return np.fromiter((zlib.crc32(str("" if i is None else i).encode()) % modulus != held for i in ids), bool, len(ids))


def _bigrams(batch: pa.RecordBatch, numbers: np.ndarray, begin: int) -> tuple[np.ndarray, ...]:
    """(distinct first, second, training count, each token's bigram among them) of a block, sorted."""
    _, flat, sizes = _tokens(batch)
    token = numbers[flat]
    before = np.empty_like(token)
    before[1:] = token[:-1]
    before[np.cumsum(sizes) - sizes] = begin
    order = np.lexsort((token, before))
    a, b = before[order], token[order]
    new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))[: len(a)]
    which = np.empty(len(a), np.int64)
    which[order] = np.cumsum(new) - 1
    train = np.repeat(_training(batch.column("id").to_pylist()), sizes)
    count = np.bincount(which, train, int(new.sum())).astype(np.int64)
    return a[new], b[new], count, which


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", step: int = 1 << 40) -> DataFrame:
    """(id_col, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    Training rows are those with crc32(id as text) mod 7 other than 2; a null id counts as the
    empty text, and so trains. Null and empty texts are one end token. Repeated rows count as often
    as they come. With no training rows at all every probability is that of an unseen word. An
    empty table gives none. Only the two columns named are read.
    """
    spark = docs.sparkSession
    blocks = build(docs.withColumn(id_col, F.col(id_col).cast("long")), {"id": id_col, "text": text_col})
    ranges = RANGES * partitions(spark)
    cuts = _cuts(ranges)

    def ask_words(batches):
        for batch in batches:
            for block, blob in zip(*(batch.column(c).to_pylist() for c in ("block_id", "blob"))):
                own = from_blob(blob)
                table, flat, sizes = _tokens(own)
                count = np.bincount(flat, np.repeat(_training(own.column("id").to_pylist()), sizes), len(table)).astype(np.int64)
                bounds = [0, *np.searchsorted(table, cuts).tolist(), len(table)]
                parts = [(i, a, b) for i, (a, b) in enumerate(zip(bounds, bounds[1:])) if b > a]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i for i, _, _ in parts], pa.int32()), pa.array([block] * len(parts), pa.int64()), pa.array([delta_code(table[a:b]) for _, a, b in parts], pa.binary()), pa.array([columns_blob([count[a:b]]) for _, a, b in parts], pa.binary())],
                    ["part", "block_id", "keys", "counts"],
                )

    def number_words(key, table):
        part = table.column("part")[0].as_py()
        keys = [delta_decode(x) for x in table.column("keys").to_pylist()]
        counts = np.concatenate([blob_columns(x, 1)[0] for x in table.column("counts").to_pylist()])
        unique, at = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(at, counts, len(unique)).astype(np.int64)
        # words that training never saw need no number of their own: 0 stands for all of them
        known = total > 0
        # numbers of a part: from its own place on, so that no part needs to know of others
        number = np.where(known, part * step + np.cumsum(known), 0)
        blobs = [columns_blob([total[a], number[a] - part * step * (number[a] > 0)]) for a in np.split(at, np.cumsum([len(k) for k in keys])[:-1])]
        n = table.num_rows
        return pa.table(
            {
                "block_id": table.column("block_id"),
                "part": table.column("part"),
                "words": pa.array(blobs, pa.binary()),
                # a part's totals, once
                "tokens": pa.array([int(total.sum())] + [0] * (n - 1), pa.int64()),
                "types": pa.array([int(known.sum())] + [0] * (n - 1), pa.int64()),
            }
        )

    numbered = staged(blocks.mapInArrow(ask_words, "part int, block_id long, keys binary, counts binary").groupBy("part").applyInArrow(number_words, "block_id long, part int, words binary, tokens long, types long"), "words")
    total = numbered.agg(F.sum("tokens").alias("n"), F.sum("types").alias("v")).first()
    n_train, types = int(total.n or 0), int(total.v or 0)
    begin = ranges * step + 1
    by_block = numbered.groupBy("block_id").agg(F.array_sort(F.collect_list(F.struct("part", "words"))).alias("words"))
    known = blocks.join(by_block, "block_id")

    def words_of(rows):
        """Counts and numbers of a block's distinct tokens, in the order of their hashes."""
        pairs = [blob_columns(r["words"], 2) for r in rows]
        return np.concatenate([p[0] for p in pairs]), np.concatenate([np.where(p[1] > 0, p[1] + r["part"] * step, 0) for p, r in zip(pairs, rows)])

    # contexts are dealt by a hash of the word's number, as numbers cluster by the range of hashes
    def part_of(first):
        with np.errstate(over="ignore"):
            return (((first.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(ranges)).astype(np.int64)

    def ask_bigrams(batches):
        for batch in batches:
            for block, blob, rows in zip(*(batch.column(c).to_pylist() for c in ("block_id", "blob", "words"))):
                a, b, count, _ = _bigrams(from_blob(blob), words_of(rows)[1], begin)
                ask = np.flatnonzero(a > 0)
                part = part_of(a[ask])
                order = np.argsort(part, kind="stable")
                bounds = np.searchsorted(part[order], np.arange(ranges + 1))
                rows_ = [(i, ask[order[x:y]]) for i, (x, y) in enumerate(zip(bounds[:-1], bounds[1:])) if y > x]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([i for i, _ in rows_], pa.int32()),
                        pa.array([block] * len(rows_), pa.int64()),
                        pa.array([columns_blob([np.diff(a[own], prepend=0), b[own] // step, b[own] % step, count[own]]) for _, own in rows_], pa.binary()),
                    ],
                    ["part", "block_id", "asked"],
                )

    def answer(key, table):
        asked = []
        for blob in table.column("asked").to_pylist():
            gap, part, number, count = blob_columns(blob, 4)
            asked.append((np.cumsum(gap), part * step + number, count))
        a, b, c = (np.concatenate(x) for x in zip(*asked))
        seen = c > 0
        a, b, c = a[seen], b[seen], c[seen]
        order = np.lexsort((b, a))
        a, b, c = a[order], b[order], c[order]
        start = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))[: len(a)])
        # word numbers are sparse by part; in the trie they are ranks among those the part knows
        names = np.unique(np.concatenate((b, a)))

        def rank(x):
            at = np.searchsorted(names, x)
            return np.where(names[np.minimum(at, len(names) - 1)] == x, at, len(names)) if len(names) else np.zeros(len(x), np.int64)

        trie = Trie(rank(a[start]), rank(b[start]), np.add.reduceat(c, start) if len(start) else c)
        found, weight = trie.look_up(*(rank(np.concatenate(x)) for x in list(zip(*asked))[:2]))
        cuts_ = np.cumsum([len(x[0]) for x in asked])[:-1]
        blobs = [squeeze(f.tobytes() + w.tobytes()) for f, w in zip(np.split(found, cuts_), np.split(weight, cuts_))]
        return pa.table({"block_id": table.column("block_id"), "part": table.column("part"), "codes": pa.array(blobs, pa.binary())})

    answered = known.mapInArrow(ask_bigrams, "part int, block_id long, asked binary").groupBy("part").applyInArrow(answer, "block_id long, part int, codes binary")
    answered = answered.groupBy("block_id").agg(F.array_sort(F.collect_list(F.struct("part", "codes"))).alias("codes"))

    def finish(batches):
        for batch in batches:
            for blob, rows, codes in zip(*(batch.column(c).to_pylist() for c in ("blob", "words", "codes"))):
                own = from_blob(blob)
                _, flat, sizes = _tokens(own)
                count, number = words_of(rows)
                a, b, _, which = _bigrams(own, number, begin)
                found = np.full(len(a), 0xFFFF, np.uint16)
                weight = found.copy()
                ask = np.flatnonzero(a > 0)
                order = np.argsort(part_of(a[ask]), kind="stable")
                at = 0
                for r in codes or []:
                    values = np.frombuffer(expand(r["codes"]), np.uint16).reshape(2, -1)
                    place = ask[order[at : at + values.shape[1]]]
                    at += values.shape[1]
                    found[place], weight[place] = values
                # an unknown word after a known context backs off with that context's weight too
                context, back = np.unique(a, return_inverse=True)
                weights = np.full(len(context), 0xFFFF, np.uint16)
                np.minimum.at(weights, back, weight)
                weight = weights[back]
                smooth = (count + 1) / (n_train + types + 1)
                p = np.where(weight < 0xFFFF, np.exp(-CODE_STEP * weight), 1.0)[which] * smooth[flat]
                p += np.where(found < 0xFFFF, np.exp(-CODE_STEP * found), 0.0)[which]
                starts = np.cumsum(sizes) - sizes
                sums = [np.add.reduceat(x, starts) for x in (np.log10(smooth)[flat], np.log10(p), (count > 0).astype(np.int64)[flat])]
                ids = own.column("id")
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(~_training(ids.to_pylist())), pa.array(sizes, pa.int64()), pa.array(sums[2], pa.int64()), pa.array(np.full(len(sizes), n_train), pa.int64()), pa.array(sums[0]), pa.array(sums[1])],
                    ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    schema = "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return known.join(answered, "block_id", "left").mapInArrow(finish, schema).withColumnRenamed("id", id_col)
