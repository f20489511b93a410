"""Exact substring deduplication by a distributed, common-prefix-aware merge sort of suffixes.

A byte goes if a string of `width` bytes that covers it also starts in a document with a smaller
id. Sorting every suffix would move many times the text, so only suffixes at anchors are sorted:
the anchor of a window of `width` bytes is its 16-byte substring with the smallest hash, which
equal windows share wherever they are. Consecutive windows with one anchor make one context: what
lies right of the anchor's start is the suffix, what lies left of it is compared backwards.

1. Anchors that occur in one document only are dropped (`blocks.recurring`, a bit per anchor).
2. Each block sorts its distinct contexts and sends front-coded runs, each row as the length of
   the prefix shared with the row before and the rest, to the task that owns a range of suffixes.
3. There a loser tree merges the runs. Every loser keeps its common prefix with the last winner;
   of two rows the one that shares more comes first, and bytes are looked at only beyond an equal
   prefix. The merge so yields the suffix array with its common-prefix lengths.
4. Those lengths number the classes of equal right parts of every length, and the same over the
   reversed left parts; a pair of classes is a string, whose smallest document id is its owner.
   The owners go back to the blocks, which mark the bytes of every later occurrence.

A context is one row per block, however many documents of the block hold it, and its occurrences
never leave the block: a passage in a third of all documents costs one row per block.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import RANGES, build, expand, from_blob, marked, recurring, squeeze
from .common import partitions

WIDTH = 50
GRAM = 16
SLICE = 1 << 20
NONE = np.iinfo(np.int64).max
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def text_bytes(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of a block's texts end to end, where each starts (and the last ends), and the ids; rows without an id get -1 and never match."""
    texts = batch.column("text").cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(texts) else np.zeros(0, np.uint8)
    ids = batch.column("id")
    return data, offsets - offsets[0], ids


def anchors(data: np.ndarray, starts: np.ndarray, usable: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """(first window, last window, anchor, document, hash of the anchor's bytes) of each run of windows with one anchor."""
    span = width - GRAM + 1
    found = []
    n = len(data)
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    last_start = np.full(len(starts) - 1, -1, np.int64)
    last_start[usable] = starts[1:][usable] - width
    for base in range(0, max(n - width + 1, 0), SLICE):
        stop = min(base + SLICE, n - width + 1)  # windows [base, stop)
        part = padded[base : stop + width - 1 + 8]
        words = np.ndarray((len(part) - 7,), "<u8", part.tobytes(), strides=(1,))
        grams = stop - base + span - 1
        with np.errstate(over="ignore"):
            h = (words[:grams] * _M1) ^ ((words[8 : 8 + grams] + _M3) * _M2)
            h ^= h >> np.uint64(31)
            h *= _M3
            h ^= h >> np.uint64(29)
        least = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(grams, dtype=np.uint64)
        reach = 1
        while 2 * reach <= span:
            least = np.minimum(least[:-reach], least[reach:])
            reach *= 2
        if reach < span:
            least = np.minimum(least[: len(least) - (span - reach)], least[span - reach :])
        at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
        window = np.arange(base, stop)
        doc = np.searchsorted(starts, window, side="right") - 1
        valid = window <= last_start[doc]
        new = valid.copy()
        new[1:] &= ~valid[:-1] | (at[1:] != at[:-1])
        first = np.flatnonzero(new)
        # a run ends where the next begins or the windows become invalid
        ends = valid.copy()
        ends[:-1] &= ~valid[1:] | (at[1:] != at[:-1])
        final = np.flatnonzero(ends)
        found.append((first + base, final + base, at[first] + base, doc[first], h[at[first]]))
    if not found:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64))
    return tuple(np.concatenate(x) for x in zip(*found))


def contexts(data: np.ndarray, first: np.ndarray, last: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """A fixed-length row for each: the right part, the left part reversed (both zero-filled), and their lengths."""
    left = width - GRAM
    size = width + left + 2
    rows = np.zeros((len(at), size), np.uint8)
    right_len, left_len = last + width - at, at - first
    k = np.arange(width)
    rows[:, :width] = np.where(k < right_len[:, None], data[np.minimum(at[:, None] + k, len(data) - 1)], 0)
    k = np.arange(left)
    rows[:, width : width + left] = np.where(k < left_len[:, None], data[np.maximum(at[:, None] - 1 - k, 0)], 0)
    rows[:, -2], rows[:, -1] = right_len, left_len + 1
    return rows


def distinct_contexts(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct rows, and which of them each row is."""
    if not len(rows):
        return rows, np.zeros(0, np.int64)
    unique, which = np.unique(rows.view(f"S{rows.shape[1]}").ravel(), return_inverse=True)
    return unique.view(np.uint8).reshape(len(unique), rows.shape[1]), which


def shared_prefix(rows: np.ndarray) -> np.ndarray:
    """Each row's common prefix with the row before it; 0 for the first."""
    out = np.zeros(len(rows), np.int64)
    if len(rows) > 1:
        differ = rows[1:] != rows[:-1]
        out[1:] = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
    return out


def front_code(rows: np.ndarray, low: np.ndarray, high: np.ndarray) -> bytes:
    """A sorted run: common prefixes, the bytes beyond them, and the smallest and largest owner of each row."""
    shared = shared_prefix(rows)
    rest = rows[np.arange(rows.shape[1]) >= shared[:, None]]
    head = np.array([len(rows), rows.shape[1]], "<i8").tobytes()
    return squeeze(head + shared.astype(np.uint8).tobytes() + low.astype("<i8").tobytes() + high.astype("<i8").tobytes() + rest.tobytes())


def front_decode(blob: bytes) -> tuple[list[bytes], list[int], np.ndarray, np.ndarray]:
    raw = expand(blob)
    n, size = np.frombuffer(raw, "<i8", 2).tolist()
    shared = np.frombuffer(raw, np.uint8, n, 16).tolist()
    low, high = (np.frombuffer(raw, "<i8", n, 16 + n + 8 * n * k) for k in (0, 1))
    rows, at, row = [], 16 + 17 * n, b""
    for s in shared:
        row = row[:s] + raw[at : at + size - s]
        at += size - s
        rows.append(row)
    return rows, shared, low, high


def merge_runs(runs: list[list[bytes]], shared: list[list[int]]) -> tuple[list[int], list[int]]:
    """Merges sorted runs with a loser tree over (row, common prefix with the last winner).

    Returns the run that each place of the merged sequence comes from, and each row's common
    prefix with the row before it. shared are the common prefixes inside the runs.
    """
    k = 1
    while k < len(runs):
        k *= 2
    size = len(next((r[0] for r in runs if r), b""))
    positions = [0] * k
    heads: list[bytes | None] = [r[0] if r else None for r in runs] + [None] * (k - len(runs))
    known = [0] * k  # common prefix of each head with the last winner
    losers = [0] * k

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser) of two heads; the loser's known prefix becomes that with the winner."""
        x, y = heads[a], heads[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        p, q = known[a], known[b]
        if p != q:
            return (a, b) if p > q else (b, a)
        differ = int.from_bytes(x[p:], "big") - (u := int.from_bytes(y[p:], "big"))
        if not differ:
            known[b] = size
            return a, b
        p = size - ((u ^ (u + differ)).bit_length() + 7) // 8
        if differ < 0:
            known[b] = p
            return a, b
        known[a] = p
        return b, a

    winners = [*([0] * k), *range(k)]
    for node in range(k - 1, 0, -1):
        winners[node], losers[node] = play(winners[2 * node], winners[2 * node + 1])
    champion = winners[1] if k > 1 else 0
    order, prefixes = [], []
    while heads[champion] is not None:
        order.append(champion)
        prefixes.append(known[champion])
        at = positions[champion] = positions[champion] + 1
        if at < len(runs[champion]):
            heads[champion], known[champion] = runs[champion][at], shared[champion][at]
        else:
            heads[champion] = None
        node = (champion + k) // 2
        while node:
            champion, losers[node] = play(champion, losers[node])
            node //= 2
    return order, prefixes


def owners(rows: np.ndarray, shared: np.ndarray, low: np.ndarray, width: int) -> np.ndarray:
    """For each context and number of left bytes, the smallest document of that window; NONE where it has no such window.

    rows are sorted and distinct, shared their common prefixes, low the smallest document of each.
    """
    left = width - GRAM
    n = len(rows)
    right_len, left_len = rows[:, -2].astype(np.int64), rows[:, -1].astype(np.int64) - 1
    back = np.ascontiguousarray(rows[:, width : width + left])
    order = np.argsort(back.view(f"S{left}").ravel(), kind="stable")
    back_shared = shared_prefix(back[order])
    out = np.full((n, left + 1), NONE, np.int64)
    for k in range(left + 1):
        live = np.flatnonzero((right_len >= width - k) & (left_len >= k))
        if not len(live):
            continue
        kind = np.empty(n, np.int64)
        kind[order] = np.cumsum(back_shared < k)
        key = np.cumsum(shared < width - k)[live] * np.int64(n + 1) + kind[live]
        by = np.argsort(key, kind="stable")
        s = key[by]
        start = np.concatenate(([True], s[1:] != s[:-1]))
        least = np.minimum.reduceat(low[live][by], np.flatnonzero(start))
        out[live[by], k] = least[np.cumsum(start) - 1]
    return out


def _runs_of_equal(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, first column, last column, value) of each stretch of one value, other than NONE, along rows."""
    edge = np.ones(values.shape, bool)
    edge[:, 1:] = values[:, 1:] != values[:, :-1]
    row, column = np.nonzero(edge)
    stop = np.append(column[1:], values.shape[1])
    stop[np.append(row[1:] != row[:-1], True)] = values.shape[1]
    value = values[row, column]
    keep = value != NONE
    return row[keep], column[keep], stop[keep] - 1, value[keep]


def _splitters(blocks: DataFrame, ranges: int) -> np.ndarray:
    """Bounds of the suffix ranges, from 200 places of every block; what reaches the driver is one number a range."""

    def probe(batches):
        for batch in batches:
            for blob in batch.column("blob"):
                data = text_bytes(from_blob(blob.as_py()))[0]
                if len(data) >= 8:
                    at = np.linspace(0, len(data) - 8, 200).astype(np.int64)
                    heads = np.ascontiguousarray(data[at[:, None] + np.arange(8)]).view(">u8").ravel()
                    yield pa.RecordBatch.from_arrays([pa.array((heads >> np.uint64(1)).astype(np.int64))], ["p"])

    if ranges < 2:
        return np.zeros(0, np.uint64)
    shares = F.array(*(F.lit(i / ranges) for i in range(1, ranges)))
    found = blocks.select("blob").mapInArrow(probe, "p long").agg(F.percentile_approx("p", shares, F.lit(10_000)).alias("p")).first().p
    return np.array(sorted(set(found or [])), np.uint64) << np.uint64(1)


def marks_of(docs: DataFrame, columns: list[str], id_col: str, text_col: str, width: int, finish, schema: str) -> DataFrame:
    """Runs the four steps and hands (block, data, starts, removed mask) of every block to finish."""
    spark = docs.sparkSession
    names = {"id": id_col, "text": text_col} | {f"c{i}": c for i, c in enumerate(columns)}
    blocks = build(docs.withColumn(id_col, F.col(id_col).cast("long")), names)

    def located(batch):
        data, starts, ids = text_bytes(batch)
        usable = ids.is_valid().to_numpy(zero_copy_only=False)
        return data, starts, ids.fill_null(0).to_numpy(zero_copy_only=False), anchors(data, starts, usable, width)

    def keys(batch):
        *_, (_, _, _, doc, key) = located(batch)
        return key, doc

    marks = recurring(blocks, keys)
    cuts = _splitters(blocks, RANGES * partitions(spark))

    def recurring_contexts(blob, bits):
        batch = from_blob(blob)
        data, starts, ids, (first, last, at, doc, key) = located(batch)
        keep = marked(key, bits)
        first, last, at, doc = first[keep], last[keep], at[keep], doc[keep]
        unique, which = distinct_contexts(contexts(data, first, last, at, width))
        return batch, data, starts, ids[doc], at, unique, which

    def send(batches):
        for batch in batches:
            for block, blob, bits in zip(*(batch.column(c).to_pylist() for c in ("block_id", "blob", "marks"))):
                _, _, _, doc, _, unique, which = recurring_contexts(blob, bits)
                if not len(unique):
                    continue
                low, high = np.full(len(unique), NONE), np.full(len(unique), -NONE - 1)
                np.minimum.at(low, which, doc)
                np.maximum.at(high, which, doc)
                heads = np.ascontiguousarray(unique[:, :8]).view(">u8").ravel()
                bounds = [0, *np.searchsorted(heads, cuts).tolist(), len(unique)]
                parts = [(i, a, b) for i, (a, b) in enumerate(zip(bounds, bounds[1:])) if b > a]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([i for i, _, _ in parts], pa.int32()),
                        pa.array([block] * len(parts), pa.int64()),
                        pa.array([a for _, a, _ in parts], pa.int64()),
                        pa.array([front_code(unique[a:b], low[a:b], high[a:b]) for _, a, b in parts], pa.binary()),
                    ],
                    ["part", "block_id", "start", "run"],
                )

    def combine(key, table):
        blocks_, starts, runs = (table.column(c).to_pylist() for c in ("block_id", "start", "run"))
        decoded = [front_decode(r) for r in runs]
        order, prefix = merge_runs([d[0] for d in decoded], [d[1] for d in decoded])
        run, prefix = np.array(order), np.array(prefix)
        sizes = np.array([len(d[0]) for d in decoded])
        base = np.cumsum(sizes) - sizes
        # the place of each merged row in its run, as runs are taken in order
        place = np.empty(len(run), np.int64)
        by_run = np.argsort(run, kind="stable")
        place[by_run] = np.arange(len(run)) - np.repeat(base, sizes)
        flat = base[run] + place
        low, high = (np.concatenate([d[k] for d in decoded])[flat] for k in (2, 3))
        size = len(decoded[0][0][0])
        matrix = np.frombuffer(b"".join(b"".join(d[0]) for d in decoded), np.uint8).reshape(-1, size)
        answers = []
        # pieces that part between anchors, so that a piece has every context of its anchors
        splits = np.flatnonzero(prefix < GRAM)
        a = 0
        while a < len(run):
            nxt = splits[np.searchsorted(splits, a + 40_000) :][:1]
            b = int(nxt[0]) if len(nxt) else len(run)
            rows, shared = matrix[flat[a:b]], prefix[a:b].copy()
            shared[0] = 0
            new = shared < size
            kind = np.cumsum(new) - 1
            once = np.flatnonzero(new)
            own = owners(rows[once], shared[once], np.minimum.reduceat(low[a:b], once), width)[kind]
            own[own >= high[a:b, None]] = NONE  # no later occurrence here
            row, k0, k1, value = _runs_of_equal(own)
            answers.append((run[a:b][row], place[a:b][row], k0, k1, value))
            a = b
        run_, place_, k0, k1, value = (np.concatenate(x) for x in zip(*answers))
        order = np.argsort(run_, kind="stable")
        cut = np.searchsorted(run_[order], np.arange(len(runs) + 1))
        out = []
        for i in range(len(runs)):
            own = order[cut[i] : cut[i + 1]]
            out.append(squeeze(b"".join(x.tobytes() for x in ((place_[own] + starts[i]).astype("<i8"), k0[own].astype("<i8"), k1[own].astype("<i8"), value[own].astype("<i8")))))
        return pa.table({"block_id": pa.array(blocks_, pa.int64()), "verdict": pa.array(out, pa.binary())})

    def apply(batches):
        for batch in batches:
            for blob, bits, verdicts in zip(*(batch.column(c).to_pylist() for c in ("blob", "marks", "verdicts"))):
                if not bits:
                    block = from_blob(blob)
                    data, starts, _ = text_bytes(block)
                    yield from finish(block, data, starts, np.zeros(len(data), bool))
                    continue
                block, data, starts, doc, at, unique, which = recurring_contexts(blob, bits)
                change = np.zeros(len(data) + 1, np.int32)
                by = np.argsort(which, kind="stable")
                edge = np.searchsorted(which[by], np.arange(len(unique) + 1))
                for verdict in verdicts or []:
                    context, k0, k1, owner = np.frombuffer(expand(verdict), "<i8").reshape(4, -1)
                    times = edge[context + 1] - edge[context]
                    rank = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                    where = by[np.repeat(edge[context], times) + rank]
                    late = doc[where] > np.repeat(owner, times)
                    spot = at[where][late]
                    np.add.at(change, spot - np.repeat(k1, times)[late], 1)
                    np.add.at(change, spot - np.repeat(k0, times)[late] + width, -1)
                yield from finish(block, data, starts, np.cumsum(change[:-1]) > 0)

    with_marks = blocks.join(marks, "block_id", "left")
    sent = with_marks.where("marks is not null").mapInArrow(send, "part int, block_id long, start long, run binary")
    told = sent.groupBy("part").applyInArrow(combine, "block_id long, verdict binary").groupBy("block_id").agg(F.collect_list("verdict").alias("verdicts"))
    return with_marks.join(told, "block_id", "left").mapInArrow(apply, schema)


def removed_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """(id_col, n_bytes, n_removed, n_spans, kept_sha256) of every row.

    Null texts count as empty. A row whose id is null has no place in the order of documents: it
    neither loses bytes nor makes others lose any. Rows that repeat an id are judged each by
    itself, as equal ids aren't smaller. An empty table gives none. Only the two columns named are read.
    """

    def finish(block, data, starts, gone):
        out = []
        for i, (a, b) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist())):
            own = gone[a:b]
            n = int(own.sum())
            spans = int(own[0]) + int((own[1:] & ~own[:-1]).sum()) if n else 0
            kept = data[a:b][~own] if n else data[a:b]
            out.append((b - a, n, spans, hashlib.sha256(kept.tobytes()).hexdigest()))
        columns = list(zip(*out)) or [[], [], [], []]
        yield pa.RecordBatch.from_arrays([block.column("id"), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return marks_of(docs, [], id_col, text_col, width, finish, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string").withColumnRenamed("id", id_col)


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """docs with repeated passages removed from the text, and n_chars, if there, set anew; other columns as they were.

    Cases as in `removed_spans`. A character of which only some bytes go is dropped whole.
    """
    others = [c for c in docs.columns if c not in (id_col, text_col)]

    def finish(block, data, starts, gone):
        texts = [data[a:b][~gone[a:b]].tobytes().decode("utf-8", "ignore") for a, b in zip(starts[:-1].tolist(), starts[1:].tolist())]
        null = block.column("text").is_null().to_pylist()
        texts = [None if n else t for t, n in zip(texts, null)]
        yield pa.RecordBatch.from_arrays([block.column("id"), pa.array(texts, pa.string()), *(block.column(f"c{i}") for i in range(len(others)))], ["id", "text", *(f"c{i}" for i in range(len(others)))])

    schema = ", ".join(["id long", "text string", *(f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(others))])
    out = marks_of(docs, others, id_col, text_col, width, finish, schema).toDF(id_col, text_col, *others)
    if "n_chars" in others:
        out = out.withColumn("n_chars", F.length(text_col).cast(docs.schema["n_chars"].dataType))
    return out.select(F.col(id_col).cast(docs.schema[id_col].dataType), *docs.columns[1:]) if docs.columns[0] == id_col else out.select(*docs.columns)
