"""Toxicity by class-conditional Kneser-Ney models.

Each class has an interpolated Kneser-Ney model of words as character sequences, from the start of
a word to its end. The longest context keeps counts of its class; every shorter one uses
continuation counts shared by both classes, so that a rare expression backs off to what the
classes have in common, and differs only where the evidence does. A word's log-likelihood ratio is
computed once and looked up after that.

A document compares length-normalised log-likelihoods: over the whole text, and over its most
toxic words, where a few insults in a long text would be lost in the mean. A logistic curve fitted
on the same bounded sample turns both into a score.
"""

from __future__ import annotations

import pickle
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc32_of_id, discard, kept, staged, text_chunks, trimmed

#: Labelled documents of a class that the models are fitted on, at most: the smallest hashes of doc_id.
DOCS_PER_CLASS = 2_000
ORDER = 7
DISCOUNT = 0.75
THRESHOLD = 0.3
#: A word's log ratio from which it stands out.
STANDS_OUT = 2.0
CACHE_ENTRIES = 400_000
#: Parts that a fold's texts are scored in while fitting, each in a task of its own with the model of the other fold.
SLICES = 4
#: Code points that the model reads at a time; longer words are read in pieces that share ORDER - 1 of them.
MAX_WORD = 40
#: What parts words, in Java and in RE2: white space of any kind, controls and punctuation.
PARTS = r"[\p{Z}\p{Cc}\p{P}]+"
#: ASCII symbols that aren't punctuation, dropped at the ends of words.
EDGES = "$+<=>^`|~"
#: Stands where a piece of a long word has no border: a control, so in no word.
OPEN = "\0"
_M = np.uint64(0x9E3779B97F4A7C15)


def _words(texts: pa.Array) -> pa.ListArray:
    """Lower-case words of each text; long ones in pieces."""
    lists = pc.split_pattern_regex(pc.utf8_lower(texts).cast(pa.large_string()), PARTS)
    flat = lists.flatten()
    long = pc.greater(pc.utf8_length(flat), MAX_WORD)
    if not pc.any(long).as_py():
        return lists
    at = np.flatnonzero(long.to_numpy(zero_copy_only=False))
    made = [_pieces(w) for w in flat.take(pa.array(at)).to_pylist()]
    # the places of all words, those of long ones once for each piece
    sizes = np.ones(len(flat), np.int64)
    sizes[at] = [len(x) for x in made]
    ends = np.concatenate(([0], np.cumsum(sizes)))
    source = np.repeat(np.arange(len(flat)), sizes)
    wide = np.zeros(len(flat), bool)
    wide[at] = True
    source[wide[source]] = len(flat) + np.arange(int(sizes[at].sum()))
    pool = pa.concat_arrays([flat, pa.array([p for x in made for p in x], flat.type)])
    cuts = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
    offsets = ends[np.concatenate(([0], cuts))]
    return pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), pool.take(pa.array(source)))


def _pieces(word: str) -> list[str]:
    """A word as the model reads it: a long one in pieces, each place of which is predicted in one of them and from as much as in the whole word."""
    word = word.strip(EDGES)
    if len(word) <= MAX_WORD:
        return [word]
    step = MAX_WORD - ORDER + 1
    starts = range(0, len(word) - ORDER + 1, step)
    return [OPEN * (i > 0) + word[i : i + MAX_WORD] + OPEN * (i < starts[-1]) for i in starts]


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A matrix of code points (1 begins and 2 ends a word, unless it is open there), the rows' lengths and the first place of each that is predicted."""
    cut = [w.strip(EDGES) for w in words]
    open_ = np.array([[w.startswith(OPEN), w.endswith(OPEN) and len(w) > 1] for w in cut], bool).reshape(len(cut), 2)
    cut = [w.strip(OPEN) for w in cut]
    sizes = np.fromiter(map(len, cut), np.int64, len(cut))
    begins = 1 - open_[:, 0].astype(np.int64)
    codes = np.zeros((len(cut), (int(sizes.max()) if len(cut) else 0) + 2), np.uint32)
    codes[:, 0] = 1
    flat = np.frombuffer("".join(cut).encode("utf-32-le", "surrogatepass"), "<u4")
    rows = np.repeat(np.arange(len(cut)), sizes)
    columns = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + begins[rows]
    codes[rows, columns] = flat + np.uint32(3)
    closed = np.flatnonzero(~open_[:, 1])
    codes[closed, (sizes + begins)[closed]] = 2
    return codes, sizes + begins + ~open_[:, 1], np.where(open_[:, 0], ORDER - 1, 1)


def _grams(codes: np.ndarray, position: int, size: int) -> np.ndarray:
    """A 64-bit hash of the `size` codes that end before `position`."""
    h = np.full(len(codes), np.uint64(size + 1))
    with np.errstate(over="ignore"):
        for k in range(position - size, position):
            h = (h ^ codes[:, k].astype(np.uint64)) * _M
            h ^= h >> np.uint64(29)
    return h


class _Counts:
    """Sorted keys with columns of counts."""

    def __init__(self, keys: np.ndarray, *columns: np.ndarray) -> None:
        self.keys, at = np.unique(keys, return_inverse=True)
        self.columns = [np.bincount(at, c, len(self.keys)).astype(np.float32) for c in columns]

    def add(self, keys: np.ndarray, *columns: np.ndarray) -> None:
        """Further columns, of keys that are all known."""
        at = np.searchsorted(self.keys, keys)
        self.columns += [np.bincount(at, c, len(self.keys)).astype(np.float32) for c in columns]

    def get(self, keys: np.ndarray) -> list[np.ndarray]:
        if not len(self.keys):
            return [np.zeros(len(keys)) for _ in self.columns]
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        hit = self.keys[at] == keys
        return [np.where(hit, c[at], 0.0).astype(float) for c in self.columns]


class KneserNey:
    """Word models of two classes with shared continuation counts, and the curve that turns them into a score."""

    def __init__(self, words: list[str], toxic: np.ndarray, ordinary: np.ndarray, order: int = ORDER) -> None:
        self.order = order
        codes, sizes, starts = _codes(words)
        places = [(p, np.flatnonzero((sizes > p) & (starts <= p))) for p in range(1, codes.shape[1])]

        def gather(*parts):
            """Columns over every place of every word; a few at a time, as they are what takes memory."""
            return [np.concatenate([f(p, live) for p, live in places if len(live)] or [np.zeros(0, np.uint64)]) for f in parts]

        longest = lambda p: min(p, order - 1)
        gram, context = gather(lambda p, live: _grams(codes[live], p + 1, longest(p) + 1), lambda p, live: _grams(codes[live], p, longest(p)))
        t, o = gather(lambda p, live: toxic[live], lambda p, live: ordinary[live])
        self.top = _Counts(gram, t, o)
        first = np.unique(gram, return_index=True)[1]
        #: Of each context: counts by class, then different n-grams by class.
        self.context = _Counts(context, t, o)
        del t, o
        self.context.add(context[first], *(np.minimum(c, 1) for c in self.top.get(gram[first])))
        self.shared = []
        for size in range(order - 1):
            # types of the one longer n-gram count for the shorter
            reach = [(p, live) for p, live in places if size <= longest(p)]
            gram, context, wide = (
                np.concatenate([f(p, codes[live]) for p, live in reach] or [np.zeros(0, np.uint64)])
                for f in (lambda p, own: _grams(own, p + 1, size + 1), lambda p, own: _grams(own, p, size), lambda p, own: _grams(own, p + 1, min(size + 2, p + 1)))
            )
            one = np.unique(wide ^ (gram * np.uint64(3)), return_index=True)[1]
            once = np.unique(gram, return_index=True)[1]
            del wide
            contexts = _Counts(context[one], np.ones(len(one), np.float32))
            contexts.add(context[once], np.ones(len(once), np.float32))
            self.shared.append((_Counts(gram[one], np.ones(len(one), np.float32)), contexts))
        self.alphabet = max(256, len(np.unique(codes)))
        self.curve = np.zeros(4)

    def _backoff(self, own: np.ndarray, p: int, longest: int) -> np.ndarray:
        value = np.full(len(own), 1.0 / self.alphabet)
        for size in range(min(longest, len(self.shared))):
            count, contexts = self.shared[size]
            (c,), (t, n) = count.get(_grams(own, p + 1, size + 1)), contexts.get(_grams(own, p, size))
            safe = np.maximum(t, 1)
            value = np.where(t > 0, np.maximum(c - DISCOUNT, 0) / safe + DISCOUNT * n / safe * value, value)
        return value

    def ratios(self, words: list[str]) -> np.ndarray:
        """log P(word | toxic) - log P(word | ordinary) of each word."""
        if not words or not len(self.top.keys):
            return np.zeros(len(words))
        codes, sizes, starts = _codes(words)
        out = np.zeros(len(words))
        for p in range(1, codes.shape[1]):
            live = np.flatnonzero((sizes > p) & (starts <= p))
            if not len(live):
                continue
            own = codes[live]
            longest = min(p, self.order - 1)
            shared = self._backoff(own, p, longest)
            logs, contexts = [], self.context.get(_grams(own, p, longest))
            for c, t, n in zip(self.top.get(_grams(own, p + 1, longest + 1)), contexts[:2], contexts[2:]):
                safe = np.maximum(t, 1)
                logs.append(np.log(np.where(t > 0, np.maximum(c - DISCOUNT, 0) / safe + np.minimum(DISCOUNT * n, t) / safe * shared, shared)))
            out[live] += logs[0] - logs[1]
        return out

    def evidence(self, ratios: list[np.ndarray]) -> np.ndarray:
        """Per document: the mean ratio of its words; of its three most toxic words, repeats apart; and the log of how many words stand out."""
        rows = np.zeros((len(ratios), 3))
        for i, r in enumerate(ratios):
            if len(r):
                rows[i] = r.mean(), np.unique(r)[-3:].sum() / 3, np.log1p((r > STANDS_OUT).sum()) - 0.3 * np.log1p(len(r))
        return rows

    def scores(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.curve[0] + evidence @ self.curve[1:], -30, 30)))

    def fit_curve(self, evidence: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> None:
        """Weighted logistic regression by Newton steps with a small ridge."""
        x = np.column_stack((np.ones(len(labels)), evidence))
        w = np.zeros(x.shape[1])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            g = x.T @ (weights * (labels - p)) - 1e-2 * w
            h = (x * (weights * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + 1e-2 * np.eye(x.shape[1])
            step = np.clip(np.linalg.solve(h, g), -2, 2)
            w += step
            if np.abs(step).max() < 1e-6:
                break
        self.curve = w


class _Lookup(dict):
    """Ratios of words seen so far; the unknown ones of a chunk are scored together. Bounded."""

    def rows(self, model: KneserNey, texts: pa.Array) -> list[np.ndarray]:
        lists = _words(texts)
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        new = [w for w in words if w not in self]
        if len(self) + len(new) > CACHE_ENTRIES:
            self.clear()
            new = words
        for i in range(0, len(new), 50_000):
            part = new[i : i + 50_000]
            self.update(zip(part, model.ratios(part).tolist()))
        table = np.fromiter(map(self.__getitem__, words), float, len(words))
        empty = np.fromiter((not w for w in words), bool, len(words))
        codes = coded.indices.to_numpy()
        cuts = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
        out, a = [], 0
        for b in cuts.tolist():
            own = codes[a:b]
            out.append(table[own[~empty[own]]] if len(own) else table[:0])
            a = b
        return out


def _models(rows: DataFrame) -> DataFrame:
    """(turn, model): of fold 1, of fold 0 and of both, from rows of a word and its counts n00, n01, n10, n11 by class and fold.

    The counts of a bounded sample are bounded; one task makes the models, and the driver fetches
    the last one only.
    """

    def make(batches):
        table = pa.Table.from_batches([pa.RecordBatch.from_arrays(b.columns, schema=schema) for b in batches], schema=schema).sort_by("w")
        words, counts = table.column("w").to_pylist(), {c: table.column(c).to_numpy().astype(float) for c in schema.names[1:]}
        pieces = [_pieces(w) if len(w) > MAX_WORD else [w] for w in words]
        at = np.repeat(np.arange(len(words)), [len(p) for p in pieces])
        words, keep = [p for x in pieces for p in x], np.array([bool(p) for x in pieces for p in x], bool)
        words, at = [w for w in words if w], at[keep]
        del table, pieces, keep
        for turn, folds in enumerate(((1,), (0,), (0, 1))):
            o, t = (sum(counts[f"n{y}{f}"][at] for f in folds) for y in (0, 1))
            some = np.flatnonzero(o + t > 0)
            made = KneserNey([words[i] for i in some], t[some].astype(np.float32), o[some].astype(np.float32))
            yield pa.RecordBatch.from_arrays([pa.array([turn], pa.int32()), pa.array([pickle.dumps(made)], pa.binary())], ["turn", "model"])

    schema = pa.schema([("w", pa.string()), *((f"n{y}{f}", pa.int64()) for y in (0, 1) for f in (0, 1))])
    return staged(rows.select(*schema.names).repartition(1).mapInArrow(trimmed(make), "turn int, model binary"), "models")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", docs_per_class: int = DOCS_PER_CLASS) -> KneserNey:
    """The models of a bounded sample of labelled rows: at most docs_per_class of each class, smallest hash of the id first.

    Rows without an id or with a null label are left out; an id labelled twice counts as toxic if
    any label says so. What reaches the driver is the sample's word counts and the texts' evidence,
    both bounded by it. Without both classes every score is the share of toxic labels, or 0.
    """
    marks = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y is not null").groupBy("id").agg(F.max("y").alias("y"))
    marks = marks.join(docs.select(F.col(id_col).cast("long").alias("id")).distinct(), "id", "left_semi")
    totals = {int(r.y): r["count"] for r in marks.groupBy("y").count().collect()}
    chosen = None
    for y in (0, 1):
        own = marks.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(docs_per_class)
        chosen = own if chosen is None else chosen.unionByName(own)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    # one text per id, without a key's rows all meeting: the sample's ids are few and unique
    sample = staged(texts.join(chosen, "id").groupBy("id", "y").agg(F.min("text").alias("text")).withColumn("fold", F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(2)).cast("int")), "sample")
    words = F.explode(F.split(F.lower("text"), PARTS)).alias("w")
    strip = F.regexp_replace("w", r"^[$+<=>^`|~]+|[$+<=>^`|~]+$", "")
    of = [F.count_if((F.col("y") == y) & (F.col("fold") == f)).alias(f"n{y}{f}") for y in (0, 1) for f in (0, 1)]
    rows = sample.select("y", "fold", words).select("y", "fold", strip.alias("w")).where("w <> ''").groupBy("w").agg(*of)
    known, n = set(totals), {y: min(totals.get(y, 0), docs_per_class) for y in (0, 1)}
    seen = None
    if known >= {0, 1}:
        models = _models(rows)

        def evidence(key, texts, own):
            """Of the sample's texts of a fold, from the model of the other one, that has not seen them."""
            if not texts.num_rows or not own.num_rows:
                return schema.empty_table()
            model, look = pickle.loads(own.column("model")[0].as_py()), _Lookup()
            parts = []
            for batch in text_chunks(texts.to_batches()):
                e = model.evidence(look.rows(model, batch.column("text")))
                parts.append(pa.RecordBatch.from_arrays([batch.column("y"), *(pa.array(c) for c in e.T)], schema=schema))
            return pa.Table.from_batches(parts)

        schema = pa.schema([("y", pa.int32()), ("mean", pa.float64()), ("top", pa.float64()), ("share", pa.float64())])
        part = F.pmod(F.xxhash64(F.lit(2), "id"), F.lit(SLICES)).cast("int").alias("slice")
        sent = models.where("turn < 2").withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))))
        each = sample.select("y", "fold", part, "text").groupBy("fold", "slice").cogroup(sent.groupBy("turn", "slice"))
        seen = each.applyInArrow(evidence, "y int, mean double, top double, share double").toPandas()
        model = pickle.loads(models.where("turn = 2").select("model").first().model)
        discard(models)
    else:
        model = KneserNey([], np.zeros(0), np.zeros(0))
    discard(sample)
    if seen is not None:
        y = seen.y.to_numpy(float)
        # the sample has its own share of toxic rows; weights restore the labels'
        model.fit_curve(seen[["mean", "top", "share"]].to_numpy(), y, np.where(y == 1, totals[1] / n[1], totals[0] / n[0]))
    else:
        model.curve = np.array([30.0 if known == {1} else -30.0, 0.0, 0.0, 0.0])
    return model


def score(docs: DataFrame, model: KneserNey, id_col: str = "doc_id", text_col: str = "text", columns: list[str] | None = None, score_col: str = "score") -> DataFrame:
    """The named columns of docs (the id alone by default) with score_col added, a name that none of them has; text alone decides it.

    Null and wordless texts get the curve's value for no evidence. Every row is kept.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    name = uuid.uuid4().hex
    columns = [id_col] if columns is None else columns
    frame = docs.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(columns)), F.col(text_col).alias("text"))

    def run(batches):
        look = kept(("toxicity", name), _Lookup)
        for batch in text_chunks(batches):
            s = shared.value.scores(shared.value.evidence(look.rows(shared.value, batch.column("text"))))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(s)], [*batch.schema.names[:-1], "score"])

    schema = ", ".join(f"c{i} {frame.schema[i].dataType.simpleString()}" for i in range(len(columns)))
    return frame.mapInArrow(trimmed(run), f"{schema}, score double").toDF(*columns, score_col)


def train_rows(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return docs.where(crc32_of_id(id_col) % 4 != 2)


def op10_toxicity(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = fit(train_rows(docs), train_rows(labels))
    return score(docs, model).select(
        "doc_id", (crc32_of_id() % 4 == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
