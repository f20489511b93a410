import math
import re
import zlib
from collections import Counter

import numpy as np

from tidemark.llm import ngram_trie as lm

SCHEMA = "doc_id long, text string, score string, id string"


def brute(rows):
    docs = []
    for d, t in rows:
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        docs.append((d, re.findall(r"[^\x20\x09-\x0D]+", lowered) + [None], zlib.crc32(str("" if d is None else d).encode()) % 7 == 2))
    uni, pair, total, kinds = Counter(), Counter(), Counter(), Counter()
    for _, words, held in docs:
        if not held:
            uni.update(words)
            pair.update(zip(["<s>", *words], words))
    for (a, _), c in pair.items():
        total[a] += c
        kinds[a] += 1
    n, v = sum(uni.values()), len(uni)
    out = []
    for d, words, held in docs:
        base = full = 0.0
        for a, w in zip(["<s>", *words], words):
            base += math.log10((uni[w] + 1) / (n + 1 * (v + 1)))
            smooth = (uni[w] + 1) / (n + v + 1)
            p = smooth if not total[a] else (max(pair[a, w] - lm.DISCOUNT, 0) + lm.DISCOUNT * kinds[a] * smooth) / total[a]
            full += math.log10(p)
        out.append((d, held, len(words), sum(uni[w] > 0 for w in words), n, base, full))
    return sorted(out, key=str)


def check(got, want):
    got = sorted((tuple(r) for r in got), key=str)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for a, b in zip(got, want):
        assert abs(a[5] - b[5]) <= 1e-9 * abs(b[5])
        assert abs(a[6] - b[6]) <= 5e-4 * b[2]


def test_documents_match_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(3)
    rows = lm.score(docs).collect()
    check(rows, brute([(r.doc_id, r.text) for r in docs.collect()]))
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_edges(spark):
    rows = [(1, None), (2, ""), (None, "A a b"), (3, "a B \x1c é"), (3, "a B \x1c é"), (5, "x " * 9000), (9, "é b a"), (12, "unseen words")]
    docs = spark.createDataFrame([(d, t, "x", "y") for d, t in rows], SCHEMA).repartition(3)
    check(lm.score(docs).collect(), brute(rows))
    held = [r for r in rows if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 2]
    only = [(i, f"w{i}") for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 2] + held
    check(lm.score(spark.createDataFrame([(d, t, "x", "y") for d, t in only], SCHEMA)).collect(), brute(only))
    assert lm.score(docs.limit(0)).collect() == []


def test_elias_fano_holds_any_monotone_sequence(monkeypatch):
    monkeypatch.setattr(lm, "SEGMENT", 100)
    rng = np.random.default_rng(0)
    for top in (1, 3, 1000, 1 << 40):
        values = np.sort(rng.integers(0, top, 1500))
        parts, shift = lm.EliasFano.parts(values)
        own = lm.EliasFano(*parts, len(values), shift)
        assert (own.decode(0, 1500) == values).all() and (own.decode(513, 777) == values[513:777]).all()
        ask = np.sort(np.concatenate((rng.integers(0, top + 2, 400), values[:50])))
        place, hit = own.find(ask)
        assert (place == np.searchsorted(values, ask)).all() and (hit == np.isin(ask, values)).all()
        assert (own.select(np.arange(0, 1500, 7)) == values[::7]).all()
