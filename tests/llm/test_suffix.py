import hashlib
import random

import numpy as np

from tidemark.llm import suffix_dedup as sd

SCHEMA = "doc_id long, text string, n_bytes string, id string"


def brute(rows, width=50):
    least, out = {}, []
    data = [(d, (t or "").encode()) for d, t in rows]
    for d, b in data:
        if d is not None:
            for i in range(len(b) - width + 1):
                s = b[i : i + width]
                least[s] = min(d, least.get(s, d))
    for d, b in data:
        gone = np.zeros(len(b) + 1, bool)
        if d is not None:
            for i in range(len(b) - width + 1):
                if least[b[i : i + width]] < d:
                    gone[i : i + width] = True
        own = gone[: len(b)]
        spans = int((np.diff(np.concatenate(([False], own, [False])).astype(int)) == 1).sum())
        out.append((d, len(b), int(own.sum()), spans, hashlib.sha256(bytes(x for x, g in zip(b, own) if not g)).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_documents_match_brute_force(spark, sf, monkeypatch):
    monkeypatch.setattr(sd, "SLICE", 5000)
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(5)
    out = got(sd.removed_spans(docs))
    assert sum(r[2] for r in out) > 1000
    assert out == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_edges(spark):
    rng = random.Random(0)
    make = lambda n: "".join(rng.choices("abcdefgh \n", k=n))
    a, b, c = make(300), make(49), make(50)
    rows = [(1, a), (2, a), (2, a), (3, a[:150] + b + a[100:]), (4, b), (5, b + b), (6, c), (7, "é" + c + "ß"), (8, None), (9, ""), (None, a), (10, "z" * 400), (11, "z" * 120 + a[:60]), (12, "ab" * 100), (13, "ab" * 60), (14, "\0" * 90), (15, "\0" * 70), (0, a[200:290] + make(20)), (16, make(60000) + c)]
    docs = spark.createDataFrame([(d, t, "x", "y") for d, t in rows], SCHEMA).repartition(4)
    assert got(sd.removed_spans(docs)) == brute(rows)
    text = {r.doc_id: r.text for r in sd.deduplicated(docs.where("doc_id in (6, 7, 8)")).collect()}
    assert text == {6: c, 7: "éß", 8: None}
    assert sd.deduplicated(docs).columns == docs.columns and sd.deduplicated(docs).count() == len(rows)
    assert got(sd.removed_spans(docs.limit(0))) == []


def test_merge_gives_sorted_rows_and_their_common_prefixes():
    rng = random.Random(4)
    runs = [sorted(bytes(rng.choices(b"ab", k=6)) for _ in range(rng.randrange(20))) for _ in range(5)] + [[]]
    common = lambda x, y: next((i for i in range(6) if x[i] != y[i]), 6)
    order, prefix = sd.merge_runs(runs, [[0, *(common(x, y) for x, y in zip(r, r[1:]))] if r else [] for r in runs])
    at, rows = [0] * 6, []
    for r in order:
        rows.append(runs[r][at[r]])
        at[r] += 1
    assert rows == sorted(x for r in runs for x in r)
    assert prefix[1:] == [common(x, y) for x, y in zip(rows, rows[1:])]
