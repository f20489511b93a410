import math
import random

from tidemark.llm import topk_pivot as tp

SCHEMA = "vec_id long, embedding array<float>, v string, id string, rank int"


def brute(rows, k=20, every=20):
    data = []
    for i, x in rows:
        if i is None or not x or any(c is None or not math.isfinite(c) for c in x):
            continue
        data.append((i, [math.floor(64 * c) for c in x]))
    out = []
    for a, (q, x) in enumerate(data):
        if q % every == 0:
            scores = sorted(((-sum(p * r for p, r in zip(x, y)), i) for b, (i, y) in enumerate(data) if b != a))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    return sorted(out)


def run(spark, df, **more):
    return sorted(tuple(r) for r in tp.top_k(df, lambda i: i % 20 == 0, **more).collect())


def test_embeddings_match_brute_force(spark, sf, monkeypatch):
    monkeypatch.setattr(tp, "CHUNK", 60)
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    assert run(spark, df) == brute([(r.vec_id, list(r.embedding)) for r in df.collect()])


def test_edges(spark):
    rng = random.Random(0)
    rows = [(i, [rng.uniform(-2, 2) for _ in range(5)]) for i in range(90)]
    rows += [(200 + i, [1.0] * 5) for i in range(60)] + [(220, [1.0] * 5)] * 3
    rows += [(300, None), (320, []), (340, [1.0, None, 0.0, 0.0, 0.0]), (360, [float("nan")] * 5), (380, [float("inf")] * 5), (None, [9.0] * 5), (400, [5.0, -3.0]), (401, [0.0] * 5)]
    rows = [(i, None if x is None else [None if c is None else float(__import__("numpy").float32(c)) for c in x]) for i, x in rows]
    df = spark.createDataFrame([(i, x, "a", "b", 1) for i, x in rows], SCHEMA)
    assert run(spark, df) == brute(rows)
    assert run(spark, df.where("vec_id in (0, 1, 2)")) == brute([r for r in rows if r[0] in (0, 1, 2)])
    assert run(spark, df.limit(0)) == []


def test_repeated_ids_and_large_values(spark):
    rows = [(0, [1.0, 2.0]), (1, [1.0, 1.0]), (1, [1.0, 1.0]), (1, [3.0, -1.0]), (20, [0.5, 0.5]), (20, [2.0, 0.0]), (2, [2.0**20, -(2.0**20)])]
    df = lambda r: spark.createDataFrame([(i, x, "", "", 0) for i, x in r], SCHEMA.replace("float", "double"))
    assert run(spark, df(rows)) == brute(rows)
    assert [r[2] for r in run(spark, df(rows[:3]))] == [1, 1]  # rows of one id, each a candidate
    large = [(3, [1e12, 0.0]), (40, [1e300, 1.0]), (4, [-(2.0**40), 2.0**40])]
    assert run(spark, df(rows + large)) == brute(rows)  # beyond 64 bits: no part


def test_ties_in_one_chunk_and_closed_annuli(spark, monkeypatch):
    rows = [(i, [1.0, 0.0]) for i in range(100)]
    df = lambda r: spark.createDataFrame([(i, x, "", "", 0) for i, x in r], SCHEMA)
    assert run(spark, df(rows)) == brute(rows)  # the query's own row takes no place among the 20
    monkeypatch.setattr(tp, "ANNULUS", 30)
    rng = random.Random(3)
    rows = [(i, [rng.randrange(-64, 65) / 64 for _ in range(3)]) for i in range(900)]
    assert run(spark, df(rows), pivots=2) == brute(rows)  # nor do the rows of annuli that a query skips
