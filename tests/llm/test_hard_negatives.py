import math
import random

import numpy as np
import pytest

from tidemark.llm import hard_negatives as hn
from tidemark.llm.queries import ORACLES, QUERIES

SCHEMA = "vec_id long, label int, embedding array<double>, id string, row int, rank int"


def brute(rows, every=100):
    """Positives and negatives of each anchor row by the definition, over Python's whole numbers."""
    data = []
    for i, y, x in rows:
        if i is None or y is None or not x or any(c is None or not math.isfinite(c) for c in x):
            continue
        data.append((i, (y + 1) % 10 if i % 7 == 0 else y, [math.floor(256 * c) for c in x]))
    out = []
    for a, (i, y, x) in enumerate(data):
        if i % every:
            continue
        scored = sorted((-sum(p * q for p, q in zip(x, v)), j, z) for b, (j, z, v) in enumerate(data) if b != a)
        for s, j, _ in [t for t in scored if t[2] == y][:5]:
            fits = [(n, k) for n, k, z in scored if z != y and 30 * -s <= 100 * -n <= 90 * -s][:10]
            out += [(i, j, r + 1, k, -s, -n) for r, (n, k) in enumerate(fits)]
    return sorted(out)


def mined(df, **more):
    from pyspark.sql import functions as F

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return sorted(tuple(r) for r in hn.hard_negatives(df, lambda i: i % 100 == 0, label=label, **more).collect())


@pytest.mark.parametrize("shape", [(1, 1, 1), (17, 33, 18), (40, 64, 96), (65, 31, 129), (200, 50, 70)])
def test_strassen_equals_the_plain_product(shape):
    rng = np.random.default_rng(1)
    m, k, n = shape
    a, b = rng.integers(-(2**20), 2**20, (m, k)), rng.integers(-(2**20), 2**20, (k, n))
    for leaf in (1, 4, 16):
        assert (hn.strassen(a, b, leaf) == a @ b).all()


def test_strassen_is_exact_where_only_its_own_sums_overflow():
    a, b = np.zeros((32, 32), np.int64), np.zeros((32, 32), np.int64)
    a[0, 0], b[0, 0], a[20, 20], b[20, 20] = 2**31, 2**31 - 1, -(2**31), 2**31 - 1
    want = np.array([[sum(int(x) * int(y) for x, y in zip(r, c)) for c in b.T] for r in a])
    assert (hn.strassen(a, b, 1) == want).all()


def test_heaps_keep_the_best_with_ties_by_row():
    rng = random.Random(2)
    heaps, seen = hn.Heaps(3, 4), [[] for _ in range(3)]
    for _ in range(12):
        width = rng.choice([2, 4, 9])
        scores = np.array([[rng.randrange(5) for _ in range(width)] for _ in range(3)])
        allowed, rows = np.array([[rng.random() < 0.6 for _ in range(width)] for _ in range(3)]), np.array(rng.sample(range(1000), width))
        heaps.offer(scores, allowed, rows)
        for i in range(3):
            seen[i] += [(-int(scores[i, j]), int(rows[j])) for j in range(width) if allowed[i, j]]
    got = [[(-int(s), int(r)) for k, s, r in zip(heaps.slot, heaps.score, heaps.row) if k == i] for i in range(3)]
    assert got == [sorted(x)[:4] for x in seen]


def test_embeddings_match_brute_force(spark, sf, monkeypatch):
    for name, size in {"TILE": 50, "BLOCK": 2, "TILES_PER_TASK": 2, "BLOCKS_PER_TASK": 1}.items():
        monkeypatch.setattr(hn, name, size)
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    want = brute([(r.vec_id, r.label, list(r.embedding)) for r in df.collect()])
    assert want and mined(df) == want


def test_the_query_equals_its_sql(spark, sf):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{sf}/embeddings.parquet')")
    got = QUERIES["op13_hard_negatives"](spark, sf)
    assert sorted(tuple(r) for r in got.select(*sorted(got.columns)).collect()) == sorted(con.sql(f"SELECT {', '.join(sorted(got.columns))} FROM ({ORACLES['op13_hard_negatives']})").fetchall())


def test_edges(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([0, 1, 1, 1, 2]), [rng.uniform(-1, 2) for _ in range(5)]) for i in range(350)]
    rows += [(500 + i, 3, [1.0] * 5) for i in range(60)] + [(600, 3, [1.0] * 5)] * 3 + [(700, 1, [1.0, 1.0])] * 2
    rows += [(800, 1, None), (900, 1, []), (1000, 1, [1.0, None, 1.0, 1.0, 1.0]), (1100, 1, [float("nan")] * 5), (1200, 1, [float("inf")] * 5), (None, 1, [1.0] * 5), (1300, None, [1.0] * 5), (1400, 9, [2.0] * 5), (1500, 8, [0.0] * 5), (1501, 8, [0.0] * 5)]
    df = spark.createDataFrame([(*r, "a", 1, 2) for r in rows], SCHEMA)
    assert mined(df) == brute(rows)
    large = spark.createDataFrame([(1600, 1, [1e12] * 5, "", 0, 0), (1700, 1, [1e300] * 5, "", 0, 0)], SCHEMA)
    assert mined(df.unionByName(large)) == brute(rows)  # beyond 64 bits: no part
    assert mined(df.limit(0)) == []
    assert mined(df.where("vec_id = 100")) == []
