"""Tree models against plain versions over the same rows."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import forests as fo


def plain_tree(x, rng, limit, depth=0):
    """A tree as nested tuples, drawing in the same order."""
    varied = [f for f in range(x.shape[1]) if len(x) and x[:, f].min() < x[:, f].max()]
    if len(x) <= 1 or depth >= limit or not varied:
        n = len(x)
        c = 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n
        return depth + c
    f = varied[rng.integers(len(varied))]
    split = rng.uniform(x[:, f].min(), x[:, f].max())
    left = x[:, f] <= split
    return f, split, plain_tree(x[left], rng, limit, depth + 1), plain_tree(x[~left], rng, limit, depth + 1)


def plain_length(row, tree):
    while isinstance(tree, tuple):
        f, split, left, right = tree
        tree = left if row[f] <= split else right
    return tree


def test_paths_equal_a_plain_recursion():
    x = np.round(np.random.default_rng(1).normal(size=(90, 3)), 1)
    x[:40, 1] = 2.0
    for seed in range(5):
        tree = fo.grow_isolation_tree(x, np.random.default_rng(seed), 7)
        want = plain_tree(x, np.random.default_rng(seed), 7)
        assert np.allclose(fo.path_lengths(x, tree, 7), [plain_length(r, want) for r in x])


def test_scores_equal_a_plain_forest_and_repeat(spark):
    rng = random.Random(2)
    rows = [(i, rng.gauss(0, 1), rng.gauss(0, 1) if i % 9 else None) for i in range(120)] + [(500, 9.0, -9.0), (501, float("nan"), 0.0)]
    df = spark.createDataFrame([(*r, "kept") for r in rows], "id long, x double, y double, anomaly_of string")
    run = lambda d: {r.id: r.anomaly for r in fo.isolation_scores(d, d, ["x", "y"], ["id"], trees=20, sample=200).collect()}
    got = run(df.repartition(3))
    assert got == run(df.coalesce(1).orderBy(F.desc("id")))
    assert max(got, key=got.get) == 500 and all(0 < v <= 1 for v in got.values())
    # every tree saw all rows: the same trees, grown plainly from rows in the order of their draws
    middle = {c: float(np.median([r[i] for r in rows if r[i] is not None and r[i] == r[i]])) for c, i in (("x", 1), ("y", 2))}
    value = {r[0]: np.array([middle[c] if v is None or v != v else v for c, v in zip("xy", r[1:])]) for r in rows}
    total = dict.fromkeys(value, 0.0)
    for t in range(20):
        order = [r.id for r in df.select("id", F.xxhash64(F.lit(0), F.lit(t), F.struct("id")).alias("h")).orderBy("h").collect()]
        tree = plain_tree(np.array([value[i] for i in order]), np.random.default_rng([0, t]), 7)
        for i in value:
            total[i] += plain_length(value[i], tree)
    per_path = float(fo.expected_path(len(rows)))
    assert all(abs(got[i] - 2 ** (-total[i] / 20 / per_path)) < 1e-9 for i in value)
    assert {r.anomaly for r in fo.isolation_scores(df.limit(0), df, ["x"], ["id"], trees=3).collect()} == {0.5}
    assert fo.isolation_scores(df, df.limit(0), ["x"], ["id"], trees=3).collect() == []


def exhaustive(rows, y, p, allowed, least, l2):
    """The best split over every value of every feature, from the rows themselves; None goes to either side."""
    g, h = p - y, p * (1 - p)
    score = lambda m: g[m].sum() ** 2 / (h[m].sum() + l2)
    best = None
    for f in allowed:
        v = np.array([np.nan if r[f] is None else r[f] for r in rows], float)
        lost = np.isnan(v)
        for missing_left in (True, False) if lost.any() else (False,):
            for t in sorted(set(v[~lost])):
                left = np.where(lost, missing_left, v <= t)
                if left.sum() >= least and (~left).sum() >= least:
                    gain = score(left) + score(~left) - score(np.ones(len(v), bool))
                    if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                        best = gain, f, t, missing_left, left
    return best


def test_splits_and_scores_equal_an_exhaustive_search(spark):
    rng = random.Random(3)
    rows = [(i, float(rng.randrange(8)), rng.choice([None, 0.0, 1.0, 2.0]), float(rng.randrange(3)), rng.randrange(4)) for i in range(240)]
    data = [(*r[:4], int(r[1] > 4 and r[2] != 1.0 or r[4] == 0)) for r in rows]
    df = spark.createDataFrame(data + [(900, 1.0, 1.0, 1.0, None)], "id long, a double, b double, c double, y int").repartition(4)
    model, bags = fo.fit_boosting(df, ["a", "b", "c"], "y", ["id"], trees=3, depth=2, rate=0.3, least=5, rewrite=2)
    x, y = [r[1:4] for r in data], np.array([r[4] for r in data], float)
    odds = np.full(len(y), math.log(y.sum() / (len(y) - y.sum())))
    for tree in model.trees[0]:
        p, step = 1 / (1 + np.exp(-odds)), np.zeros(len(y))
        parts = {0: np.ones(len(y), bool)}
        for node in (0, 1, 2):
            own = parts.get(node)
            if own is None:
                continue
            at = np.flatnonzero(own)
            want = exhaustive([x[i] for i in at], y[at], p[at], range(3), 5, 1.0)
            if want is None:
                assert tree["feature"][node] == -1
                continue
            _, f, t, missing_left, left = want
            assert tree["feature"][node] == f and model.edges[f][tree["last"][node]] == t
            for side, m in ((0, left), (1, ~left)):
                parts[2 * node + 1 + side] = np.isin(np.arange(len(y)), at[m])
        for node, own in parts.items():
            if 2 * node + 1 not in parts:
                value = -0.3 * (p - y)[own].sum() / ((p * (1 - p))[own].sum() + 1.0)
                assert abs(value - tree["value"][node]) < 1e-9
                step[own] += value
        odds += step
    got = {r.id: r.score for r in fo.boosted_scores(model, df).collect()}
    assert all(abs(got[r[0]] - 1 / (1 + math.exp(-o))) < 1e-9 for r, o in zip(data, odds)) and 900 in got


def test_bags_hold_all_positives_and_scores_leave_out_what_a_bag_saw(spark):
    rng = random.Random(4)
    rows = [(i, rng.gauss(0, 1), int(i < 60)) for i in range(1000)]
    df = spark.createDataFrame([(i, x + 1.5 * y if i % 2 else x, y) for i, x, y in rows], "id long, x double, y int")
    model, bags = fo.fit_boosting(df, ["x"], "y", ["id"], bags=4, ratio=3, trees=5, subsample=0.8, seed=7)
    marked = df.withColumn("mask", bags).collect()
    assert all(r.mask == 15 for r in marked if r.y == 1)
    for b in range(4):
        drawn = sum(r.mask >> b & 1 for r in marked if r.y == 0)
        assert abs(drawn - 180) < 45
    assert len({tuple(np.round(t["value"], 9)) for bag in model.trees for t in bag}) > 4
    out = {r.id: r.oob for r in fo.boosted_scores(model, df, bags, "oob").collect()}
    for r in marked[::7]:
        p = 1 / (1 + np.exp(-model.margins(model.bins([np.array([r.x])]))))[0]
        new = [k for k in range(4) if not r.mask >> k & 1] or range(4)
        assert abs(out[r.id] - np.mean([p[k] for k in new])) < 1e-12


def test_no_rows_or_one_class(spark):
    df = spark.createDataFrame([(1, 1.0, 1), (2, None, 1)], "id long, x double, y int")
    for d in (df, df.limit(0)):
        model, _ = fo.fit_boosting(d, ["x"], "y", ["id"], trees=2)
        assert len(fo.boosted_scores(model, df).collect()) == 2
