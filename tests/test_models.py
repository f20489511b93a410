import pytest

from tidemark.operators import geometry as g
from tidemark.operators import models as m


def test_medians_come_from_the_training_rows_alone(spark):
    a = spark.createDataFrame([(1.0,), (3.0,), (None,)], "x double")
    b = spark.createDataFrame([(None,), (100.0,)], "x double")
    train, other = m.impute_medians(a, [b], ["x"])
    assert sorted(r.x for r in train.collect()) == [1.0, 2.0, 3.0] and sorted(r.x for r in other.collect()) == [2.0, 100.0]


def test_labels_are_no_features_and_one_class_has_a_score(spark):
    with pytest.raises(ValueError):
        m.feature_columns(["n_gaps", "label_is_known"])
    df = spark.createDataFrame([(1.0, 0), (2.0, 0)], "x double, y int")
    assert [r.score for r in m.logistic_scores(df, df, ["x"], "y").collect()] == [0.0, 0.0]


def test_logistic_orders_separable_rows(spark):
    df = spark.createDataFrame([(float(i), int(i >= 15)) for i in range(20)] + [(None, 0)], "x double, y int")
    s = {r.x: r.score for r in m.logistic_scores(df, df.where("x is not null"), ["x"], "y").collect()}
    assert [s[float(i)] for i in range(20)] == sorted(s.values())


def test_borders_and_holes(spark):
    ring = lambda a, b: [(a, a), (b, a), (b, b), (a, b), (a, a)]
    polygons = spark.createDataFrame([(1, [ring(0.0, 10.0), ring(4.0, 6.0)]), (2, [ring(20.0, 30.0)]), (3, [])], "id long, rings array<array<struct<x: double, y: double>>>")
    points = spark.createDataFrame([(1, 1.0, 1.0), (2, 5.0, 5.0), (3, 0.0, 0.0), (4, 10.0, 5.0), (5, 25.0, 25.0), (6, None, 1.0)], "p long, x double, y double")
    found = g.points_in_polygons(points, g.polygon_edges(polygons, "id", "rings"), "p", "x", "y", "id", 3.0)
    assert sorted(tuple(r) for r in found.collect()) == [(1, 1), (3, 1), (5, 2)]


def test_nearest_at_high_latitude_and_ties(spark):
    t = spark.createDataFrame([(7, 70.0, 20.0), (8, 70.0, 20.4), (9, 70.0, 20.4)], "t long, lat double, lon double")
    p = spark.createDataFrame([(1, 70.0, 20.39), (2, 70.0, 20.1), (3, 60.0, 20.0)], "p long, lat double, lon double")
    near = g.nearest_within(p, t, "p", "t", "lat", "lon", 5000.0)
    assert sorted((r.p, r.t) for r in near.collect()) == [(1, 8), (2, 7)]
    assert tuple(g.two_way_coverage(p, t, "p", "t", "lat", "lon", 5000.0).select("n_left", "n_right", "left_near", "right_near").first()) == (3, 3, 2, 3)


def test_effective_rank_equals_numpy(spark):
    import numpy as np

    from tidemark.operators.models import effective_rank

    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 6)) @ np.diag([5, 3, 1, 1, 0.1, 0])
    values = np.clip(np.linalg.eigvalsh(np.cov(x.T)), 1e-12, None)
    p = values / values.sum()
    got = effective_rank(spark.createDataFrame([(v.tolist(),) for v in x] + [(None,)], "v array<double>").repartition(3), "v")
    assert abs(got - np.exp(-(p * np.log(p)).sum())) < 1e-6


def test_groups_stay_in_one_fold(spark):
    from tidemark.operators.models import cross_validated_scores

    rows = [(i // 4, float(i % 2), i % 2) for i in range(200)]
    out = cross_validated_scores(spark.createDataFrame(rows, "g long, x double, y int"), ["x"], "y", "g", 3).collect()
    folds = {}
    for r in out:
        folds.setdefault(r.g, set()).add(r.fold)
    assert len(out) == 200 and all(len(f) == 1 for f in folds.values()) and len({f for x in folds.values() for f in x}) == 3
    assert all((r.score > 0.5) == (r.y == 1) for r in out)


def test_land_is_eroded_at_its_edges(spark):
    from tidemark.operators.geometry import on_land

    ring = lambda *p: [tuple(map(float, x)) for x in p]
    square = [ring((0, 0), (1, 0), (1, 1), (0, 1), (0, 0)), ring((0.4, 0.4), (0.6, 0.4), (0.6, 0.6), (0.4, 0.6), (0.4, 0.4))]
    land = spark.createDataFrame([(1, square)], "polygon long, rings array<array<struct<x: double, y: double>>>")
    at = [(0.5, 0.5), (0.2, 0.2), (0.005, 0.5), (0.02, 0.5), (0.393, 0.5), (0.395, 0.5), (1.2, 0.5), (0.995, 0.995)]
    points = spark.createDataFrame([(i, y, x) for i, (x, y) in enumerate(at)], "id long, lat double, lon double")
    assert {r.id for r in on_land(points, land, "id", "lat", "lon").collect()} == {1, 3}
    assert on_land(points.limit(0), land, "id", "lat", "lon").collect() == []
