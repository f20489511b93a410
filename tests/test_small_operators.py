"""Operators that no query applies, each on a few rows."""

import datetime as dt

import pytest

from tidemark.operators import detectors as d
from tidemark.operators import models as md
from tidemark.operators import resampling as rs
from tidemark.sources import readers, sinks

T0 = dt.datetime(2024, 6, 1)


def at(hours):
    return T0 + dt.timedelta(hours=hours)


def test_cells_in_rings(spark):
    df = spark.createDataFrame([(1, 55.05, 12.15)], "id int, lat double, lon double")
    assert [(r.cell_lat, r.cell_lon) for r in d.cells_within(df, "lat", "lon", 0.1, 0).collect()] == [(55.0, 12.1)]
    two = {(r.cell_lat, r.cell_lon) for r in d.cells_within(df, "lat", "lon", 0.1, 2).collect()}
    assert two == {(round(55.0 + i / 10, 6), round(12.1 + j / 10, 6)) for i in range(-2, 3) for j in range(-2, 3)}


def test_keys_with_several_valid_numbers(spark):
    rows = [(1, at(0), "9074729"), (1, at(5), "9187629"), (1, at(3), "9187629"), (1, at(1), "1234568"), (2, at(0), "9074729"), (2, at(1), "9074729"), (3, at(0), None), (4, at(9), "8814275"), (4, at(2), "9074729"), (4, at(7), "9187629")]
    got = {r.mmsi: (r.event_time, r.imos) for r in d.reused_keys(spark.createDataFrame(rows, "mmsi int, t timestamp_ntz, imo string"), "mmsi", "t", "imo").collect()}
    assert got == {1: (at(3), ["9074729", "9187629"]), 4: (at(7), ["9074729", "9187629", "8814275"])}


def test_threshold_between_two_peaks(spark):
    two = [(0.1 + (i % 5) / 100,) for i in range(60)] + [(0.9 + (i % 5) / 100,) for i in range(50)]
    odd = [(None,), (float("nan"),), (float("inf"),), (float("-inf"),)]
    df = lambda rows: spark.createDataFrame(rows, "x double")
    found = d.laden_threshold(df(two), "x")
    assert 0.14 < found < 0.9 and d.laden_threshold(df(two + odd), "x") == found
    assert d.laden_threshold(df(two[:20] + odd), "x") == 0.2  # too few
    assert d.laden_threshold(df([(0.5,)] * 40), "x", fallback=0.3) == 0.3  # all alike
    assert d.laden_threshold(df([(0.5 + (i % 3) / 1000,) for i in range(90)]), "x", bins=3, fallback=0.25) == 0.25  # one peak
    assert d.laden_threshold(df([]), "x") == 0.2


def test_share_of_a_sample_that_overlaps(spark):
    span = lambda rows: spark.createDataFrame([(k, at(a), at(b)) for k, a, b in rows], "imo string, s timestamp_ntz, e timestamp_ntz")
    ours, theirs = span([("a", 0, 2), ("a", 10, 12), ("b", 0, 2), ("c", 0, 1)]), span([("a", 2, 3), ("b", 5, 6), ("c", -5, 9), ("c", 0, 1)])
    r = d.shares_that_overlap(ours, theirs, "imo", "s", "e", 10).first()
    assert (r.n_sampled, r.n_overlapping, r.share) == (4, 2, 0.5)
    some = [tuple(d.shares_that_overlap(o, theirs, "imo", "s", "e", 2, seed=3).first()) for o in (ours, ours.repartition(3))]
    assert some[0] == some[1] and some[0][0] == 2
    assert tuple(d.shares_that_overlap(ours.limit(0), theirs, "imo", "s", "e", 5).first()) == (0, 0, None)


def test_states_of_days(spark):
    days = lambda *x: spark.createDataFrame([(dt.date(2024, 6, i),) for i in x], "date date")
    got = {r.date.day: r.state for r in sinks.day_states(days(1, 2, 3, 3), days(2, 3), days(3), days(1, 2, 3, 4)).collect()}
    assert got == {1: "raw_only", 2: "clean", 3: "reduced", 4: "absent"}


def test_population_of_one_window(spark):
    df = spark.createDataFrame([(1, "2024-06", True), (2, "2024-06", True), (3, "2024-11", False)], "id int, month string, inside boolean")
    kept, window = rs.one_window(df, ["month"], df.inside)
    assert window == ("2024-06",) and kept.count() == 2
    for population in (df.id > 0, df.id > 9):
        with pytest.raises(ValueError):
            rs.one_window(df, ["month"], population)


def test_windows_before_a_cutoff(spark):
    df = spark.createDataFrame([(i, dt.date(2024, i, 28)) for i in (5, 6, 7)], "id int, window_end date")
    assert [r.id for r in md.before(df, "window_end", "2024-06-28").collect()] == [5]


def test_sources_of_one_record_each(spark, tmp_path):
    entries = spark.createDataFrame([("v-1", 3, 1.0), ("v-2", 1, 2.0), ("w", 2, 50.0), ("x.1", 5, -9.0)], "id string, n int, lat double")
    got = {r.base_id: r.id for r in readers.dedup_mirrored(entries, "id", "n").collect()}
    assert got == {"v": "v-2", "w": "w", "x": "x.1"}
    box = spark.createDataFrame([(1, 55.0, 10.0), (2, 54.0, 8.0), (3, 60.0, 10.0), (4, None, 10.0)], "id int, lat double, lon double")
    assert sorted(r.id for r in readers.within_box(box, "lat", "lon", 54.0, 8.0, 56.0, 12.0).collect()) == [1, 2]
    ids = spark.createDataFrame([("k", "1"), ("k", "2"), ("k", "2"), ("one", "1"), ("none", None)], "key string, imo string")
    assert {(r.key, r.is_shared) for r in readers.keep_consistent_keys(ids, "key", "imo").collect()} == {("k", True), ("one", False), ("none", False)}
    none = readers.empty(spark, "a long, b string")
    assert none.collect() == [] and none.dtypes == [("a", "bigint"), ("b", "string")]
    spark.createDataFrame([(1,)], "id int").write.parquet(f"{tmp_path}/t")
    assert readers.with_source_file(spark.read.parquet(f"{tmp_path}/t")).first().source_file.endswith(".parquet")
