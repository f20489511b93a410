"""Rule reports, labels and composed detectors on small fixtures with known answers."""

import datetime as dt
import math
import random

import pytest

from tidemark.operators import detectors as d
from tidemark.operators import evaluation as ev
from tidemark.operators import features as ft
from tidemark.operators import models as md


def enumerated(tp, fp, fn, tn):
    row, column, n = tp + fp, tp + fn, tp + fp + fn + tn
    p = lambda k: math.comb(row, k) * math.comb(n - row, column - k)
    low, high = max(0, row + column - n), min(row, column)
    own = p(tp)
    return sum(p(k) for k in range(low, high + 1) if p(k) <= own) / math.comb(n, column)


def test_fisher_equals_enumeration_over_all_tables_of_a_margin():
    rng = random.Random(1)
    tables = [(a, b, c, e) for a in range(4) for b in range(4) for c in range(4) for e in range(4) if a + b + c + e] + [tuple(rng.randrange(60) for _ in range(4)) for _ in range(300)]
    for t in tables:
        assert ev.fisher_two_sided(*t) == pytest.approx(enumerated(*t), rel=1e-6), t
        assert ev.fisher_two_sided(*t, block=3) == pytest.approx(enumerated(*t), rel=1e-6), t
    assert 0 < ev.fisher_two_sided(30_000, 20_000, 4_000_000, 5_000_000) < 1e-300 or ev.fisher_two_sided(30_000, 20_000, 4_000_000, 5_000_000) == 0.0
    assert ev.fisher_two_sided(500, 500, 500_000, 500_000) == pytest.approx(1.0, abs=1e-6)


def population(spark, positive=5, negative=5, others=10, tankers=0):
    rows = [(300 + i, "Tanker", "Panama", 1, 2000) for i in range(positive)] + [(400 + i, "Tanker", "Panama", 0, 2015) for i in range(negative)]
    rows += [(500 + i, "Cargo", "Denmark", 0, None) for i in range(others)] + [(600 + i, "Tanker", "Denmark", 0, 1990) for i in range(tankers)]
    return spark.createDataFrame([(*r, dt.date(2024, 11, 30)) for r in rows], "mmsi long, kind string, flag string, y int, built int, window_end date")


def reports(df, k=20):
    return {r.rule: r for r in ev.rule_reports(df, ["r1", "r2", "r3"], "y", "mmsi", k).collect()}


def test_rules_of_tankers(spark):
    got = reports(ev.tanker_rules(population(spark, tankers=3), "kind", "flag", "window_end", "built"))
    r1, r2, r3 = (got[r] for r in ("r1", "r2", "r3"))
    assert (r1.n_flagged, r1.tp, r1.recall, r1.verdict) == (13, 5, 1.0, "evaluated")
    assert (r2.n_flagged, r2.tp, r2.precision) == (10, 5, 0.5) and r2.precision > r1.precision
    assert (r3.n_flagged, r3.tp, r3.precision) == (5, 5, 1.0)
    assert r2.lift == pytest.approx(0.5 / (5 / 23)) and r2.auc == pytest.approx((1 + 13 / 18) / 2)
    assert r2.fisher_p == pytest.approx(enumerated(5, 5, 0, 13), rel=1e-6)
    assert (r1.precision_at_k, r1.n_ties_at_cut) == (5 / 20, 10)  # the cut lies among rows that don't fire


def test_a_blocked_rule_has_no_figures_and_few_rows_no_precision(spark):
    got = reports(ev.tanker_rules(population(spark), "kind", "flag", "window_end", None), 30)
    assert got["r3"].verdict == "blocked_by_gate" and [v for k, v in got["r3"].asDict().items() if k not in ("rule", "verdict")] == [None] * 10
    assert got["r1"].precision_at_k is None and got["r1"].n_ties_at_cut == 0
    none = reports(ev.tanker_rules(population(spark, 0, 0, 3), "kind", "flag", "window_end", "built"))
    assert (none["r1"].n_flagged, none["r1"].precision, none["r1"].auc, none["r1"].fisher_p) == (0, None, None, 1.0)


def test_censored_rows_leave_the_hazard(spark):
    day = lambda m, d: dt.date(2024, m, d)
    rows = [(1, day(1, 31), day(3, 1)), (2, day(1, 31), None), (3, day(1, 31), day(1, 15)), (4, day(9, 30), day(10, 15)), (5, day(9, 30), None), (6, day(12, 31), day(12, 31)), (7, day(1, 31), day(12, 25)), (8, day(1, 31), day(7, 31)), (9, day(1, 31), day(8, 1))]
    df = spark.createDataFrame(rows, "id int, w date, e date")
    got = {r.id: r.label for r in md.hazard_labels(df, "w", "e", "2024-12-01").collect()}
    assert got == {1: True, 2: False, 3: False, 4: True, 7: False, 8: True, 9: False}
    assert {r.id for r in md.as_of_labels(df, "w", "e", "2024-12-01").where("label").collect()} == {1, 4, 8, 9}


def test_switches_into_a_group(spark):
    t = lambda days: dt.datetime(2024, 6, 1) - dt.timedelta(days=days)
    rows = [("in", t(900), "DNK"), ("in", t(100), "PAN"), ("out", t(900), "PAN"), ("out", t(100), "DNK"), ("old", t(1000), "DNK"), ("old", t(800), "PAN"), ("first", t(50), "PAN"), ("unknown", t(900), None), ("unknown", t(10), "LBR"), ("late", t(20), "DNK"), ("late", t(-5), "PAN"), ("stays", t(60), "PAN"), ("stays", t(30), "LBR")]
    s = spark.createDataFrame([(i, x, v, "c") for i, x, v in rows], "imo string, since timestamp_ntz, flag string, other string")
    cut = spark.createDataFrame([(i, t(0)) for i in sorted({r[0] for r in rows})], "imo string, cutoff timestamp_ntz")
    got = {r.imo: r.switched for r in ft.switched_into(s, cut, "imo", "since", "flag", ["PAN", "LBR"]).collect()}
    assert got == {"in": True, "out": False, "old": False, "first": False, "unknown": True, "late": False, "stays": False}


def test_draught_changes_that_nothing_explains(spark):
    t = lambda h: dt.datetime(2024, 6, 1) + dt.timedelta(hours=h)
    trips, positions = [], []
    for m, (a, b, lat) in {1: (5.0, 10.0, 55.0), 2: (5.0, 6.0, 55.0), 3: (5.0, 10.0, 57.0), 4: (5.0, 10.0, 55.0), 5: (10.0, 7.0, 58.0), 6: (5.0, 10.0, 57.0)}.items():
        for n, (start, draught) in enumerate(((0, a), (8, b))):
            trips.append((m, f"{m}-{n}", t(start), t(start + 2), lat, 10.0, lat, 10.0))
            positions += [(m, t(start + k / 2), draught) for k in range(4)]
    trips += [(7, f"7-{n}", t(10 * n), t(10 * n + 1), 55.0, 10.0, 55.0, 10.0) for n in range(3)]
    positions += [(7, t(10 * n + k / 4), 4.0 + 4 * n) for n in (0, 2) for k in range(4)]  # nothing is said on the trip between
    tr = spark.createDataFrame(trips, "mmsi long, voyage_id string, start_time timestamp_ntz, end_time timestamp_ntz, start_latitude double, start_longitude double, end_latitude double, end_longitude double")
    p = spark.createDataFrame(positions, "mmsi long, timestamp timestamp_ntz, draught double")
    places = spark.createDataFrame([(57.02, 10.0, [3, 11, 12, 13, 14, 15])], "center_latitude double, center_longitude double, members array<long>")
    met = spark.createDataFrame([(99, 4, t(5), t(6)), (5, 98, t(20), t(21))], "key_a long, key_b long, start_time timestamp_ntz, end_time timestamp_ntz")
    run = lambda **more: {r.mmsi: r for r in d.unexplained_draught_changes(tr, p, places, met, "mmsi", "timestamp", "draught", **more).collect()}
    got = run()
    assert sorted(got) == [1, 5]  # 2: too small, 3 and 6: an anchorage of five others, 4: an encounter, 7: not neighbours
    assert (got[1].change_m, got[1].confidence, got[1].event_time, got[1].next_voyage_id) == (5.0, 1.0, t(2), "1-1")
    assert (got[5].change_m, got[5].confidence) == (-3.0, pytest.approx(0.6))
    assert sorted(run(least_others=6)) == [1, 3, 5]  # without the vessel itself it has five only
