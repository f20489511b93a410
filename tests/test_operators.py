"""Operators on small fixtures with known answers, edge cases included."""

import datetime as dt
import math
import zlib

from pyspark.sql import functions as F

from tidemark.functions import columns as fn
from tidemark.operators import aggregates as ag
from tidemark.operators import detectors as d
from tidemark.operators import evaluation as ev
from tidemark.operators import identity as ident
from tidemark.operators import joins as jn
from tidemark.operators import resampling as rs
from tidemark.operators import timeline as tl

T0 = dt.datetime(2024, 6, 1)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_columns(spark):
    df = spark.createDataFrame([("9074729", " @tug  boat@ ", 10.0), ("9074728", "@@", 370.0), ("0000000", None, -5.0), ("12a4567", "UNKNOWN", None), (None, "x", 350.0)], "imo string, name string, deg double")
    out = df.select(fn.valid_imo(F.col("imo")), fn.normal_text(F.col("name")), fn.clip(F.col("deg"), 0, 360), fn.signed_turn(F.lit(10.0), F.lit(350.0))).collect()
    assert [r[0] for r in out] == [True, False, False, False, False]
    assert [r[1] for r in out] == ["TUG BOAT", None, None, "UNKNOWN", "X"]
    assert [r[2] for r in out] == [10.0, 360.0, 0.0, None, 350.0] and out[0][3] == 20.0


def test_gap_exactly_at_the_threshold_does_not_split(spark):
    df = spark.createDataFrame([(1, at(0)), (1, at(360)), (1, at(721)), (2, at(0)), (None, at(5))], "mmsi long, timestamp timestamp_ntz")
    out = tl.sessionize(df, ["mmsi"], "timestamp", 6 * 3600)
    assert rows(out.where("mmsi = 1").select("session_seq")) == [(1,), (1,), (2,)]
    assert tl.sessionize(df.limit(0), ["mmsi"], "timestamp", 1).count() == 0


def test_clean_keeps_the_first_row_and_counts_drops(spark):
    data = [(0, 219000001, at(0), 55.0, 12.0), (1, 219000001, at(0), 55.0, 12.0), (2, 5, at(0), 55.0, 12.0), (3, 219000001, at(0), 0.0, 0.0), (4, 219000001, at(0), 91.0, 0.0), (5, 219000001, at(1), None, 1.0)]
    df = spark.createDataFrame(data, "n long, mmsi long, timestamp timestamp_ntz, latitude double, longitude double")
    assert [r.n for r in tl.clean(df, "n").collect()] == [0]
    assert tuple(tl.clean_counts(df, "n").first()) == (6, 1, 3, 1, 1)
    assert tuple(tl.clean_counts(df.limit(0), "n").first()) == (0, 0, 0, 0, 0)


def test_asof_join_takes_equal_times_and_can_keep_unmatched(spark):
    left = spark.createDataFrame([(1, at(0)), (1, at(10)), (2, at(5))], "k long, t timestamp_ntz")
    right = spark.createDataFrame([(1, at(10), "b"), (1, at(3), "a")], "k long, s timestamp_ntz, v string")
    assert rows(jn.asof_join(left, right, ["k"], "t", "s", ["v"]).select("k", "asof_v")) == [(1, "b")]
    assert jn.asof_join(left, right, ["k"], "t", "s", ["v"], how="left").count() == 3


def test_intervals_touch_and_pad(spark):
    a = spark.createDataFrame([(1, at(0), at(60)), (2, at(5000), at(5001))], "id long, s timestamp_ntz, e timestamp_ntz")
    b = spark.createDataFrame([(7, at(60), at(90)), (8, at(91), at(3000))], "id long, s timestamp_ntz, e timestamp_ntz")
    assert rows(jn.overlapping_pairs(a, b, [], "s", "e").select("l.id", "r.id")) == [(1, 7)]
    assert rows(jn.overlapping_pairs(a, b, [], "s", "e", 16 * 60).select("l.id", "r.id")) == [(1, 7), (1, 8)]


def test_interval_kinds(spark):
    df = spark.createDataFrame([(1, "a", at(0)), (1, "a", at(10)), (1, "b", at(10)), (2, "a", at(0)), (2, "b", at(1)), (3, "a", at(0)), (3, None, at(4))], "k long, v string, t timestamp_ntz")
    i = ident.value_intervals(df, ["k"], "v", "t")
    assert rows(ident.classify_intervals(i, ["k"], "v").select("k", "kind")) == [(1, "flapping"), (2, "clean_switch")]
    assert rows(ident.value_changes(i, ["k"], "v").select("k", "old_value", "new_value")) == [(2, "a", "b")]


def test_shared_pairs_stop_at_the_cap_with_ties(spark):
    df = spark.createDataFrame([("g", 1, 1), ("g", 2, 2), ("g", 3, 3), ("g", 4, 3), ("h", 9, 1)], "g string, m long, t long")
    assert rows(ident.shared_pairs(df, ["g"], "m", "t", 3).select("member", "other")) == [(1, 2), (2, 1)]


def test_components_of_chains_and_links(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 300), (7, 7)]
    found = {r.node: r.component for r in ident.connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert {found[i] for i in range(41)} == {0} and {found[i] for i in (100, 200, 300)} == {100}
    links = spark.createDataFrame([(1, 2, "shared_imo", 0.8, 5), (2, 3, "shared_identity", 0.6, 2)], "mmsi_a long, mmsi_b long, basis string, confidence double, knowable_at long")
    assert rows(ident.vessel_links(links)) == [(1, "vessel-1", "shared_imo", 0.8, 5), (2, "vessel-1", "shared_imo", 0.8, 2), (3, "vessel-1", "shared_identity", 0.6, 2)]


def test_circle_is_recovered_and_a_line_is_not(spark):
    ring = [("c", at(3 * i), 55 + 0.01 * math.sin(i / 5), 12 + 0.01 * math.cos(i / 5) / math.cos(math.radians(55))) for i in range(60)]
    line = [("l", at(3 * i), 55 + 0.001 * i, 12.0) for i in range(60)]
    out = d.synthetic_circles(spark.createDataFrame(ring + line, "trip string, t timestamp_ntz, lat double, lon double"), "trip", "t", "lat", "lon").collect()
    assert [r.trip for r in out] == ["c"] and abs(out[0].radius - 1113.2) < 15


def test_speed_and_simultaneous(spark):
    df = spark.createDataFrame([(0, 1, at(0), 55.0, 12.0), (1, 1, at(10), 56.0, 12.0), (2, 1, at(10), 55.0, 12.0), (3, 2, at(0), 55.0, 12.0), (4, 2, at(60), 55.1, 12.0)], "n long, mmsi long, t timestamp_ntz, lat double, lon double")
    fast = d.impossible_speed(df, "mmsi", "t", "lat", "lon", tie=["n"]).collect()
    assert [(r.mmsi, r.n, r.confidence) for r in fast] == [(1, 1, 1.0)]
    assert rows(d.simultaneous_positions(df, "mmsi", "t", "lat", "lon", "n").select("mmsi", "n_a", "n_b", "confidence")) == [(1, 1, 2, 1.0)]


def test_gap_probability_bands(spark):
    df = spark.createDataFrame([("receiver_alive", 11.9), ("receiver_alive", 12.0), ("area_dark", 20.0), ("area_dark", 7.0), ("no_evidence", 13.0)], "v string, h double")
    assert [r[0] for r in df.select(d.gap_probability(F.col("v"), F.col("h"))).collect()] == [0.9, 0.6, 0.4, 0.15, 0.5]


def test_liveness_leaves_the_own_vessel_out(spark):
    gaps = spark.createDataFrame([(1, 1, at(60 * 24 * 3), at(60 * 24 * 3 + 600)), (2, 1, at(60 * 24 * 3), at(60 * 24 * 3 + 600)), (3, 1, at(60 * 24 * 3), at(60 * 24 * 3 + 600))], "mmsi long, gap long, gap_start timestamp_ntz, gap_end timestamp_ntz")
    cells = spark.createDataFrame([(1, 1, "a"), (2, 1, "b"), (3, 1, "c")], "mmsi long, gap long, cell string")
    heard = [("a", 9, at(60 * 24 * 3 + 5)), ("a", 1, at(60 * 24 * 3 + 5)), ("b", 2, at(60 * 24 * 3 + 5))] + [("b", v, at(60 * h + v)) for v in (5, 6, 7) for h in range(72)]
    seen = d.presence(spark.createDataFrame(heard, "cell string, mmsi long, t timestamp_ntz"), ["cell"], "t", "mmsi")
    out = d.liveness_verdict(gaps, cells, seen, ["mmsi", "gap"], ["cell"], "mmsi", baseline_days=3)
    assert rows(out.select("mmsi", "n_corroborators", "verdict")) == [(1, 1, "receiver_alive"), (2, 0, "area_dark"), (3, 0, "no_evidence")]


def test_encounters_cross_midnight_and_split(spark):
    def ship(k, lat, minutes):
        return [(k, at(m), lat, 12.0, 0.5) for m in minutes]

    close = list(range(1380, 1560, 5))
    df = spark.createDataFrame(ship(1, 55.0, close) + ship(2, 55.001, close + [1700]) + ship(1, 55.0, [1700]) + ship(3, 55.5, close), "mmsi long, t timestamp_ntz, lat double, lon double, sog double")
    e = d.encounter_episodes(d.pair_slots(d.slots(df, "mmsi", "t", "lat", "lon", "sog"), "mmsi"))
    assert rows(e.select("key_a", "key_b", "n_slots", "duration_hours")) == [(1, 2, 1, 1 / 6), (1, 2, 18, 3.0)]
    places = lambda members: spark.createDataFrame([(55.01, 12.01, members)], "center_latitude double, center_longitude double, members array<long>")
    assert d.structural_gates(e, places([1, 2, 5, 6, 7, 8])).count() == 1
    assert d.structural_gates(e, places([5, 6, 7, 8, 9])).count() == 0


def test_encounter_confidence(spark):
    def score(states, drift, kinds, statuses, far, repeats, hours):
        return d.encounter_confidence(*(F.lit(x) for x in (*states, drift, *kinds, *statuses)), F.lit(far).cast("double"), F.lit(repeats), F.lit(hours))

    way, still = ["moved"] * 4, ["stationary"] * 4
    cases = [
        (score(way, 800.0, ("Tanker", "Tanker"), ("Under way using engine",) * 2, None, 1, 5.0), 1.0),
        (score(still, 0.0, ("Tug", "Tanker"), ("Moored", "At anchor"), 9_999.0, 4, 80.0), 0.02),
        (score(["moved", "no_data", "stationary", "moved"], 250.0, ("Cargo", "Tanker"), ("Moored", None), 10_000.0, 2, 48.0), 0.35 * 0.625 + 0.1 + 0.18 + 0.075 + 0.05 + 0.025),
        (score(still, 0.0, ("Cargo", "Cargo"), ("", "Moored"), None, 3, 24.0), 0.12 + 0.025 + 0.05),
        (score(still, 0.0, (None, "Fishing"), ("Moored", "Moored"), None, 3, 72.0), 0.04),
        (score(still, 0.0, (None, "Cargo"), ("Moored", "Moored"), None, 3, 72.0), 0.08),
    ]
    got = spark.range(1).select(*(c for c, _ in cases)).first()
    assert all(abs(a - b) < 1e-9 for a, (_, b) in zip(got, cases))


def test_agreement_and_trips(spark):
    s = "id long, key_a long, key_b long, start_time timestamp_ntz, end_time timestamp_ntz"
    ours = spark.createDataFrame([(1, 1, 2, at(0), at(60)), (2, 1, 3, at(0), at(60))], s)
    theirs = spark.createDataFrame([(7, 2, 1, at(110), at(200)), (8, 3, 1, at(130), at(200))], s)
    a, b = d.agreement(ours, theirs)
    assert rows(a.select("id", "matched")) == [(1, True), (2, False)] and rows(b.select("id", "matched")) == [(7, True), (8, False)]
    day = 1440
    c = spark.createDataFrame([(1, at(0), "E"), (1, at(0), "W"), (1, at(5 * day), "W"), (1, at(6 * day), "E"), (1, at(40 * day), "W")], "imo long, crossing_time timestamp_ntz, direction string")
    assert rows(d.round_trips(c, "imo").select("days")) == [(5,)]


def test_course_mismatch_needs_a_unique_port(spark):
    trips = spark.createDataFrame([(1, "1-1", at(0), at(600))], "mmsi long, voyage_id string, start_time timestamp_ntz, end_time timestamp_ntz")
    p = spark.createDataFrame([(1, at(10 * i), 55.0, 12.0, 180.0, 10.0, "oslo ") for i in range(20)], "mmsi long, timestamp timestamp_ntz, lat double, lon double, cog double, sog double, destination string")
    ports = [("Oslo", 59.9, 10.7), ("Kiel", 54.3, 10.1)]
    run = lambda x: d.course_mismatch(trips, p, spark.createDataFrame(x, "name string, port_lat double, port_lon double"), "mmsi", "timestamp", "lat", "lon", "cog", "sog", "destination")
    assert [r.destination for r in run(ports).collect()] == ["OSLO"]
    assert run([*ports, ("OSLO", 1.0, 1.0)]).count() == 0


def test_ranks_with_ties(spark):
    df = spark.createDataFrame([(1, 5.0, 1), (2, 5.0, 0), (3, 5.0, 0), (4, 1.0, 1), (5, 0.0, 0)], "id long, s double, y int")
    assert rows(ev.average_rank(df, "s").select("id", "avg_rank")) == [(1, 4.0), (2, 4.0), (3, 4.0), (4, 2.0), (5, 1.0)]
    assert ev.auc(df, "s", "y").first().auc == 0.5
    assert ev.expected_hits_at(df, "s", "y", 2).first().expected_hits == 2 / 3
    assert ev.precision_at(df, "s", "y", "id", 2).first().n_tied_at_cutoff == 3
    assert ev.auc(df.where("y = 1"), "s", "y").first().auc is None
    assert rows(ag.ordered_ntile(df, 2, ["s", "id"]).select("id", "tile")) == [(1, 1), (2, 2), (3, 2), (4, 1), (5, 1)]


def test_trip_draughts_take_the_largest_of_all_readings_before_the_return(spark):
    day = 1440
    trips = spark.createDataFrame([(1, at(10 * day), at(20 * day)), (2, at(10 * day), at(20 * day)), (3, at(10 * day), at(20 * day))], "imo long, east_time timestamp_ntz, west_time timestamp_ntz")
    read = [(1, 0, 12.0), (1, 10 * day + 60, 6.0), (1, 10 * day - 720, 8.0), (1, 20 * day - 1, 9.0), (1, 20 * day, 15.0), (1, 20 * day + 721, 3.0), (2, 10 * day, 0.0), (2, 20 * day, 5.0)]
    out = {r.imo: (r.draught_east, r.draught_west, r.draught_max, r.rel_change) for r in d.trip_draughts(trips, spark.createDataFrame([(k, at(m), v) for k, m, v in read], "imo long, t timestamp_ntz, d double"), "imo", "t", "d").collect()}
    assert out == {1: (7.0, 12.0, 12.0, 5 / 12), 2: (0.0, 5.0, 0.0, None), 3: (None, None, None, None)}


def test_known_checksums_and_bootstrap_limits(spark):
    from tidemark.operators.models import split_by_crc

    rows_ = split_by_crc(spark.createDataFrame([(i,) for i in range(50)], "k long"), F.col("k"), "salt", 7).collect()
    assert all(r.part == zlib.crc32(f"salt|{r.k}".encode()) % 7 for r in rows_)
    df = spark.createDataFrame([(i, i % 10, i % 4 == 0, i % 3 > 0) for i in range(2000)], "id long, c long, y boolean, f boolean").withColumn("y", F.col("y").cast("int"))
    b = rs.bootstrap_precision(df, "f", "y", "c").first()
    assert b.n_replicates == 200 and b.low < 0.25 < b.high and b.high - b.low < 0.6
    one = rs.bootstrap_precision(df.withColumn("y", F.lit(1)), "f", "y", "c").first()
    assert (one.low, one.high) == (1.0, 1.0)


def test_totals_before_per_key_over_ranges(spark):
    """A key of a third of the rows lies over several ranges; null keys are a key, names that helpers would take stay."""
    import random

    rng = random.Random(3)
    rows = [(rng.choice([None, "a", "b", "hot", "hot", "hot"]), rng.randrange(60), i, f"p{i}", 7) for i in range(900)]
    df = spark.createDataFrame(rows, "k string, t int, id int, __part string, at int").repartition(5)
    out = ag.totals_before(df, ["t", "id"], {"n": F.lit(1), "s": F.col("t")}, ["k"])
    assert out.columns == [*df.columns, "n", "s"]
    got = {r.id: (r.n, r.s, r["__part"], r["at"]) for r in out.collect()}
    for k, t, i, p, seven in rows:
        before = [x for x in rows if x[0] == k and (x[1], x[2]) < (t, i)]
        assert got[i] == (len(before), sum(x[1] for x in before), p, seven)
    assert ag.totals_before(df.limit(0), ["t"], {"n": F.lit(1)}, ["k"]).collect() == []
