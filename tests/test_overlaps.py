"""Interval meetings without pairs, places of one pair, and encounters' surroundings."""

import datetime as dt
import random

from tidemark.operators import detectors as d
from tidemark.operators import joins as jn

DAY = dt.datetime(2024, 1, 1)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def at(hours):
    return DAY + dt.timedelta(hours=hours)


def test_rows_that_overlap_make_no_pairs(spark):
    rng = random.Random(5)
    side = lambda n: [(i, rng.randrange(6) or None, at(s := rng.randrange(400)), at(s + rng.randrange(9))) for i in range(n)]
    a, b = side(120), side(40)
    schema = "id long, k long, s timestamp_ntz, e timestamp_ntz"
    out = jn.that_overlap(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), ["k"], "s", "e", 3600)
    wide = dt.timedelta(hours=2)
    assert sorted(r.id for r in out.collect()) == [i for i, k, s, e in a if k and any(k == q and s <= f + wide and t <= e + wide for _, q, t, f in b)]
    met = spark.createDataFrame(b, schema).selectExpr("k as key_a", "k + 1 as key_b", "s as start_time", "e as end_time")
    assert "sequence" not in plan(d.during_encounter(spark.createDataFrame(a, schema), met, "id", "k", "s", "e"))


def test_places_of_a_pair_are_not_broadcast(spark):
    rng = random.Random(6)
    rows = [(i, i % 3, 55 + rng.randrange(40) / 100, 10 + rng.randrange(60) / 100) for i in range(150)] + [(200, 1, None, 10.0)]
    out = d.same_place_counts(spark.createDataFrame(rows, "id long, k long, lat double, lon double"), ["k"], "lat", "lon", 8_000.0)
    far = lambda p, q: spark_haversine(p[2], p[3], q[2], q[3]) <= 8_000
    assert {r.id: r.n_same_place for r in out.collect()} == {p[0]: sum(far(p, q) for q in rows[:-1] if p[1] == q[1]) for p in rows[:-1]}
    assert "BroadcastHashJoin" not in plan(out).split("Generate")[0].split("SortMergeJoin")[-1] and "SortMergeJoin" in plan(out)


def spark_haversine(a, b, c, e):
    import math

    x = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(e - b) / 2) ** 2
    return 2 * 6_371_000 * math.asin(math.sqrt(x))


def test_episodes_read_their_pairs_once(spark):
    rows = [(1, 2, at(h / 6), 100.0 + h, float(h), 2.0 * h, 55.0 + h, 10.0) for h in (0, 1, 2, 30)]
    pairs = spark.createDataFrame(rows, "key_a long, key_b long, slot timestamp_ntz, separation_m double, sog_a double, sog_b double, latitude double, longitude double")
    out = d.encounter_episodes(pairs)
    assert "Join" not in plan(out)
    assert sorted((r.n_slots, r.median_sog, r.median_separation_m, r.latitude) for r in out.collect()) == [(1, 45.0, 130.0, 85.0), (3, 1.5, 101.0, 56.0)]


def test_movement_of_slots_is_what_the_context_join_finds(spark):
    rng = random.Random(7)
    rows = [(k, at(h), 55 + rng.randrange(4) / 100, 10.0, float(rng.randrange(5)), float(rng.randrange(5))) for k in range(6) for h in sorted(rng.sample(range(60), 25))]
    slots = spark.createDataFrame(rows, "mmsi long, slot timestamp_ntz, latitude double, longitude double, sog double, max_sog double")
    names = ("key_a", "key_b", "start_time", "approach_a", "approach_b", "departure_a", "departure_b")
    carried = d.encounter_episodes(d.pair_slots(d.slot_movement(slots, "mmsi", 5), "mmsi", 3.0, 2000.0))
    joined = d.context_slots(d.encounter_episodes(d.pair_slots(slots, "mmsi", 3.0, 2000.0)), slots, "mmsi", 5)
    got = sorted(map(tuple, carried.select(*names).collect()))
    assert got and got == sorted(map(tuple, joined.select(*names).collect()))


def test_pairs_list_five_cells_and_are_not_broadcast(spark):
    rng = random.Random(8)
    rows = [(i, rng.uniform(0, 9), rng.uniform(0, 9)) for i in range(200)] + [(7, 1.0, 1.0), (8, 1.0, 1.0)]
    near = lambda p, q: (p[1] - q[1]) ** 2 + (p[2] - q[2]) ** 2 <= 1
    from pyspark.sql import functions as F

    out = jn.proximity_pairs(spark.createDataFrame(rows, "id long, x double, y double"), "id", "x", "y", 1.0, F.expr("pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= 1"))
    assert sorted((r.a.id, r.b.id) for r in out.collect()) == sorted((p[0], q[0]) for p in rows for q in rows if p[0] < q[0] and near(p, q))
    assert "Broadcast" not in plan(out)


def test_verdicts_count_keys_without_meeting_them(spark, monkeypatch):
    import numpy as np

    rng = random.Random(9)
    x, y, a, b = (np.array([rng.randrange(30) for _ in range(n)]) for n in (70, 70, 40, 40))
    assert d.counted_below(x, y, a, b).tolist() == [int(((x < i) & (y <= j)).sum()) for i, j in zip(a, b)]
    assert d.counted_below(x[:0], y[:0], a, b).tolist() == [0] * 40
    heard = [(c, k, at(h + m / 60)) for c, k, h, m in ((rng.choice("abc"), rng.randrange(12), rng.randrange(200), rng.randrange(60)) for _ in range(700))]
    gaps = [(i, i % 14, at(s := rng.uniform(60, 190)), at(s + rng.choice((0.2, 3, 30)))) for i in range(60)]
    cells = [(i, c) for i, *_ in gaps for c in rng.sample("abcd", 1 + i % 3)]
    seen = d.presence(spark.createDataFrame(heard, "cell string, k long, t timestamp_ntz"), ["cell"], "t", "k")
    out = d.liveness_verdict(spark.createDataFrame(gaps, "gap long, k long, gap_start timestamp_ntz, gap_end timestamp_ntz"), spark.createDataFrame(cells, "gap long, cell string"), seen, ["gap"], ["cell"], "k", baseline_days=3)
    rows = [(r.cell, r.k, r.cell_hour, r.first_seen, r.last_seen) for r in seen.collect()]
    for r in out.collect():
        mine = [q for q in rows if (r.gap, q[0]) in cells and q[1] != r.k]
        alive = {q[1] for q in mine if q[4] >= r.gap_start and q[3] <= r.gap_end}
        before = [q[1] for q in mine if 1 <= (r.gap_start.date() - q[2].date()).days <= 3]
        hours = (r.gap_end - r.gap_start).total_seconds() / 3600
        assert (r.n_corroborators, r.n_baseline) == (len(alive), len(set(before))) and abs(r.expected - len(before) / 72 * hours) < 1e-9


def test_listed_buckets_are_not_broadcast(spark):
    df = spark.createDataFrame([(1, at(0), at(30)), (2, at(29), at(31)), (3, at(40), at(41))], "id long, s timestamp_ntz, e timestamp_ntz")
    out = jn.overlapping_pairs(df, df, [], "s", "e")
    assert sorted((r.l.id, r.r.id) for r in out.collect()) == [(1, 1), (1, 2), (2, 1), (2, 2), (3, 3)]
    assert "Broadcast" not in plan(out)


def test_episodes_of_slots_are_those_of_pairs(spark, monkeypatch):
    from tidemark.operators import meetings as mt

    rng = random.Random(12)
    rows = [(k, at(h / 6), 55 + rng.randrange(9) / 200, (180.0 if k % 9 == 0 else 10.0) + rng.randrange(9) / 100, float(rng.randrange(5)), float(rng.randrange(5))) for k in range(14) for h in sorted(rng.sample(range(160), 60))] + [(None, at(0), 55.0, 10.0, 1.0, 1.0), (3, at(0.01), None, 10.0, 1.0, 1.0)]
    slots = d.slot_movement(spark.createDataFrame(rows, "mmsi long, slot timestamp_ntz, latitude double, longitude double, sog double, max_sog double"), "mmsi", 5)
    told = lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())
    for frame in (slots, slots.drop("before", "after"), slots.withColumn("mmsi", slots.mmsi.cast("string"))):
        pairs = d.pair_slots(frame, "mmsi", 3.0, 1500.0, 0.05)
        found = mt.slot_pairs(frame, "mmsi", 3.0, 1500.0)
        assert found.dtypes == pairs.dtypes and told(found) == told(pairs)
        want = d.encounter_episodes(pairs)
        monkeypatch.setattr(mt, "GROUP_SLOTS", 100)
        got = mt.slot_episodes(frame, "mmsi", 3.0, 1500.0)
        assert got.dtypes == want.dtypes and told(got) == told(want) and got.count() > 50
    # slots are dealt by pairs of groups, and no pair is exchanged
    assert "hashpartitioning(x" in plan(got) and "hashpartitioning(key_a" not in plan(got) and "Join" not in plan(got)


def test_near_rows_are_those_of_brute_force(monkeypatch):
    import numpy as np

    from tidemark.operators import meetings as mt

    monkeypatch.setattr(mt, "CHUNK_PAIRS", 50)
    rng = np.random.default_rng(3)
    for lat0, lon0, spread, far in ((0, 0, 2, 30_000), (60, -180, 360, 900_000), (89, -180, 360, 400_000), (-50, 100, 1, 20_000)):
        n = 90
        code, slot, own = rng.integers(0, 20, n), rng.integers(0, 3, n), rng.random(n) < 0.6
        lat, lon = lat0 + rng.random(n), lon0 + rng.random(n) * spread
        for within in (True, False):
            got = [(int(i), int(j)) for a, b, _ in mt.near(code, slot, lat, lon, own, within, far) for i, j in zip(a, b)]
            want = {(i, j) for i in range(n) for j in range(n) if own[i] and slot[i] == slot[j] and (within and code[i] < code[j] if own[j] else code[i] != code[j]) and spark_haversine(lat[i], lon[i], lat[j], lon[j]) <= far}
            assert want and set(got) == want and len(got) == len(want)


def test_rows_that_differ_in_their_id_alone_are_looked_at_once(spark):
    from pyspark.sql import functions as F

    rng = random.Random(13)
    rows = [(i, float(rng.randrange(6)), float(rng.randrange(6)), rng.choice("pq")) for i in range(120)] + [(7, 1.0, 1.0, "p"), (None, 1.0, 1.0, "p"), (500, None, 1.0, "p")]
    d2 = F.expr("pow(a.x - b.x, 2) + pow(a.y - b.y, 2)")
    out = jn.proximity_pairs(spark.createDataFrame(rows, "id long, x double, y double, k string").repartition(3), "id", "x", "y", 1.5, (d2 <= 2) & (F.col("a.k") <= F.col("b.k")), values={"d": d2})
    far = lambda p, q: (p[1] - q[1]) ** 2 + (p[2] - q[2]) ** 2
    whole = [p for p in rows if None not in p]
    want = sorted((p, q, far(p, q)) for p in whole for q in whole if p[0] < q[0] and p[3] <= q[3] and far(p, q) <= 2)
    assert sorted((tuple(r.a), tuple(r.b), r.d) for r in out.collect()) == want
    # ids are put together before rows meet, and parted after
    text = plan(out).split("Initial Plan")[0]
    assert text.index("Generate explode(__j") < text.index("SortMergeJoin") < text.index("collect_list")
