"""Queries of the domain operators; registered on import.

The driver has no positions, so events become some by a fixed rule: `_P` in SQL, `_positions` in
Spark. What is compared is the operators, on rows that grow with the table.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import columns as fn
from tidemark.operators import detectors as dt
from tidemark.operators import features as ft
from tidemark.operators import identity as ident
from tidemark.operators import meetings as mt
from tidemark.operators import timeline as tl
from tidemark.plans.catalogue import _SESSIONS, _sessions, query, r6

_P = """p AS (SELECT event_id, 219000000 + user_id AS mmsi, ts AS timestamp, 54 + (value * 37 % 400) / 100 AS latitude, 8 + (value * 53 % 1200) / 100 AS longitude,
 value % 5 AS sog, value * 11 % 360 AS cog, 6 + value % 7 AS draught, CAST(ts AS DATE) AS date, event_type AS name,
 lpad(CAST((user_id % 60) * 166667 % 10000000 AS VARCHAR), 7, '0') AS imo, CASE user_id % 4 WHEN 0 THEN 'Tanker' WHEN 1 THEN 'Cargo' WHEN 2 THEN 'Fishing' ELSE 'Tug' END AS ship_type FROM events)"""


def _hav(a1, o1, a2, o2):
    a = f"(pow(sin(radians({a2} - {a1}) / 2), 2) + cos(radians({a1})) * cos(radians({a2})) * pow(sin(radians({o2} - {o1}) / 2), 2))"
    return f"(2 * 6371000.0 * asin(sqrt(CASE WHEN {a} > 1 THEN 1 ELSE {a} END)))"


def _positions(read):
    v, u = F.col("value"), F.col("user_id")
    kind = F.when(u % 4 == 0, "Tanker").when(u % 4 == 1, "Cargo").when(u % 4 == 2, "Fishing").otherwise("Tug")
    imo = F.lpad(((u % 60) * 166667 % 10000000).cast("string"), 7, "0")
    return read("events").select(
        "event_id", (u + 219000000).alias("mmsi"), F.col("ts").alias("timestamp"), (54 + (v * 37 % 400) / 100).alias("latitude"), (8 + (v * 53 % 1200) / 100).alias("longitude"), (v % 5).alias("sog"),
        (v * 11 % 360).alias("cog"), (6 + v % 7).alias("draught"), F.col("ts").cast("date").alias("date"), F.col("event_type").alias("name"), imo.alias("imo"), kind.alias("ship_type"),
    )


@query("""WITH r AS (SELECT event_id, CASE WHEN user_id % 10 = 0 THEN 100 ELSE 219000000 + user_id END AS k, date_trunc('hour', ts) AS t, CASE WHEN event_type = 'error' THEN 0.0 ELSE floor(value / 100) END AS la, CASE WHEN event_type = 'error' THEN 0.0 ELSE 10.0 END AS lo FROM events),
g AS (SELECT k, t, la, lo, count(*) AS n, k BETWEEN 200000000 AND 799999999 AS okk, NOT (la = 0 AND lo = 0) AS okp FROM r GROUP BY ALL)
SELECT CAST(sum(n) AS BIGINT) AS n_in, CAST(coalesce(sum(n) FILTER (NOT okk), 0) AS BIGINT) AS n_bad_key, CAST(coalesce(sum(n) FILTER (okk AND NOT okp), 0) AS BIGINT) AS n_bad_position, CAST(coalesce(sum(n - 1) FILTER (okk AND okp), 0) AS BIGINT) AS n_repeats, count(*) FILTER (okk AND okp) AS n_out FROM g""")
def clean_counts(read):
    bad = F.col("event_type") == "error"
    rows = read("events").select("event_id", F.when(F.col("user_id") % 10 == 0, 100).otherwise(F.col("user_id") + 219000000).alias("mmsi"), fn.time_bucket(F.col("ts"), 3600).alias("timestamp"), F.when(bad, 0.0).otherwise(F.floor(F.col("value") / 100).cast("double")).alias("latitude"), F.when(bad, 0.0).otherwise(10.0).alias("longitude"))
    return tl.clean_counts(rows, "event_id")


@query(f"""WITH {_P}, q AS (SELECT *, lag(timestamp) OVER w AS pt, lag(latitude) OVER w AS pla, lag(longitude) OVER w AS plo FROM p WINDOW w AS (PARTITION BY mmsi ORDER BY timestamp, event_id)),
s AS (SELECT mmsi, event_id, (epoch_us(timestamp) - epoch_us(pt)) / 1e6 AS sec, {_hav("pla", "plo", "latitude", "longitude")} / nullif((epoch_us(timestamp) - epoch_us(pt)) / 1e6, 0) / (1852.0 / 3600.0) AS kn FROM q WHERE pt IS NOT NULL)
SELECT mmsi, event_id, round(sec, 6) AS elapsed_seconds, round(kn, 4) AS speed_knots, round(CASE WHEN kn >= 100 THEN 1 ELSE (kn - 50) / 50 END, 6) AS confidence FROM s WHERE sec >= 60 AND kn > 50""")
def impossible_speed(read):
    out = dt.impossible_speed(_positions(read), "mmsi", "timestamp", "latitude", "longitude", tie=["event_id"])
    return out.select("mmsi", "event_id", r6("elapsed_seconds").alias("elapsed_seconds"), F.round("speed_knots", 4).alias("speed_knots"), r6("confidence").alias("confidence"))


@query(f"""WITH {_P}, h AS (SELECT mmsi, event_id, date_trunc('day', timestamp) AS t, latitude, longitude FROM p)
SELECT a.mmsi, a.t AS timestamp, a.event_id AS event_id_a, b.event_id AS event_id_b, round({_hav("a.latitude", "a.longitude", "b.latitude", "b.longitude")}, 3) AS distance_m,
 round(CASE WHEN {_hav("a.latitude", "a.longitude", "b.latitude", "b.longitude")} >= 5000 THEN 1 ELSE {_hav("a.latitude", "a.longitude", "b.latitude", "b.longitude")} / 5000 END, 6) AS confidence
FROM h a JOIN h b ON a.mmsi = b.mmsi AND a.t = b.t AND a.event_id < b.event_id WHERE {_hav("a.latitude", "a.longitude", "b.latitude", "b.longitude")} > 500""")
def simultaneous_positions(read):
    p = _positions(read).withColumn("timestamp", fn.time_bucket(F.col("timestamp"), 86400))
    out = dt.simultaneous_positions(p, "mmsi", "timestamp", "latitude", "longitude", "event_id")
    return out.select("mmsi", "timestamp", "event_id_a", "event_id_b", F.round("distance_m", 3).alias("distance_m"), r6("confidence").alias("confidence"))


@query(f"""WITH {_P}, q AS (SELECT lag(latitude) OVER w AS la, lag(longitude) OVER w AS lo, lag(ship_type) OVER w AS ship_type, (epoch_us(timestamp) - epoch_us(lag(timestamp) OVER w)) / 1e6 AS s FROM p WINDOW w AS (PARTITION BY mmsi ORDER BY timestamp))
SELECT round(floor(la / 0.5 + 1e-9) * 0.5, 6) AS cell_lat, round(floor(lo / 0.5 + 1e-9) * 0.5, 6) AS cell_lon, ship_type, count(*) AS n_pairs, count(*) FILTER (s <= 7200) AS n_short_pairs, round(CASE WHEN count(*) >= 5 THEN count(*) FILTER (s <= 7200) / count(*) END, 6) AS coverage_probability FROM q WHERE s IS NOT NULL GROUP BY ALL""")
def coverage_map(read):
    out = dt.coverage_map(_positions(read), "mmsi", "timestamp", "latitude", "longitude", "ship_type", 0.5, 7200, 5)
    return out.withColumn("coverage_probability", r6("coverage_probability"))


@query(f"""WITH {_SESSIONS}, g AS (SELECT user_id, session_seq, end_time AS a, lead(start_time) OVER (PARTITION BY user_id ORDER BY session_seq) AS b FROM v),
h AS (SELECT *, (epoch_us(b) - epoch_us(a)) / 3.6e9 AS hours, CASE user_id % 3 WHEN 0 THEN 'receiver_alive' WHEN 1 THEN 'area_dark' ELSE 'no_evidence' END AS verdict, CAST(CASE user_id % 3 WHEN 0 THEN 0.9 WHEN 1 THEN 0.15 ELSE 0.5 END AS DOUBLE) AS pr FROM g WHERE b IS NOT NULL)
SELECT user_id, session_seq, verdict, round(CASE WHEN hours >= 12 THEN CASE WHEN pr < 0.4 THEN 0.4 WHEN pr > 0.6 THEN 0.6 ELSE pr END ELSE pr END, 6) AS probability FROM h""")
def gap_probability(read):
    g = tl.session_gaps(_sessions(read), "user_id")
    verdict = F.when(F.col("user_id") % 3 == 0, "receiver_alive").when(F.col("user_id") % 3 == 1, "area_dark").otherwise("no_evidence")
    hours = fn.seconds_between(F.col("gap_end"), F.col("gap_start")) / 3600
    return g.select("user_id", "session_seq", verdict.alias("verdict"), r6(dt.gap_probability(verdict, hours)).alias("probability"))


@query(f"""WITH {_P}, c AS (SELECT mmsi, timestamp, round(floor(latitude / 1.0 + 1e-9) * 1.0, 6) AS cell_lat, round(floor(longitude / 1.0 + 1e-9) * 1.0, 6) AS cell_lon FROM p WHERE sog < 4),
s AS (SELECT *, CASE WHEN lag(timestamp) OVER w IS NULL OR (epoch_us(timestamp) - epoch_us(lag(timestamp) OVER w)) / 1e6 > 432000 THEN 1 ELSE 0 END AS st FROM c WINDOW w AS (PARTITION BY mmsi, cell_lat, cell_lon ORDER BY timestamp)),
k AS (SELECT *, sum(st) OVER (PARTITION BY mmsi, cell_lat, cell_lon ORDER BY timestamp ROWS UNBOUNDED PRECEDING) AS stay FROM s),
t AS (SELECT mmsi, cell_lat, cell_lon, stay, CAST(min(timestamp) AS DATE) AS day, (epoch_us(max(timestamp)) - epoch_us(min(timestamp))) / 3.6e9 AS hours FROM k GROUP BY ALL),
d AS (SELECT cell_lat, cell_lon, mmsi, day, max(hours) AS hours FROM t GROUP BY ALL)
SELECT cell_lat, cell_lon, count(DISTINCT mmsi) AS n_vessels, count(*) AS n_vessel_days, round(sum(hours), 6) AS total_hours, array_to_string(list_sort(list_distinct(list(mmsi))), ',') AS members FROM d WHERE hours >= 3 GROUP BY cell_lat, cell_lon HAVING count(DISTINCT mmsi) >= 3""")
def anchorages(read):
    out = dt.anchorages(_positions(read), "mmsi", "timestamp", "latitude", "longitude", "sog", 1.0, 4.0, 432000, 3.0, 3)
    return out.select("cell_lat", "cell_lon", "n_vessels", "n_vessel_days", r6("total_hours").alias("total_hours"), F.array_join("members", ",").alias("members"))


_SLOTS = "sl AS (SELECT mmsi, time_bucket(INTERVAL 1 DAY, timestamp) AS slot, median(latitude) AS latitude, median(longitude) AS longitude, median(sog) AS sog, max(sog) AS max_sog FROM p GROUP BY ALL)"
_PAIRS = f"pr AS (SELECT a.mmsi AS key_a, b.mmsi AS key_b, a.slot, {_hav('a.latitude', 'a.longitude', 'b.latitude', 'b.longitude')} AS separation_m, a.sog AS sog_a, b.sog AS sog_b FROM sl a JOIN sl b ON a.slot = b.slot AND a.mmsi < b.mmsi WHERE a.sog <= 3 AND b.sog <= 3 AND {_hav('a.latitude', 'a.longitude', 'b.latitude', 'b.longitude')} <= 25000)"


@query(f"WITH {_P}, {_SLOTS} SELECT mmsi, slot, round(latitude, 6) AS latitude, round(longitude, 6) AS longitude, round(sog, 6) AS sog, round(max_sog, 6) AS max_sog FROM sl")
def slot_medians(read):
    out = dt.slots(_positions(read), "mmsi", "timestamp", "latitude", "longitude", "sog", 1440)
    return out.select("mmsi", "slot", *(r6(c).alias(c) for c in ("latitude", "longitude", "sog", "max_sog")))


def _pairs(read):
    return mt.slot_pairs(dt.slots(_positions(read), "mmsi", "timestamp", "latitude", "longitude", "sog", 1440), "mmsi", 3.0, 25_000.0)


@query(f"WITH {_P}, {_SLOTS}, {_PAIRS} SELECT key_a, key_b, slot, round(separation_m, 3) AS separation_m FROM pr")
def encounter_pair_slots(read):
    return _pairs(read).select("key_a", "key_b", "slot", F.round("separation_m", 3).alias("separation_m"))


@query(f"""WITH {_P}, {_SLOTS}, {_PAIRS}, f AS (SELECT *, CASE WHEN lag(slot) OVER w IS NULL OR date_diff('minute', lag(slot) OVER w, slot) > 1500 THEN 1 ELSE 0 END AS st FROM pr WINDOW w AS (PARTITION BY key_a, key_b ORDER BY slot)),
e AS (SELECT *, sum(st) OVER (PARTITION BY key_a, key_b ORDER BY slot ROWS UNBOUNDED PRECEDING) AS ep FROM f)
SELECT key_a, key_b, min(slot) AS start_time, max(slot) AS end_time, count(*) AS n_slots, round(median(separation_m), 3) AS median_separation_m, round((date_diff('minute', min(slot), max(slot)) + 1440) / 60, 6) AS duration_hours,
 round((SELECT median(s) FROM (SELECT unnest(list(e.sog_a) || list(e.sog_b)) AS s)), 6) AS median_sog FROM e GROUP BY key_a, key_b, ep""")
def encounter_episodes(read):
    slots = dt.slots(_positions(read), "mmsi", "timestamp", "latitude", "longitude", "sog", 1440)
    out = mt.slot_episodes(slots, "mmsi", 3.0, 25_000.0, 1500, 1440)
    return out.select("key_a", "key_b", "start_time", "end_time", "n_slots", F.round("median_separation_m", 3).alias("median_separation_m"), r6("duration_hours").alias("duration_hours"), r6("median_sog").alias("median_sog"))


_CROSS = """x AS (SELECT mmsi, timestamp AS t, CASE WHEN lag(longitude) OVER w < 14 AND longitude >= 14 THEN 'E' WHEN lag(longitude) OVER w >= 14 AND longitude < 14 THEN 'W' END AS d, (epoch_us(timestamp) - epoch_us(lag(timestamp) OVER w)) / 3.6e9 AS h
 FROM (SELECT * FROM p WHERE latitude BETWEEN 54.3 AND 58) WINDOW w AS (PARTITION BY mmsi ORDER BY timestamp)), cr AS (SELECT mmsi, t AS crossing_time, d AS direction FROM x WHERE d IS NOT NULL AND h <= 24)"""


def _crossings(read):
    return dt.gate_crossings(_positions(read), "mmsi", "timestamp", "latitude", "longitude", 14.0, 54.3, 58.0, 24.0)


@query(f"WITH {_P}, {_CROSS} SELECT * FROM cr")
def gate_crossings(read):
    return _crossings(read)


@query(f"WITH {_P}, {_CROSS} SELECT e.mmsi, e.crossing_time AS east_time, n.t AS west_time, date_diff('day', e.crossing_time, n.t) AS days FROM cr e, LATERAL (SELECT min(crossing_time) AS t FROM cr w WHERE w.mmsi = e.mmsi AND w.direction = 'W' AND w.crossing_time > e.crossing_time) n WHERE e.direction = 'E' AND n.t IS NOT NULL AND date_diff('day', e.crossing_time, n.t) BETWEEN 2 AND 30")
def round_trips(read):
    return dt.round_trips(_crossings(read), "mmsi")


_ROUND = "rt AS (SELECT e.mmsi, e.crossing_time AS east_time, n.t AS west_time FROM cr e, LATERAL (SELECT min(crossing_time) AS t FROM cr w WHERE w.mmsi = e.mmsi AND w.direction = 'W' AND w.crossing_time > e.crossing_time) n WHERE e.direction = 'E' AND n.t IS NOT NULL AND date_diff('day', e.crossing_time, n.t) BETWEEN 2 AND 30)"


@query(f"""WITH {_P}, {_CROSS}, {_ROUND}, d AS (SELECT rt.*, (SELECT median(draught) FROM p WHERE p.mmsi = rt.mmsi AND p.timestamp BETWEEN rt.east_time - INTERVAL 12 HOUR AND rt.east_time + INTERVAL 12 HOUR) AS de,
 (SELECT median(draught) FROM p WHERE p.mmsi = rt.mmsi AND p.timestamp BETWEEN rt.west_time - INTERVAL 12 HOUR AND rt.west_time + INTERVAL 12 HOUR) AS dw, (SELECT max(draught) FROM p WHERE p.mmsi = rt.mmsi AND p.timestamp < rt.west_time) AS dm FROM rt)
SELECT mmsi, east_time, west_time, round(de, 6) AS draught_east, round(dw, 6) AS draught_west, round(dm, 6) AS draught_max, round(CASE WHEN dm > 0 THEN (dw - de) / dm END, 6) AS rel_change FROM d""")
def trip_draughts(read):
    out = dt.trip_draughts(dt.round_trips(_crossings(read), "mmsi"), _positions(read), "mmsi", "timestamp", "draught")
    return out.select("mmsi", "east_time", "west_time", *(r6(c).alias(c) for c in ("draught_east", "draught_west", "draught_max", "rel_change")))


_STATE = "CASE {} WHEN 0 THEN 'moved' WHEN 1 THEN 'stationary' ELSE 'no_data' END"
_KIND = "CASE {} WHEN 0 THEN 'Tanker' WHEN 1 THEN 'Cargo' WHEN 2 THEN 'Towing' WHEN 3 THEN 'Fishing' END"
_STATUS = "CASE {} WHEN 0 THEN 'Moored' WHEN 1 THEN 'At anchor' WHEN 2 THEN 'Undefined' WHEN 3 THEN 'Under way using engine' END"


@query(f"""WITH r AS (SELECT l_orderkey, l_linenumber, {_STATE.format("l_partkey % 3")} AS aa, {_STATE.format("l_suppkey % 3")} AS ab, {_STATE.format("(l_partkey + l_linenumber) % 3")} AS da, {_STATE.format("l_orderkey % 3")} AS db, l_quantity * 15 AS drift,
 {_KIND.format("l_partkey % 5")} AS ta, {_KIND.format("l_suppkey % 5")} AS tb, {_STATUS.format("l_orderkey % 5")} AS sa, {_STATUS.format("l_partkey % 6")} AS sb, CASE WHEN l_tax > 0.02 THEN l_tax * 200000 END AS far, l_linenumber AS reps, l_quantity * 2 AS hours FROM lineitem),
s AS (SELECT *, (SELECT sum(CASE x WHEN 'moved' THEN 1.0 WHEN 'no_data' THEN 0.5 ELSE 0 END) / 4 FROM (SELECT unnest([aa, ab, da, db]) AS x)) AS rendezvous,
 CASE WHEN ta = 'Towing' OR tb = 'Towing' THEN 0.1 WHEN ta = 'Tanker' AND tb = 'Tanker' THEN 1.0 WHEN ta IN ('Tanker', 'Cargo') AND tb IN ('Tanker', 'Cargo') AND ta <> tb THEN 0.9 WHEN ta = 'Cargo' AND tb = 'Cargo' THEN 0.6 WHEN ta IN ('Tanker', 'Cargo') OR tb IN ('Tanker', 'Cargo') THEN 0.4 ELSE 0.2 END AS kind,
 (SELECT avg(CASE WHEN x IN ('Moored', 'At anchor') THEN CASE WHEN coalesce(far, 0) >= 10000 THEN 1.0 ELSE 0.0 END WHEN x IS NULL OR x = 'Undefined' THEN 0.5 ELSE 1.0 END) FROM (SELECT unnest([sa, sb]) AS x)) AS status FROM r)
SELECT l_orderkey, l_linenumber, round(0.35 * rendezvous + 0.2 * least(1, drift / 500) + 0.2 * kind + 0.1 * status + 0.1 * (CASE WHEN reps <= 1 THEN 1.0 WHEN reps = 2 THEN 0.5 ELSE 0 END) + 0.05 * (CASE WHEN hours <= 24 THEN 1 WHEN hours >= 72 THEN 0 ELSE 1 - (hours - 24) / 48 END), 6) AS confidence FROM s""")
def encounter_scores(read):
    """Confidence of encounters whose parts are dealt by the keys of each line."""
    c, pick = F.col, lambda x, values: F.element_at(F.array(*(F.lit(v) for v in values)), (x + 1).cast("int"))
    state = lambda x: pick(x % 3, ("moved", "stationary", "no_data"))
    kind = lambda x: pick(x % 5, ("Tanker", "Cargo", "Towing", "Fishing", None))
    status = lambda x, n: pick(x % n, ("Moored", "At anchor", "Undefined", "Under way using engine", None, None))
    score = dt.encounter_confidence(
        state(c("l_partkey")), state(c("l_suppkey")), state(c("l_partkey") + c("l_linenumber")), state(c("l_orderkey")), c("l_quantity") * 15, kind(c("l_partkey")), kind(c("l_suppkey")), status(c("l_orderkey"), 5), status(c("l_partkey"), 6),
        F.when(c("l_tax") > 0.02, c("l_tax") * 200000), c("l_linenumber"), c("l_quantity") * 2,
    )
    return read("lineitem").select("l_orderkey", "l_linenumber", r6(score).alias("confidence"))


@query(f"""WITH {_P} SELECT a.event_id, count(*) AS n_same_place FROM p a JOIN p b ON a.mmsi = b.mmsi AND {_hav("a.latitude", "a.longitude", "b.latitude", "b.longitude")} <= 20000 GROUP BY a.event_id""")
def same_place_counts(read):
    return dt.same_place_counts(_positions(read), ["mmsi"], "latitude", "longitude", 20_000.0).select("event_id", "n_same_place")


_EPISODES = f"""f AS (SELECT *, CASE WHEN lag(slot) OVER w IS NULL OR date_diff('minute', lag(slot) OVER w, slot) > 1500 THEN 1 ELSE 0 END AS st FROM pr WINDOW w AS (PARTITION BY key_a, key_b ORDER BY slot)),
ep AS (SELECT key_a, key_b, min(slot) AS s, max(slot) AS e FROM (SELECT *, sum(st) OVER (PARTITION BY key_a, key_b ORDER BY slot ROWS UNBOUNDED PRECEDING) AS k FROM f) GROUP BY key_a, key_b, k),
cx AS (SELECT ep.key_a, ep.key_b, ep.s, ep.e, side, phase, arg_min(latitude, slot) AS la0, arg_min(longitude, slot) AS lo0, arg_max(latitude, slot) AS la1, arg_max(longitude, slot) AS lo1, max(max_sog) AS v
 FROM ep, (VALUES ('a'), ('b')) x(side), (VALUES ('approach'), ('departure')) y(phase) JOIN sl ON sl.mmsi = CASE side WHEN 'a' THEN ep.key_a ELSE ep.key_b END
  AND CASE phase WHEN 'approach' THEN sl.slot >= ep.s - INTERVAL 3 DAY AND sl.slot < ep.s ELSE sl.slot > ep.e AND sl.slot <= ep.e + INTERVAL 3 DAY END GROUP BY ALL),
st AS (SELECT key_a, key_b, s, e, phase || '_' || side AS which, CASE WHEN {_hav("la0", "lo0", "la1", "lo1")} >= 2000 OR v >= 3 THEN 'moved' ELSE 'stationary' END AS state FROM cx)"""


@query(f"""WITH {_P}, {_SLOTS}, {_PAIRS}, {_EPISODES} SELECT ep.key_a, ep.key_b, ep.s AS start_time, """ + ", ".join(f"coalesce(max(state) FILTER (which = '{w}'), 'no_data') AS {w}" for w in ("approach_a", "approach_b", "departure_a", "departure_b")) + """
 FROM ep LEFT JOIN st ON st.key_a = ep.key_a AND st.key_b = ep.key_b AND st.s = ep.s GROUP BY ep.key_a, ep.key_b, ep.s""")
def encounter_context(read):
    slots = dt.slot_movement(dt.slots(_positions(read), "mmsi", "timestamp", "latitude", "longitude", "sog", 1440), "mmsi", 72)
    out = mt.slot_episodes(slots, "mmsi", 3.0, 25_000.0, 1500, 1440)
    return out.select("key_a", "key_b", "start_time", "approach_a", "approach_b", "departure_a", "departure_b")


_VALID = "regexp_full_match(imo, '[0-9]{7}') AND imo <> '0000000' AND (7 * CAST(imo[1] AS INT) + 6 * CAST(imo[2] AS INT) + 5 * CAST(imo[3] AS INT) + 4 * CAST(imo[4] AS INT) + 3 * CAST(imo[5] AS INT) + 2 * CAST(imo[6] AS INT)) % 10 = CAST(imo[7] AS INT)"


@query(f"""WITH {_P}, a AS (SELECT mmsi, imo, count(*) AS message_count, min(date) AS first_seen, max(date) AS last_seen FROM p WHERE {_VALID} GROUP BY mmsi, imo),
o AS (SELECT mmsi, NULL AS imo, count(*) AS message_count, min(date) AS first_seen, max(date) AS last_seen FROM p WHERE mmsi NOT IN (SELECT mmsi FROM a) GROUP BY mmsi)
SELECT mmsi, imo, message_count, first_seen, last_seen, is_orphaned, count(imo) OVER (PARTITION BY mmsi) > 1 AS is_reused FROM (SELECT *, false AS is_orphaned FROM a UNION ALL SELECT *, true FROM o)""")
def resolve_identity(read):
    return ident.resolve_identity(_positions(read))


@query(f"""WITH {_P}, i AS (SELECT mmsi, date, name, min(timestamp) AS mn, max(timestamp) AS mx FROM p GROUP BY ALL),
o AS (SELECT *, coalesce(max(mx) OVER (PARTITION BY mmsi, date ORDER BY mn, mx, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= mn, false) AS ov FROM i),
k AS (SELECT mmsi, date FROM o GROUP BY ALL HAVING count(*) > 1 AND count(*) FILTER (ov) = 0)
SELECT mmsi, date, old_value, name AS new_value, mn AS event_time FROM (SELECT i.*, lag(name) OVER (PARTITION BY i.mmsi, i.date ORDER BY mn, name) AS old_value FROM i JOIN k USING (mmsi, date)) WHERE old_value IS NOT NULL""")
def value_changes(read):
    return ident.value_changes(ident.value_intervals(_positions(read), ["mmsi", "date"], "name", "timestamp"), ["mmsi", "date"], "name")


@query(f"WITH {_P} SELECT mmsi, count(*) AS n_messages, min(timestamp) AS first_seen, max(timestamp) AS last_seen FROM p GROUP BY mmsi HAVING bool_or(ship_type IN ('Tanker', 'Cargo')) AND NOT bool_or({_VALID}) AND count(*) >= 20 AND (epoch_us(max(timestamp)) - epoch_us(min(timestamp))) / 8.64e10 >= 3")
def no_valid_imo(read):
    return dt.no_valid_imo(_positions(read), "mmsi", "timestamp", "imo", "ship_type")


@query(f"""WITH {_P}, f AS (SELECT *, (epoch_us(timestamp) - epoch_us(lag(timestamp) OVER w)) / 1e6 AS s, {_hav("lag(latitude) OVER w", "lag(longitude) OVER w", "latitude", "longitude")} AS m FROM p WINDOW w AS (PARTITION BY mmsi ORDER BY timestamp))
SELECT mmsi, event_id, CAST(sum(CASE WHEN s IS NULL OR s > 36000 OR (s >= 300 AND m / nullif(s, 0) / (1852.0 / 3600.0) > 40) THEN 1 ELSE 0 END) OVER (PARTITION BY mmsi ORDER BY timestamp ROWS UNBOUNDED PRECEDING) AS BIGINT) AS trip FROM f""")
def track_trips(read):
    return dt.tracks(_positions(read), "mmsi", "timestamp", "latitude", "longitude", 600.0).select("mmsi", "event_id", F.col("trip").cast("long").alias("trip"))


@query(f"WITH {_P} SELECT CAST(floor(longitude / 0.5) AS BIGINT) AS px, CAST(floor(degrees(ln(tan(3.141592653589793 / 4 + radians(latitude) / 2))) / 0.5) AS BIGINT) AS py, count(DISTINCT mmsi) AS n_vessels FROM p GROUP BY ALL")
def vessel_density(read):
    return dt.vessel_density(_positions(read), "mmsi", "latitude", "longitude", 0.5)


_TRIPS = f"{_SESSIONS}, tr AS (SELECT 219000000 + user_id AS mmsi, (219000000 + user_id) || '-' || session_seq AS voyage_id, start_time, end_time FROM v)"


def _trips(read):
    key = F.col("user_id") + 219000000
    return _sessions(read).select(key.alias("mmsi"), F.concat(key.cast("string"), F.lit("-"), F.col("session_seq").cast("string")).alias("voyage_id"), "start_time", "end_time")


@query(f"WITH {_TRIPS}, {_P} SELECT p.mmsi, p.event_id, tr.voyage_id FROM p ASOF JOIN tr ON p.mmsi = tr.mmsi AND p.timestamp >= tr.start_time")
def attach_trips(read):
    return dt.attach_trips(_positions(read).select("mmsi", "event_id", "timestamp"), _trips(read), "mmsi", "timestamp").select("mmsi", "event_id", "voyage_id")


@query(f"""WITH {_TRIPS}, {_P}, m AS (SELECT tr.mmsi, tr.voyage_id, tr.start_time, tr.end_time, median(draught) AS d FROM tr JOIN p ON p.mmsi = tr.mmsi AND p.timestamp BETWEEN tr.start_time AND tr.end_time WHERE draught > 0 GROUP BY ALL HAVING count(*) >= 2),
q AS (SELECT *, lag(voyage_id) OVER w AS prev_voyage_id, lag(end_time) OVER w AS prev_end_time, d - lag(d) OVER w AS change_m FROM m WINDOW w AS (PARTITION BY mmsi ORDER BY start_time))
SELECT mmsi, prev_voyage_id, voyage_id, prev_end_time, start_time AS event_time, round(change_m, 6) AS change_m FROM q WHERE abs(change_m) >= 1""")
def draught_changes(read):
    return dt.draught_changes(_trips(read), _positions(read), "mmsi", "timestamp", "draught", 2, 1.0).withColumn("change_m", r6("change_m"))


@query("""SELECT p_brand, round(median(p_size) FILTER (p_size > 0), 6) AS median_length, round(median(p_retailprice) FILTER (p_retailprice > 0), 6) AS median_width, max(p_retailprice) AS max_draught, round(max(p_retailprice) - min(p_retailprice) FILTER (p_retailprice > 0), 6) AS draught_range,
 bool_or(regexp_matches(upper(trim(coalesce(p_name, ''))), '(FOR ORDER|\\bOPL\\b)')) AS any_for_orders, bool_or(upper(trim(coalesce(p_name, ''))) IN ('', 'UNKNOWN')) AS any_blank, count(DISTINCT upper(trim(p_name))) FILTER (upper(trim(coalesce(p_name, ''))) NOT IN ('', 'UNKNOWN')) AS n_destinations FROM part GROUP BY p_brand""")
def static_features(read):
    out = ft.static_features(read("part"), "p_brand", "p_size", "p_retailprice", "p_retailprice", "p_name")
    return out.withColumns({c: r6(F.col(c).cast("double")) for c in ("median_length", "median_width", "draught_range")})


@query("""WITH m AS (SELECT user_id, CAST(ym AS DATE) AS year_month, least(last_day(ym), DATE '2024-02-20') AS month_end FROM (SELECT DISTINCT user_id FROM events), (SELECT unnest(generate_series(DATE '2023-12-01', DATE '2024-02-01', INTERVAL 1 MONTH)) AS ym)),
c AS (SELECT user_id, year_month, month_end, count(event_id) FILTER (event_type = 'error') AS n_errors, count(event_id) FILTER (value > 100) AS n_large FROM m LEFT JOIN events USING (user_id) WHERE ts < CAST(month_end AS TIMESTAMP) + INTERVAL 1 DAY OR ts IS NULL GROUP BY ALL),
k AS (SELECT m.*, coalesce(n_errors, 0) AS n_errors, coalesce(n_large, 0) AS n_large FROM m LEFT JOIN c USING (user_id, year_month, month_end)),
x AS (SELECT user_id, CAST(date_trunc('month', ts) AS DATE) AS year_month, count(DISTINCT date_trunc('hour', ts)) AS hours_present, count(DISTINCT CAST(ts AS DATE)) AS days_present FROM events GROUP BY ALL),
l AS (SELECT user_id, CAST(min(ts) AS DATE) AS label_date FROM events WHERE event_type = 'purchase' AND value > 150 GROUP BY user_id)
SELECT user_id, year_month, month_end, n_errors, n_large, coalesce(hours_present, 0) AS hours_present, coalesce(days_present, 0) AS days_present, round(n_errors / nullif(coalesce(days_present, 0), 0), 6) AS n_errors_per_day, round(100 * n_errors / nullif(coalesce(hours_present, 0), 0), 6) AS n_errors_per_100h,
 round(n_large / nullif(coalesce(days_present, 0), 0), 6) AS n_large_per_day, round(100 * n_large / nullif(coalesce(hours_present, 0), 0), 6) AS n_large_per_100h, coalesce(label_date <= month_end, false) AS label_is_known, coalesce(label_date > month_end, false) AS label_comes_later
FROM k LEFT JOIN x USING (user_id, year_month) LEFT JOIN l USING (user_id)""")
def vessel_month_panel(read):
    e = read("events")
    spine = ft.month_spine(e.select("user_id").distinct(), "2023-12-01", "2024-02-20")
    labels = e.where("event_type = 'purchase' and value > 150").groupBy("user_id").agg(F.min("ts").cast("date").alias("label_date"))
    seen = dt.presence(e, [], "ts", "user_id")
    out = ft.panel(spine, "user_id", {"n_errors": (e, "ts", F.col("event_type") == "error"), "n_large": (e, "ts", F.col("value") > 100)}, seen, labels)
    return out.withColumns({c: r6(c) for c in out.columns if "_per_" in c})


@query(f"""WITH {_P}, t AS (SELECT mmsi, date_trunc('hour', timestamp) AS hour, count(*) AS n, avg(latitude) AS lat, avg(longitude) AS lon, avg(sog) AS sog, stddev_pop(sog) AS sd, degrees(atan2(avg(sin(radians(cog))), avg(cos(radians(cog))))) AS heading, median(draught) FILTER (draught > 0) AS draught FROM p GROUP BY ALL)
SELECT mmsi, CAST(hour AS TIMESTAMP) AS hour, n, round(sog, 6) AS sog, round(sd, 6) AS sog_sd, round(draught - last_value(draught IGNORE NULLS) OVER (PARTITION BY mmsi ORDER BY hour ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 6) + 0 AS draught_step,
 round((epoch_us(hour) - epoch_us(lag(hour) OVER (PARTITION BY mmsi ORDER BY hour))) / 3.6e9, 6) AS hours_since, CAST(((lat >= 55.5)::INT + (lat >= 57.3)::INT) * 4 + (lon >= 9)::INT + (lon >= 11)::INT + (lon >= 13)::INT AS INTEGER) AS region FROM t""")
def track_tokens(read):
    out = ft.track_tokens(_positions(read), "mmsi", "timestamp", "latitude", "longitude", "sog", "cog", "draught")
    return out.select("mmsi", "hour", "n", r6("sog").alias("sog"), r6("sog_sd").alias("sog_sd"), (r6("draught_step") + 0.0).alias("draught_step"), r6("hours_since").alias("hours_since"), "region")


@query("""WITH a AS (SELECT user_id, 'buy' AS kind, ts AS event_time FROM events WHERE event_type = 'purchase' UNION ALL SELECT user_id, 'fail', ts FROM events WHERE event_type = 'error')
SELECT user_id, kind, event_time, CAST(CASE WHEN h < 0 THEN 0 WHEN h > 479 THEN 479 ELSE h END AS BIGINT) AS hour_idx, rn AS rank FROM (SELECT *, floor((epoch_us(event_time) - epoch_us(TIMESTAMP '2024-01-05')) / 3.6e9) AS h, row_number() OVER (PARTITION BY user_id ORDER BY event_time DESC, kind) AS rn FROM a) WHERE rn <= 10""")
def event_tokens(read):
    e = read("events")
    return ft.event_tokens({"buy": (e.where("event_type = 'purchase'"), "ts"), "fail": (e.where("event_type = 'error'"), "ts")}, "user_id", "2024-01-05 00:00:00", 480, 10)


@query("""WITH w AS (SELECT user_id, CAST(ts AS DATE) AS day, CAST(bool_or(event_type = 'error') AS INT) AS f FROM events GROUP BY ALL)
SELECT user_id, day, count(f) OVER k AS n_prior, round(avg(f) OVER k, 6) AS prior_share FROM w WINDOW k AS (PARTITION BY user_id ORDER BY day ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)""")
def prior_window_share(read):
    e = read("events").withColumn("day", F.col("ts").cast("date"))
    return ft.prior_share(e, "user_id", "day", F.col("event_type") == "error").withColumn("prior_share", r6("prior_share"))


@query("""WITH c AS (SELECT DISTINCT user_id, TIMESTAMP '2024-01-20' AS cutoff FROM events), r AS (SELECT c.user_id, c.cutoff, e.ts, e.event_type FROM c LEFT JOIN events e ON e.user_id = c.user_id AND e.ts < c.cutoff AND e.ts >= c.cutoff - INTERVAL 10 DAY)
SELECT user_id, cutoff, count(ts) AS n_visits, count(DISTINCT event_type) AS n_flags, count(*) FILTER (event_type IN ('view', 'click')) AS n_light, CAST(least(floor((epoch_us(cutoff) - epoch_us(max(ts) FILTER (event_type IN ('view', 'click')))) / 8.64e10), CASE WHEN max(ts) FILTER (event_type IN ('view', 'click')) IS NULL THEN 10 ELSE 10 END) AS BIGINT) AS days_since_light FROM r GROUP BY user_id, cutoff""")
def visit_features(read):
    e = read("events")
    cut = e.select("user_id").distinct().withColumn("cutoff", F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"))
    return ft.visit_features(e.select("user_id", "ts", "event_type"), cut, "user_id", "ts", "event_type", {"light": ["view", "click"]}, lookback_days=10)


@query("""WITH s AS (SELECT user_id, ts, event_type FROM events), r AS (SELECT *, TIMESTAMP '2024-01-20' AS cutoff, ts < TIMESTAMP '2024-01-15' AS early FROM s WHERE ts < TIMESTAMP '2024-01-20'),
a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, early ORDER BY ts DESC) AS rn FROM r) WHERE NOT early OR rn = 1),
g AS (SELECT *, row_number() OVER w > 1 AND event_type IS DISTINCT FROM lag(event_type) OVER w AS ch FROM a WINDOW w AS (PARTITION BY user_id ORDER BY ts))
SELECT user_id, cutoff, count(DISTINCT event_type) AS n_event_type, count(*) FILTER (ch) AS n_event_type_changes, round((epoch_us(cutoff) - epoch_us(coalesce(max(ts) FILTER (ch), min(ts)))) / 8.64e10, 6) AS state_age_days FROM g GROUP BY user_id, cutoff""")
def identity_history(read):
    e = read("events").select("user_id", "ts", "event_type")
    cut = e.select("user_id").distinct().withColumn("cutoff", F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"))
    return ft.identity_history(e, cut, "user_id", "ts", ["event_type"], 5).withColumn("state_age_days", r6("state_age_days"))


@query("""WITH s AS (SELECT s_suppkey, s_nationkey * 4.0 AS cx, s_acctbal / 100 AS cy FROM supplier), p AS (SELECT p_partkey, (p_partkey % 100) * 1.0 + 0.25 AS x, p_retailprice % 100 + 0.003 AS y FROM part)
SELECT p_partkey, s_suppkey FROM p JOIN s ON abs(x - cx) / 9.0 + abs(y - cy) / 11.0 < 1 AND NOT abs(x - cx) / 3.0 + abs(y - cy) / 4.0 < 1""")
def point_in_polygon(read):
    """Diamonds with a diamond hole around each supplier."""
    from tidemark.operators.geometry import points_in_polygons, polygon_edges

    cx, cy = F.col("s_nationkey") * 4.0, F.col("s_acctbal") / 100
    at = lambda dx, dy: F.struct((cx + dx).alias("x"), (cy + dy).alias("y"))
    diamond = lambda a, b: F.array(at(a, 0.0), at(0.0, b), at(-a, 0.0), at(0.0, -b), at(a, 0.0))
    polygons = read("supplier").select("s_suppkey", F.array(diamond(9.0, 11.0), diamond(3.0, 4.0)).alias("rings"))
    points = read("part").select("p_partkey", ((F.col("p_partkey") % 100) * 1.0 + 0.25).alias("x"), (F.col("p_retailprice") % 100 + 0.003).alias("y"))
    return points_in_polygons(points, polygon_edges(polygons, "s_suppkey", "rings"), "p_partkey", "x", "y", "s_suppkey", 4.0)


_LAND = """c AS (SELECT s_suppkey AS polygon, 8 + (s_acctbal * 13 % 1200) / 100 AS cx, 54 + (s_acctbal * 7 % 400) / 100 AS cy FROM supplier),
k AS (SELECT * FROM (VALUES (0.2, 0.1, 1), (0.05, 0.03, 2)) k(a, b, ring)),
v AS (SELECT polygon, ring, unnest([1, 2, 3, 4]) AS i, unnest([cx + a, cx, cx - a, cx]) AS x1, unnest([cy, cy + b, cy, cy - b]) AS y1, unnest([cx, cx - a, cx, cx + a]) AS x2, unnest([cy + b, cy, cy - b, cy]) AS y2 FROM c, k)"""


def _to_land(points: str, reach: str) -> str:
    """SQL for each row (id, px, py) of points: whether land holds it, and metres to the nearest outline."""
    t = "CASE WHEN l = 0 THEN 0 ELSE greatest(0, least(1, (ax * dx + ay * dy) / l)) END"
    return f"""m AS (SELECT *, dx * dx + dy * dy AS l FROM (SELECT p.*, v.*, (x2 - x1) * cos(radians(py)) AS dx, y2 - y1 AS dy, (px - x1) * cos(radians(py)) AS ax, py - y1 AS ay FROM {points} p, v)),
n AS (SELECT id, polygon, sum(CAST((y1 > py) <> (y2 > py) AND px < (x2 - x1) * (py - y1) / (y2 - y1) + x1 AS INT)) % 2 = 1 AS held, min({_hav("py", "px", f"(y1 + {t} * (y2 - y1))", f"(x1 + {t} * (x2 - x1))")}) AS far FROM m GROUP BY id, polygon),
d AS (SELECT id, bool_or(held) AS on_land, CASE WHEN bool_or(held) THEN 0 WHEN min(far) <= {reach} THEN min(far) END AS distance_m FROM n GROUP BY id)"""


def _land(read):
    """Diamonds with a diamond hole, one for each supplier."""
    b = F.col("s_acctbal")
    cx, cy = 8 + (b * 13 % 1200) / 100, 54 + (b * 7 % 400) / 100
    at = lambda dx, dy: F.struct((cx + dx).alias("x"), (cy + dy).alias("y"))
    diamond = lambda a, b: F.array(at(a, 0.0), at(0.0, b), at(-a, 0.0), at(0.0, -b), at(a, 0.0))
    return read("supplier").select(F.col("s_suppkey").alias("polygon"), F.array(diamond(0.2, 0.1), diamond(0.05, 0.03)).alias("rings"))


@query(f"""WITH {_LAND}, p AS (SELECT p_partkey AS id, 8 + (p_partkey * 17 % 1200) / 100 + 0.003 AS px, 54 + (p_retailprice * 7 % 400) / 100 + 0.001 AS py FROM part), {_to_land("p", "30000")}
SELECT id AS p_partkey, on_land, round(distance_m, 3) AS distance_m FROM d""")
def land_distance(read):
    """Each part's distance to the nearest of the suppliers' lands."""
    from tidemark.operators.geometry import distance_to_land

    points = read("part").select("p_partkey", (8 + (F.col("p_partkey") * 17 % 1200) / 100 + 0.003).alias("x"), (54 + (F.col("p_retailprice") * 7 % 400) / 100 + 0.001).alias("y"))
    return distance_to_land(points, _land(read), "p_partkey", "y", "x", 30_000.0).withColumn("distance_m", F.round("distance_m", 3))


@query(f"""WITH {_LAND}, p AS (SELECT lat_i * 60 + lon_i AS id, 8.7 + (lon_i + 0.5) * 0.05 AS px, 54.5 + (lat_i + 0.5) * 0.05 AS py FROM range(40) a(lat_i), range(60) b(lon_i)), {_to_land("p", "50000")}
SELECT id // 60 AS lat_i, id % 60 AS lon_i, on_land, round(least(coalesce(distance_m / 1000, 50), 50), 6) AS dist_land_km FROM d""")
def land_grid(read):
    """A grid of 0.05 degrees over part of the suppliers' lands."""
    from tidemark.operators.geometry import land_distance_grid

    return land_distance_grid(_land(read), (54.5, 8.7, 56.5, 11.7), 0.05).withColumn("dist_land_km", r6("dist_land_km"))


@query(f"""WITH {_P}, {_LAND}, z AS (SELECT DISTINCT round(floor(latitude / 0.5 + 1e-9) * 0.5, 6) AS cell_lat, round(floor(longitude / 0.5 + 1e-9) * 0.5, 6) AS cell_lon FROM p),
q AS (SELECT row_number() OVER (ORDER BY cell_lat, cell_lon) AS id, cell_lat, cell_lon, cell_lon + 0.25 AS px, cell_lat + 0.25 AS py FROM z), {_to_land("q", "10000")}
SELECT cell_lat, cell_lon, round(distance_m, 3) AS distance_to_land_m, coalesce(distance_m <= 10000, false) AS is_coastal FROM d JOIN q USING (id)""")
def coastal_cells(read):
    """Which cells of half a degree that positions lie in are coastal."""
    half = lambda c: fn.grid_cell(F.col(c), 0.5)
    cells = _positions(read).select(half("latitude").alias("cell_lat"), half("longitude").alias("cell_lon")).distinct()
    cells = cells.withColumns({"center_latitude": F.col("cell_lat") + 0.25, "center_longitude": F.col("cell_lon") + 0.25})
    out = dt.coastal_flag(cells, _land(read))
    return out.select("cell_lat", "cell_lon", F.round("distance_to_land_m", 3).alias("distance_to_land_m"), "is_coastal")


@query(f"""WITH {_P}, t AS (SELECT s_suppkey, 54 + (s_acctbal * 7 % 400) / 100 AS la, 8 + (s_acctbal * 13 % 1200) / 100 AS lo FROM supplier),
d AS (SELECT event_id, s_suppkey, {_hav("latitude", "longitude", "la", "lo")} AS m FROM p, t)
SELECT event_id, arg_min(s_suppkey, (m, s_suppkey)) AS s_suppkey, round(min(m), 3) AS distance_m FROM d WHERE m <= 20000 GROUP BY event_id""")
def nearest_place(read):
    from tidemark.operators.geometry import nearest_within

    b = F.col("s_acctbal")
    places = read("supplier").select("s_suppkey", (54 + (b * 7 % 400) / 100).alias("latitude"), (8 + (b * 13 % 1200) / 100).alias("longitude"))
    out = nearest_within(_positions(read), places, "event_id", "s_suppkey", "latitude", "longitude", 20_000.0)
    return out.withColumn("distance_m", F.round("distance_m", 3))


@query("""WITH d AS (SELECT doc_id, quality AS y, n_chars AS a, length(source) * 100 + doc_id % 7 AS b FROM documents JOIN labels USING (doc_id)),
r AS (SELECT *, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2 AS rb FROM d)
SELECT doc_id, (ra + rb) / 2 AS ensemble FROM r""")
def rank_mean_ensemble(read):
    from tidemark.operators.models import rank_mean

    d = read("documents").join(read("labels"), "doc_id").select("doc_id", F.col("n_chars").alias("a"), (F.length("source") * 100 + F.col("doc_id") % 7).alias("b"))
    return rank_mean(d, ["a", "b"]).select("doc_id", "ensemble")


@query("""WITH m AS (SELECT o_custkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, count(*) AS n FROM orders GROUP BY ALL)
SELECT m.o_custkey, m.month, m.n, x.n AS next_n FROM m LEFT JOIN m x ON x.o_custkey = m.o_custkey AND x.month = m.month + INTERVAL 1 MONTH""")
def next_month_target(read):
    from tidemark.operators.models import next_period_target

    m = read("orders").groupBy("o_custkey", F.trunc("o_orderdate", "month").alias("month")).agg(F.count("*").alias("n"))
    return next_period_target(m, "o_custkey", "month", "n")


@query()
def logistic_risk(read):
    """Held-out scores of a logistic model; the split is by CRC of the id."""
    from tidemark.operators.models import logistic_scores, split_by_crc

    d = read("documents").join(read("labels"), "doc_id").select("doc_id", "quality", "n_chars", F.length("text").alias("length"), F.size(F.split("text", "\n")).alias("lines"))
    d = split_by_crc(d, F.col("doc_id"), "salt")
    return logistic_scores(d.where("part = 0"), d.where("part = 1"), ["n_chars", "length", "lines"], "quality").select("doc_id", "quality", r6("score").alias("score"))
