"""Queries of resampling, rank tests, land, flags and evidence; registered on import."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import columns as fn
from tidemark.operators import detectors as dt
from tidemark.operators import evaluation as ev
from tidemark.operators import features as ft
from tidemark.operators import forests as fo
from tidemark.operators import geometry as geo
from tidemark.operators import identity as ident
from tidemark.operators import models as md
from tidemark.operators import resampling as rs
from tidemark.operators import timeline as tl
from tidemark.plans.catalogue import _SCORED, _scored, _sessions, query, r6
from tidemark.plans.maritime import _P, _TRIPS, _hav, _positions

REPLICATES = 20


def _weight(*unit: str) -> str:
    name = " || '|' || ".join(["'0'", "CAST(replicate AS VARCHAR)", *(f"CAST({u} AS VARCHAR)" for u in unit)])
    share = f"(CAST(('0x' || substr(md5({name}), 1, 8)) AS UBIGINT) / 4294967296.0)"
    return "(" + " + ".join(f"CAST({share} >= {s!r} AS INT)" for s in rs.POISSON_STEPS) + ")"


def _limits(value: str) -> str:
    return f"count({value}) AS n_replicates, round(quantile_cont({value}, 0.025), 6) AS low, round(quantile_cont({value}, 0.975), 6) AS high"


_REPLICATES = f"k AS (SELECT CAST(unnest(range(1, {REPLICATES + 1})) AS INTEGER) AS replicate)"


def _rounded(out, columns=("low", "high")):
    return out.withColumns({c: r6(c) for c in columns})


@query(f"""WITH {_SCORED}, {_REPLICATES}, c AS (SELECT doc_id % 50 AS cluster, count(*) AS n, sum(y) AS h FROM d WHERE score > 10 GROUP BY ALL),
w AS (SELECT *, {_weight("cluster")} AS w FROM c, k), e AS (SELECT replicate, sum(h * w) / nullif(sum(n * w), 0) AS p FROM w WHERE w > 0 GROUP BY replicate) SELECT {_limits("p")} FROM e""")
def bootstrap_precision(read):
    d = _scored(read).withColumns({"flag": F.col("score") > 10, "cluster": F.col("doc_id") % 50})
    return _rounded(rs.bootstrap_precision(d, "flag", "y", "cluster", REPLICATES))


_AUC = """{n} AS (SELECT replicate, sum(p * (below + n / 2)) / nullif(sum(p) * sum(n), 0) AS auc FROM (
 SELECT *, coalesce(sum(n) OVER (PARTITION BY replicate ORDER BY {s} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM (
 SELECT replicate, {s}, CAST(sum(w * y) AS DOUBLE) AS p, CAST(sum(w * (1 - y)) AS DOUBLE) AS n FROM w WHERE w > 0 GROUP BY replicate, {s})) GROUP BY replicate)"""


@query(f"WITH {_SCORED}, {_REPLICATES}, w AS (SELECT *, {_weight('doc_id', 'y')} AS w FROM d, k), {_AUC.format(n='e', s='score')} SELECT {_limits('auc')} FROM e")
def bootstrap_auc(read):
    return _rounded(rs.bootstrap_auc(_scored(read), "score", "y", ["doc_id"], REPLICATES))


@query(f"""WITH {_SCORED}, {_REPLICATES}, w AS (SELECT *, doc_id * 7 % 101 AS other, {_weight("doc_id", "y")} AS w FROM d, k), {_AUC.format(n="a", s="score")}, {_AUC.format(n="b", s="other")},
e AS (SELECT a.auc - b.auc AS v FROM a JOIN b USING (replicate)) SELECT {_limits("v")} FROM e""")
def bootstrap_auc_difference(read):
    d = _scored(read).withColumn("other", F.col("doc_id") * 7 % 101)
    return _rounded(rs.bootstrap_auc_difference(d, "score", "other", "y", ["doc_id"], REPLICATES))


_HITS = """{n} AS (SELECT {keys}, sum(CASE WHEN room - before <= 0 THEN 0 WHEN room - before >= w THEN h ELSE (room - before) * h / w END) AS hits, least(max(room), sum(w)) AS slots FROM (
 SELECT *, coalesce(sum(w) OVER (PARTITION BY {keys} ORDER BY {s} DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (
 SELECT {keys}, {s}, CAST(sum(w) AS DOUBLE) AS w, CAST(sum(w * y) AS DOUBLE) AS h, max({room}) AS room FROM w WHERE w > 0 GROUP BY {keys}, {s})) GROUP BY {keys})"""
_KEYS = "replicate, cutoff"


@query(f"""WITH {_SCORED}, {_REPLICATES}, s AS (SELECT *, doc_id % 5 AS cutoff, doc_id // 5 AS vessel, doc_id * 7 % 101 AS other FROM d),
w AS (SELECT *, {_weight("vessel")} AS w FROM s, k UNION ALL SELECT *, 0, 1 FROM s), {_HITS.format(n="ha", keys=_KEYS, s="score", room="20")}, {_HITS.format(n="hb", keys=_KEYS, s="other", room="20")},
a AS (SELECT replicate, sum(hits) / nullif(sum(slots), 0) AS p FROM ha GROUP BY replicate), b AS (SELECT replicate, sum(hits) / nullif(sum(slots), 0) AS p FROM hb GROUP BY replicate), e AS (SELECT replicate, a.p - b.p AS v FROM a JOIN b USING (replicate))
SELECT round(max(v) FILTER (replicate = 0), 6) AS point, count(v) FILTER (replicate > 0) AS n_replicates, round(quantile_cont(v, 0.025) FILTER (replicate > 0), 6) AS low, round(quantile_cont(v, 0.975) FILTER (replicate > 0), 6) AS high FROM e""")
def pooled_difference(read):
    d = _scored(read).withColumns({"cutoff": F.col("doc_id") % 5, "vessel": F.floor(F.col("doc_id") / 5), "other": F.col("doc_id") * 7 % 101})
    return _rounded(rs.pooled_difference(d, "cutoff", "vessel", "score", "other", "y", 20, REPLICATES), ("point", "low", "high"))


@query(f"""WITH {_SCORED}, {_REPLICATES}, v AS (SELECT *, {_weight("doc_id")} AS w FROM d, k), f AS (SELECT replicate, sum(w) AS flagged, sum(w * y) AS good FROM v WHERE w > 0 AND doc_id % 7 = 0 GROUP BY replicate),
w AS (SELECT v.*, f.flagged FROM v JOIN f USING (replicate)), {_HITS.format(n="h", keys="replicate", s="score", room="flagged")}, e AS (SELECT h.hits / h.slots - f.good / f.flagged AS v FROM h JOIN f USING (replicate)) SELECT {_limits("v")} FROM e""")
def rule_difference(read):
    return _rounded(rs.rule_difference(_scored(read).withColumn("rule", F.col("doc_id") % 7 == 0), "score", "rule", "y", ["doc_id"], REPLICATES))


_FEATURES = "m AS (SELECT quality AS y, unnest(['length', 'lines', 'dealt']) AS feature, unnest([CAST(n_chars AS DOUBLE), len(text) - len(replace(text, chr(10), '')), doc_id * 7 % 101]) AS value FROM documents JOIN labels USING (doc_id))"


def _features(read):
    d = read("documents").join(read("labels"), "doc_id")
    return d.select("doc_id", F.col("quality").alias("y"), F.col("n_chars").alias("length"), (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))).alias("lines"), (F.col("doc_id") * 7 % 101).alias("dealt"))


@query(f"""WITH {_FEATURES}, r AS (SELECT *, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2 AS ar, count(*) OVER (PARTITION BY feature, value) AS t FROM m),
g AS (SELECT feature, count(*) FILTER (y = 1) AS n_positive, count(*) FILTER (y = 0) AS n_negative, sum(ar) FILTER (y = 1) AS r, CAST(sum(CAST(t AS DOUBLE) * t - 1) AS DOUBLE) AS ties, CAST(count(*) AS DOUBLE) AS n FROM r GROUP BY feature),
u AS (SELECT *, r - n_positive * (n_positive + 1) / 2 AS u, CAST(n_positive AS DOUBLE) * n_negative AS pq FROM g)
SELECT feature, n_positive, n_negative, round(u, 6) AS u, round(u / pq, 6) AS auc, round(sign(u - pq / 2) * greatest(abs(u - pq / 2) - 0.5, 0) / sqrt(pq / 12 * (n + 1 - ties / (n * (n - 1)))), 6) AS z FROM u""")
def rank_tests(read):
    out = rs.rank_tests(_features(read), ["length", "lines", "dealt"], "y")
    return out.select("feature", "n_positive", "n_negative", *(r6(c).alias(c) for c in ("u", "auc", "z")))


@query(f"""WITH mk AS (SELECT doc_id, quality AS y, unnest(['length', 'lines', 'dealt']) AS feature, unnest([CAST(n_chars AS DOUBLE), len(text) - len(replace(text, chr(10), '')), doc_id * 7 % 101]) AS score FROM documents JOIN labels USING (doc_id)), {_REPLICATES},
w AS (SELECT *, {_weight("doc_id", "y")} AS w FROM mk, k), l AS (SELECT replicate, feature, score, CAST(sum(w * y) AS DOUBLE) AS p, CAST(sum(w * (1 - y)) AS DOUBLE) AS n FROM w WHERE w > 0 GROUP BY ALL),
a AS (SELECT replicate, feature, sum(p * (below + n / 2)) / nullif(sum(p) * sum(n), 0) AS auc FROM (SELECT *, coalesce(sum(n) OVER (PARTITION BY replicate, feature ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM l) GROUP BY replicate, feature),
i AS (SELECT feature, quantile_cont(auc, 0.025) AS low, quantile_cont(auc, 0.975) AS high FROM a GROUP BY feature),
r AS (SELECT *, rank() OVER (PARTITION BY feature ORDER BY score) + (count(*) OVER (PARTITION BY feature, score) - 1) / 2 AS ar FROM mk),
g AS (SELECT feature, count(*) FILTER (y = 1) AS n_positive, count(*) FILTER (y = 0) AS n_negative, sum(ar) FILTER (y = 1) AS r FROM r GROUP BY feature)
SELECT feature, n_positive, n_negative, round((r - n_positive * (n_positive + 1) / 2) / (CAST(n_positive AS DOUBLE) * n_negative), 6) AS auc, round(low, 6) AS low, round(high, 6) AS high,
  CASE WHEN least(n_positive, n_negative) < 20 THEN 'insufficient_data' WHEN low > 0.5 THEN 'discriminates_as_expected' WHEN high < 0.5 THEN 'discriminates_opposite' ELSE 'no_discrimination' END AS verdict FROM g JOIN i USING (feature)""")
def feature_verdicts(read):
    out = rs.feature_verdicts(_features(read), ["length", "lines", "dealt"], "y", ["doc_id"], replicates=REPLICATES)
    return out.select("feature", "n_positive", "n_negative", *(r6(c).alias(c) for c in ("auc", "low", "high")), "verdict")


@query("""WITH d AS (SELECT quality AS y, CASE WHEN doc_id % 3 > 0 THEN 1 END AS often, CASE WHEN doc_id % 11 = 0 THEN 1 END AS seldom, CASE WHEN quality = 1 OR doc_id % 2 = 0 THEN 1 END AS leaning FROM documents JOIN labels USING (doc_id)),
m AS (SELECT y, unnest(['often', 'seldom', 'leaning']) AS value, unnest([often, seldom, leaning]) AS v FROM d), s AS (SELECT value, count(v) FILTER (y = 1) / count(*) FILTER (y = 1) AS p, count(v) FILTER (y = 0) / count(*) FILTER (y = 0) AS n FROM m GROUP BY value)
SELECT value, round(p, 6) AS positive_share, round(n, 6) AS negative_share, least(p, n) >= 0.5 AND abs(p - n) <= 0.1 AS passes FROM s""")
def coverage_gates(read):
    i = F.col("doc_id")
    d = read("documents").join(read("labels"), "doc_id").select(F.col("quality").alias("y"), F.when(i % 3 > 0, 1).alias("often"), F.when(i % 11 == 0, 1).alias("seldom"), F.when((F.col("quality") == 1) | (i % 2 == 0), 1).alias("leaning"))
    return _rounded(rs.coverage_gates(d, ["often", "seldom", "leaning"], "y"), ("positive_share", "negative_share"))


@query("""WITH s AS (SELECT s_suppkey, s_nationkey * 4.0 AS cx, s_acctbal / 100 AS cy FROM supplier), p AS (SELECT p_partkey, (p_partkey % 100) * 1.0 + 0.25 AS x, p_retailprice % 100 + 0.003 AS y FROM part),
q AS (SELECT quantile_cont(y, 0.001) - 0.5 AS s, quantile_cont(y, 0.999) + 0.5 AS n, quantile_cont(x, 0.001) - 0.5 AS w, quantile_cont(x, 0.999) + 0.5 AS e FROM p)
SELECT DISTINCT p_partkey FROM p, q, s WHERE y BETWEEN q.s AND q.n AND x BETWEEN q.w AND q.e AND (1 - abs(x - cx) / 9.0 - abs(y - cy) / 11.0) / sqrt(1 / 81.0 + 1 / 121.0) > 2.5""")
def on_land(read):
    """Points well inside a diamond around any supplier."""
    cx, cy = F.col("s_nationkey") * 4.0, F.col("s_acctbal") / 100
    at = lambda dx, dy: F.struct((cx + dx).alias("x"), (cy + dy).alias("y"))
    land = read("supplier").select(F.col("s_suppkey").alias("polygon"), F.array(F.array(at(9.0, 0.0), at(0.0, 11.0), at(-9.0, 0.0), at(0.0, -11.0), at(9.0, 0.0))).alias("rings"))
    points = read("part").select("p_partkey", ((F.col("p_partkey") % 100) * 1.0 + 0.25).alias("x"), (F.col("p_retailprice") % 100 + 0.003).alias("y"))
    return geo.on_land(points, land, "p_partkey", "y", "x", erosion=2.5, band=4.0)


@query(f"""WITH {_P}, f AS (SELECT imo, mmsi + (mmsi % 3) * 1000000 AS mmsi, min(timestamp) AS since FROM p GROUP BY ALL), g AS (SELECT *, count(*) OVER (PARTITION BY imo ORDER BY since RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM f)
SELECT a.mmsi, b.mmsi AS related_mmsi, 'shared_imo' AS kind, a.imo AS shared_value, greatest(a.since, b.since) AS knowable_at, a.mmsi // 1000000 <> b.mmsi // 1000000 AS cross_mid, CAST(CASE WHEN a.mmsi // 1000000 <> b.mmsi // 1000000 THEN 0.9 ELSE 0.8 END AS DOUBLE) AS confidence
FROM g a JOIN g b ON a.imo = b.imo AND a.mmsi <> b.mmsi WHERE a.n <= 20 AND b.n <= 20""")
def shared_imo_events(read):
    p = _positions(read).withColumn("mmsi", F.col("mmsi") + (F.col("mmsi") % 3) * 1_000_000)
    return ident.shared_value_events(p, ["imo"], "shared_imo", 0.8).withColumn("confidence", r6("confidence"))


@query(f"""WITH {_P}, i AS (SELECT mmsi, date, name, min(timestamp) AS mn, max(timestamp) AS mx FROM p GROUP BY ALL), o AS (SELECT *, max(mx) OVER (PARTITION BY mmsi, date ORDER BY mn, mx, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= mn AS ov FROM i)
SELECT mmsi, date, count(*) AS n_values, count(*) FILTER (ov) AS n_overlapping, min(mn) FILTER (ov) AS event_time FROM o GROUP BY mmsi, date HAVING count(*) FILTER (ov) > 0""")
def flapping_values(read):
    return ident.flapping_values(ident.value_intervals(_positions(read), ["mmsi", "date"], "name", "timestamp"), ["mmsi", "date"], "name")


@query("""WITH c AS (SELECT n_nationkey + 200 AS mid, n_name AS country FROM nation), f(name) AS (VALUES """ + ", ".join(f"('{x}')" for x in fn.FLAGS_OF_CONVENIENCE) + """)
SELECT c_custkey, country AS flag_country, CASE WHEN country IS NULL THEN 'unknown_flag' WHEN country IN (SELECT name FROM f) THEN 'foc' ELSE 'not_foc' END AS status FROM customer LEFT JOIN c ON mid = 200 + c_custkey % 40""")
def flags(read):
    c = read("customer").select("c_custkey", ((F.col("c_custkey") % 40 + 200) * 1_000_000 + F.col("c_custkey")).alias("mmsi"))
    out = ident.with_flag(c, read("nation").select((F.col("n_nationkey") + 200).alias("mid"), F.col("n_name").alias("country")))
    return out.select("c_custkey", "flag_country", fn.foc_status(F.col("flag_country")).alias("status"))


@query(f"""WITH {_P}, a AS (SELECT s_suppkey, 54 + (s_acctbal * 7 % 400) / 100 AS la, 8 + (s_acctbal * 13 % 1200) / 100 AS lo, [219000000 + s_suppkey % 50, 219000000 + s_suppkey % 7, 219000000 + s_suppkey % 11 + 100] AS members FROM supplier)
SELECT event_id FROM p WHERE EXISTS (SELECT 1 FROM a WHERE {_hav("latitude", "longitude", "la", "lo")} <= 8000 AND len(members) - CAST(list_contains(members, mmsi) AS INT) >= 3)""")
def near_anchorage(read):
    s, b = F.col("s_suppkey"), F.col("s_acctbal")
    members = F.array(*(x + 219_000_000 for x in (s % 50, s % 7, s % 11 + 100)))
    places = read("supplier").select((54 + (b * 7 % 400) / 100).alias("center_latitude"), (8 + (b * 13 % 1200) / 100).alias("center_longitude"), members.alias("members"))
    return dt.near_anchorage(_positions(read), places, "event_id", "mmsi", "latitude", "longitude", 8_000.0, 3).select("event_id")


@query("""WITH g AS (SELECT o_orderkey, o_custkey AS k, o_orderdate AS s, o_orderdate + INTERVAL 3 DAY AS e FROM orders), x AS (SELECT l_orderkey, l_suppkey AS a, l_partkey % 500 AS b, l_shipdate AS s, l_shipdate + INTERVAL 6 HOUR AS e FROM lineitem)
SELECT o_orderkey FROM g WHERE EXISTS (SELECT 1 FROM x WHERE x.a = g.k AND x.s <= g.e AND x.e >= g.s) OR EXISTS (SELECT 1 FROM x WHERE x.b = g.k AND x.s <= g.e AND x.e >= g.s)""")
def during_encounter(read):
    gaps = read("orders").select("o_orderkey", F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("s"), (F.col("o_orderdate") + F.expr("INTERVAL 3 DAYS")).alias("e"))
    met = read("lineitem").select(F.col("l_suppkey").alias("key_a"), (F.col("l_partkey") % 500).alias("key_b"), F.col("l_shipdate").alias("start_time"), (F.col("l_shipdate") + F.expr("INTERVAL 6 HOURS")).alias("end_time"))
    return dt.during_encounter(gaps, met, "o_orderkey", "k", "s", "e").select("o_orderkey")


@query("""WITH i AS (SELECT c_custkey AS mmsi, lpad(CAST(x AS VARCHAR), 9, '0') AS imo, d AS last_seen FROM customer, (VALUES (0, DATE '1996-03-01'), (1, DATE '1996-02-01')) v(k, d), LATERAL (SELECT CASE k WHEN 0 THEN c_custkey ELSE c_custkey + 1 END AS x)),
r AS (SELECT mmsi, arg_max(imo, (last_seen, imo)) AS imo FROM i GROUP BY mmsi), t AS (SELECT lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS imo, count(*) AS n, count(*) FILTER (o_totalprice > 200000) AS l FROM orders WHERE o_orderdate >= TIMESTAMP '1995-07-06' AND o_orderdate < TIMESTAMP '1996-04-01' GROUP BY ALL)
SELECT mmsi, coalesce(n, 0) AS n_trips, coalesce(l, 0) AS n_laden_returns, round(l / n, 6) AS laden_share, round(coalesce(l, 0) / 269.0 * 30, 6) AS laden_per_30d FROM r LEFT JOIN t USING (imo)""")
def trip_features(read):
    name = lambda c: F.lpad(c.cast("string"), 9, "0")
    c = read("customer").select(F.col("c_custkey").alias("mmsi"))
    day = lambda d: F.lit(d).cast("date").alias("last_seen")
    identity = c.select("mmsi", name(F.col("mmsi")).alias("imo"), day("1996-03-01")).unionByName(c.select("mmsi", name(F.col("mmsi") + 1).alias("imo"), day("1996-02-01")))
    trips = read("orders").select(name(F.col("o_custkey")).alias("imo"), F.col("o_orderdate").alias("west_time"), (F.col("o_totalprice") > 200000).alias("is_laden_return"))
    out = ft.trip_features(identity, trips, "1996-03-01", "1996-03-31", 270, "1995-07-06")
    return _rounded(out, ("laden_share", "laden_per_30d")).drop("window_start", "window_end")


@query("""WITH r AS (SELECT user_id, CAST(ts AS DATE) AS trip, count(*) AS n_points FROM events GROUP BY ALL HAVING count(*) >= 2)
SELECT user_id, trip, n_points, CAST(coalesce(sum(n_points) OVER (ORDER BY user_id, trip ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_point FROM r""")
def trip_runs(read):
    return tl.trip_runs(read("events").withColumn("trip", F.col("ts").cast("date")), "user_id", "trip")


@query(f"""WITH {_P} SELECT count(*) AS n_rows, count(DISTINCT mmsi) AS n_keys, min(timestamp) AS first_time, max(timestamp) AS last_time, round(quantile_cont(latitude, 0.001), 2) AS south, round(quantile_cont(longitude, 0.001), 2) AS west,
 round(quantile_cont(latitude, 0.999), 2) AS north, round(quantile_cont(longitude, 0.999), 2) AS east FROM p""")
def fingerprint(read):
    return geo.fingerprint(_positions(read), "mmsi", "timestamp", "latitude", "longitude")


@query()
def cross_validated_auc(read):
    """AUC of out-of-fold scores; three documents make a group."""
    d = read("documents").join(read("labels"), "doc_id").select(F.floor(F.col("doc_id") / 3).alias("vessel"), F.col("quality").alias("y"), "n_chars", F.size(F.split("text", "\n")).alias("lines"))
    scored = md.cross_validated_scores(d, ["n_chars", "lines"], "y", "vessel")
    return ev.auc(scored.select("y", F.round("score", 9).alias("score")), "score", "y").withColumn("auc", r6("auc"))


_FISHER = """f AS (SELECT rule, CASE WHEN known > 0 THEN (SELECT least(1.0, sum(exp(q)) FILTER (q <= own + 1e-7)) FROM (SELECT q, max(q) FILTER (k = c.tp) OVER () AS own FROM (
  SELECT k, lgamma(flagged + 1) - lgamma(k + 1) - lgamma(flagged - k + 1) + lgamma(n - flagged + 1) - lgamma(p - k + 1) - lgamma(n - flagged - p + k + 1) - lgamma(n + 1) + lgamma(p + 1) + lgamma(n - p + 1) AS q
  FROM (SELECT unnest(range(greatest(0, flagged + p - n), least(flagged, p) + 1)) AS k)))) END AS fisher_p FROM c)"""


@query(f"""WITH {_SCORED}, m AS (SELECT doc_id, y, unnest(['long', 'dealt', 'unknown']) AS rule, unnest([score > 10, doc_id % 3 = 0, NULL]) AS r FROM d),
c AS (SELECT rule, count(*) AS n, CAST(sum(y) AS BIGINT) AS p, count(r) AS known, count(*) FILTER (r AND y = 1) AS tp, count(*) FILTER (r) AS flagged FROM m GROUP BY rule),
t AS (SELECT rule, avg(y) AS hit, bool_and(coalesce(r, false)) AS all_fired FROM (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY coalesce(r, false) DESC, doc_id) AS rn FROM m) WHERE rn <= 20 GROUP BY rule), {_FISHER}
SELECT rule, CASE WHEN known > 0 THEN flagged END AS n_flagged, CASE WHEN known > 0 THEN tp END AS tp, CASE WHEN known > 0 THEN flagged - tp END AS fp, CASE WHEN known > 0 THEN round(tp / flagged, 6) END AS precision, CASE WHEN known > 0 THEN round(tp / p, 6) END AS recall,
  CASE WHEN known > 0 THEN round((tp / flagged) / (p / n), 6) END AS lift, CASE WHEN known > 0 THEN round((tp / p + (n - flagged - p + tp) / (n - p)) / 2, 6) END AS auc, round(fisher_p, 6) AS fisher_p, CASE WHEN known > 0 THEN round(hit, 6) END AS precision_at_k,
  CASE WHEN known > 0 THEN CASE WHEN all_fired THEN flagged ELSE n - flagged END END AS n_ties_at_cut, CASE WHEN known > 0 THEN 'evaluated' ELSE 'blocked_by_gate' END AS verdict FROM c JOIN t USING (rule) JOIN f USING (rule)""")
def rule_reports(read):
    d = _scored(read).withColumns({"long": F.col("score") > 10, "dealt": F.col("doc_id") % 3 == 0, "unknown": F.lit(None).cast("boolean")})
    out = ev.rule_reports(d, ["long", "dealt", "unknown"], "y", "doc_id")
    return out.withColumns({c: r6(c) for c in ("precision", "recall", "lift", "auc", "fisher_p", "precision_at_k")})


@query("""WITH c AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'Tanker' WHEN 1 THEN 'Cargo' END AS ship_type, CASE c_nationkey % 4 WHEN 0 THEN 'Panama' WHEN 1 THEN 'Denmark' WHEN 2 THEN 'Liberia' END AS flag, CASE WHEN c_custkey % 5 > 0 THEN 1980 + c_custkey % 40 END AS built FROM customer),
r AS (SELECT *, coalesce(ship_type = 'Tanker', false) AS r1, coalesce(ship_type = 'Tanker' AND flag IN ('Panama', 'Liberia'), false) AS r2 FROM c) SELECT c_custkey, r1, r2, r2 AND coalesce(2024 - built > 15, false) AS r3 FROM r""")
def tanker_rules(read):
    k = F.col("c_custkey")
    c = read("customer").select("c_custkey", F.when(k % 3 == 0, "Tanker").when(k % 3 == 1, "Cargo").alias("ship_type"), F.when(F.col("c_nationkey") % 4 == 0, "Panama").when(F.col("c_nationkey") % 4 == 1, "Denmark").when(F.col("c_nationkey") % 4 == 2, "Liberia").alias("flag"), F.when(k % 5 > 0, 1980 + k % 40).alias("built"), F.lit("2024-06-30").cast("date").alias("window_end"))
    return ev.tanker_rules(c, "ship_type", "flag", "window_end", "built").select("c_custkey", "r1", "r2", "r3")


@query("""WITH o AS (SELECT o_custkey, CAST(min(o_orderdate) AS DATE) AS window_end, CAST(min(o_orderdate) FILTER (o_totalprice > 150000) AS DATE) AS event FROM orders GROUP BY o_custkey),
h AS (SELECT *, coalesce(event > window_end AND event <= window_end + 90 AND event < DATE '1998-01-01', false) AS hazard, coalesce(event > window_end AND event < DATE '1998-01-01', false) AS known FROM o WHERE window_end < DATE '1998-01-01')
SELECT o_custkey, hazard, known FROM h WHERE hazard OR window_end + 90 < DATE '1998-01-01'""")
def hazard_labels(read):
    o = read("orders").groupBy("o_custkey").agg(F.min("o_orderdate").cast("date").alias("window_end"), F.min(F.when(F.col("o_totalprice") > 150000, F.col("o_orderdate"))).cast("date").alias("event"))
    out = md.hazard_labels(o, "window_end", "event", "1998-01-01", 90, "hazard")
    return md.as_of_labels(out, "window_end", "event", "1998-01-01", "known").select("o_custkey", "hazard", "known")


@query("""WITH c AS (SELECT *, TIMESTAMP '2024-01-20' AS cutoff, lag(event_type) OVER w AS before, row_number() OVER w AS n FROM events WHERE ts < TIMESTAMP '2024-01-20' WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, cutoff, bool_or(ts >= TIMESTAMP '2024-01-10' AND coalesce(event_type IN ('purchase', 'signup'), false) AND NOT coalesce(before IN ('purchase', 'signup'), false) AND n > 1) AS switched FROM c GROUP BY user_id, cutoff""")
def foc_switch(read):
    """A switch into a group of values, as into a flag of convenience."""
    e = read("events").select("user_id", "ts", "event_type", "event_id")
    cut = e.select("user_id").distinct().withColumn("cutoff", F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"))
    return ft.switched_into(e, cut, "user_id", "ts", "event_type", ["purchase", "signup"], "event_id", 10)


@query(f"""WITH {_TRIPS}, {_P}, tp AS (SELECT 219000000 + user_id AS mmsi, (219000000 + user_id) || '-' || session_seq AS voyage_id, start_time, end_time, 54 + (start_value * 37 % 400) / 100 AS sla, 8 + (start_value * 53 % 1200) / 100 AS slo, 54 + (end_value * 37 % 400) / 100 AS ela, 8 + (end_value * 53 % 1200) / 100 AS elo FROM v),
m AS (SELECT tr.voyage_id, median(draught) AS d FROM tr JOIN p ON p.mmsi = tr.mmsi AND p.timestamp BETWEEN tr.start_time AND tr.end_time WHERE draught > 0 GROUP BY tr.voyage_id HAVING count(*) >= 2),
n AS (SELECT *, lead(voyage_id) OVER w AS next_voyage_id, lead(start_time) OVER w AS ns, lead(sla) OVER w AS nla, lead(slo) OVER w AS nlo FROM tp WINDOW w AS (PARTITION BY mmsi ORDER BY start_time, voyage_id)),
c AS (SELECT n.*, a.d AS old_draught, b.d AS new_draught FROM n JOIN m a ON a.voyage_id = n.voyage_id JOIN m b ON b.voyage_id = n.next_voyage_id WHERE abs(b.d - a.d) >= 1),
k AS (SELECT 54 + (s_acctbal * 7 % 400) / 100 AS la, 8 + (s_acctbal * 13 % 1200) / 100 AS lo, [219000000 + s_suppkey % 50, 219000000 + s_suppkey % 7, 219000000 + s_suppkey % 11 + 100] AS members FROM supplier),
x AS (SELECT 219000000 + p_partkey % 90 AS a, 219000100 + p_partkey % 70 AS b, TIMESTAMP '2024-01-01' + to_hours(CAST(p_partkey * 7 % 720 AS BIGINT)) AS s, TIMESTAMP '2024-01-01' + to_hours(CAST(p_partkey * 7 % 720 + 4 AS BIGINT)) AS e FROM part)
SELECT mmsi, voyage_id, next_voyage_id, end_time AS event_time, round(ela, 6) AS latitude, round(elo, 6) AS longitude, round(old_draught, 6) AS old_draught, round(new_draught, 6) AS new_draught, round(new_draught - old_draught, 6) AS change_m, round(least(abs(new_draught - old_draught) / 5, 1), 6) AS confidence FROM c
WHERE NOT EXISTS (SELECT 1 FROM k WHERE len(members) - CAST(list_contains(members, mmsi) AS INT) >= 3 AND ({_hav("ela", "elo", "la", "lo")} <= 8000 OR {_hav("nla", "nlo", "la", "lo")} <= 8000))
AND NOT EXISTS (SELECT 1 FROM x WHERE x.a = c.mmsi AND x.s <= c.ns AND x.e >= c.end_time) AND NOT EXISTS (SELECT 1 FROM x WHERE x.b = c.mmsi AND x.s <= c.ns AND x.e >= c.end_time)""")
def unexplained_draughts(read):
    key, place = F.col("user_id") + 219000000, lambda v: ((54 + (F.col(v) * 37 % 400) / 100), (8 + (F.col(v) * 53 % 1200) / 100))
    trips = _sessions(read).select(key.alias("mmsi"), F.concat(key.cast("string"), F.lit("-"), F.col("session_seq").cast("string")).alias("voyage_id"), "start_time", "end_time", *(c.alias(f"{end}_{n}") for end in ("start", "end") for c, n in zip(place(f"{end}_value"), ("latitude", "longitude"))))
    s, b, k = F.col("s_suppkey"), F.col("s_acctbal"), F.col("p_partkey")
    places = read("supplier").select((54 + (b * 7 % 400) / 100).alias("center_latitude"), (8 + (b * 13 % 1200) / 100).alias("center_longitude"), F.array(*(x + 219_000_000 for x in (s % 50, s % 7, s % 11 + 100))).alias("members"))
    at = lambda hours: F.timestamp_micros(F.lit(1_704_067_200_000_000) + hours * 3_600_000_000).cast("timestamp_ntz")
    met = read("part").select((219_000_000 + k % 90).alias("key_a"), (219_000_100 + k % 70).alias("key_b"), at(k * 7 % 720).alias("start_time"), at(k * 7 % 720 + 4).alias("end_time"))
    out = dt.unexplained_draught_changes(trips, _positions(read), places, met, "mmsi", "timestamp", "draught", 2, 1.0, 5.0, 8_000.0, 3)
    return out.withColumns({c: r6(c) for c in ("latitude", "longitude", "old_draught", "new_draught", "change_m", "confidence")})


def _weeks(read):
    """A row for each user and week of January, with counts, and whether the user buys in the week after."""
    week = F.floor(F.dayofmonth("ts") / 7).cast("int")
    kinds = ("view", "click", "purchase")
    w = read("events").groupBy("user_id", week.alias("week")).agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.max("value").alias("largest"), *(F.count_if(F.col("event_type") == k).alias(k) for k in kinds))
    later = w.select("user_id", (F.col("week") - 1).alias("week"), (F.col("purchase") > 0).cast("int").alias("y"))
    return w.join(later, ["user_id", "week"], "left").withColumn("y", F.coalesce("y", F.lit(0))).where("week < 4"), ["n", "total", "largest", *kinds]


@query()
def boosted_risk(read):
    """AUC forward in time: trees learn from the weeks before the last, with and without bags of unlabelled rows."""
    d, features = _weeks(read)
    out = None
    for name, more in (("boosting", {}), ("bagging", {"bags": 5, "ratio": 2.0})):
        model, _ = fo.fit_boosting(d.where("week < 3"), features, "y", ["user_id", "week"], trees=12, depth=2, rate=0.2, subsample=0.8, columns=0.8, **more)
        part = ev.auc(fo.boosted_scores(model, d.where("week = 3")).withColumn("score", F.round("score", 9)), "score", "y").select(F.lit(name).alias("model"), "n_positive", "n_negative", r6("auc").alias("auc"))
        out = part if out is None else out.unionByName(part)
    return out


@query()
def isolation_ranks(read):
    """How far apart from the weeks before each of the last week's rows is."""
    d, features = _weeks(read)
    return fo.isolation_scores(d.where("week < 3"), d.where("week = 3"), features, ["user_id", "week"]).select("user_id", r6("anomaly").alias("anomaly"))


@query("""WITH r AS (SELECT lpad(CAST(o_custkey * 97 % 3000 AS VARCHAR), 6, '0') AS serial, CASE WHEN o_orderkey % 3 > 0 THEN year(o_orderdate) END AS a, CASE WHEN o_orderkey % 4 > 0 THEN year(o_orderdate) - CAST(o_orderkey % 5 AS INT) END AS b FROM orders WHERE o_orderkey % 2 = 0 OR o_custkey % 3 = 0),
v AS (SELECT serial || CAST(list_sum(list_transform(range(1, 7), lambda i: (8 - i) * CAST(serial[i] AS INT))) % 10 AS VARCHAR) AS imo, coalesce(a, b) AS y, coalesce(abs(a - b) > 1, false) AS c, a, b FROM r WHERE serial <> '000000'),
g AS (SELECT imo, count(*) AS n_items, CASE WHEN count(a) > 0 THEN 'P729' WHEN count(b) > 0 THEN 'P571' END AS date_source, bool_or(c) AS has_date_conflict, min(y) AS low, max(y) AS high FROM v GROUP BY imo)
SELECT imo, n_items, date_source, has_date_conflict, CAST(CASE WHEN high - low <= 1 THEN low END AS INT) AS build_year, coalesce(high - low > 1, false) AS is_ambiguous FROM g""")
def build_years(read):
    """Registry entries of one ship reconciled; those whose check digit fails are left out."""
    from tidemark.sources.lists import reconcile_build_years

    o = read("orders").where((F.col("o_orderkey") % 2 == 0) | (F.col("o_custkey") % 3 == 0)).withColumn("serial", F.lpad((F.col("o_custkey") * 97 % 3000).cast("string"), 6, "0"))
    check = sum(((8 - i) * F.substring("serial", i, 1).cast("int") for i in range(1, 7)), F.lit(0)) % 10
    year, k = F.year("o_orderdate"), F.col("o_orderkey")
    dated = lambda c: F.make_date(c, F.lit(5), F.lit(1))
    right = o.select(F.concat("serial", check.cast("string")).alias("imo"), F.when(k % 3 > 0, dated(year)).alias("service_entry"), F.when(k % 4 > 0, dated(year - (k % 5).cast("int"))).alias("inception"))
    wrong = o.select(F.concat("serial", ((check + 1) % 10).cast("string")).alias("imo"), dated(year).alias("service_entry"), dated(year).alias("inception"))
    return reconcile_build_years(right.unionByName(wrong))


_KINDS = {"spoofing": ft.SPOOFING_KINDS, "identity": ft.IDENTITY_KINDS, "behaviour": ft.BEHAVIOUR_KINDS}
_TYPES = {"spoofing": "error", "identity": "click", "behaviour": "view"}


def _kind_sql(table: str) -> str:
    kinds = _KINDS[table]
    return f"[{', '.join(repr(k) for k in kinds)}][event_id % {len(kinds)} + 1]"


_PANEL = f"""WITH {_TRIPS}, {_P}, w AS (SELECT mmsi, imo, ship_type, count(*) AS message_count, mmsi % 7 = 0 AS is_orphaned, mmsi % 5 = 0 AS is_reused, CASE mmsi % 3 WHEN 0 THEN 'Panama' WHEN 1 THEN 'Denmark' END AS flag_country FROM p GROUP BY ALL),
mo AS (SELECT mmsi, CAST(ym AS DATE) AS year_month, least(last_day(ym), DATE '2024-02-20') AS month_end FROM w, (SELECT unnest(generate_series(DATE '2023-12-01', DATE '2024-02-01', INTERVAL 1 MONTH)) AS ym)),
gp AS (SELECT mmsi, lead(start_time) OVER (PARTITION BY mmsi ORDER BY start_time) AS knew, (epoch_us(lead(start_time) OVER (PARTITION BY mmsi ORDER BY start_time)) - epoch_us(end_time)) / 3.6e9 AS hours, (mmsi % 10) / 10.0 AS probability FROM tr QUALIFY knew IS NOT NULL),
ev AS (SELECT mmsi, knew, 'gap' AS t, NULL AS kind, probability AS v, hours AS h FROM gp
  UNION ALL SELECT mmsi, timestamp, 'spoofing', {_kind_sql("spoofing")}, NULL, NULL FROM p WHERE name = 'error' UNION ALL SELECT mmsi, timestamp, 'identity', {_kind_sql("identity")}, NULL, NULL FROM p WHERE name = 'click'
  UNION ALL SELECT mmsi, timestamp, 'behaviour', {_kind_sql("behaviour")}, NULL, NULL FROM p WHERE name = 'view'
  UNION ALL SELECT unnest(list_distinct([mmsi, 219000000 + mmsi * 3 % 97])), timestamp, 'sts', NULL, (event_id % 10) / 10.0, NULL FROM p WHERE name = 'purchase'),
c AS (SELECT m.mmsi, m.year_month, m.month_end, count(*) FILTER (t = 'gap') AS n_gaps, count(*) FILTER (t = 'gap' AND v >= 0.6) AS n_gaps_high_probability, round(avg(v) FILTER (t = 'gap'), 6) AS mean_gap_probability, round(max(h), 6) AS max_gap_duration_hours,
  {", ".join(f"count(*) FILTER (t = '{t}' AND kind = '{k}') AS n_{k}" for t, ks in _KINDS.items() for k in ks)}, count(*) FILTER (t = 'spoofing') AS n_spoofing_events_total, count(*) FILTER (t = 'identity') AS n_identity_anomalies_total,
  count(*) FILTER (t = 'sts') AS n_sts_episodes, round(avg(v) FILTER (t = 'sts'), 6) AS mean_sts_confidence, round(max(v) FILTER (t = 'sts'), 6) AS max_sts_confidence FROM mo m LEFT JOIN ev ON ev.mmsi = m.mmsi AND ev.knew < CAST(month_end AS TIMESTAMP) + INTERVAL 1 DAY GROUP BY ALL),
x AS (SELECT mmsi, CAST(date_trunc('month', timestamp) AS DATE) AS year_month, count(DISTINCT date_trunc('hour', timestamp)) AS n_observed_hours, count(DISTINCT date) AS n_observed_days FROM p GROUP BY ALL),
vc AS (SELECT mmsi, count(*) AS voyage_count FROM tr GROUP BY mmsi),
l AS (SELECT imo, min(DATE '2024-01-05' + CAST(mmsi % 60 AS INT)) AS d, count(DISTINCT mmsi % 2) AS k FROM w WHERE mmsi % 6 = 0 GROUP BY imo),
f AS (SELECT c.*, w.imo, is_orphaned, is_reused, message_count AS total_message_count, flag_country, ship_type, coalesce(voyage_count, 0) AS voyage_count, coalesce(n_observed_hours, 0) AS n_observed_hours, coalesce(n_observed_days, 0) AS n_observed_days,
  d IS NOT NULL AS label_is_sanctioned_ever, d AS label_earliest_designation_date, coalesce(d <= DATE '2024-02-01', false) AS label_is_sanctioned_as_of_window_end, coalesce(d > DATE '2024-02-01', false) AS label_is_sanctioned_after_window_end, coalesce(k, 0) AS label_n_sanctions_sources
  FROM c JOIN w USING (mmsi) LEFT JOIN vc USING (mmsi) LEFT JOIN x USING (mmsi, year_month) LEFT JOIN l ON l.imo = w.imo)
SELECT *, {", ".join(f"round({c} / nullif({d}, 0), 6) AS rate_{c.removeprefix('n_')}_per_{n}" for c in ft.RATED for n, d in (("voyage", "voyage_count"), ("observed_day", "n_observed_days"), ("1000_messages", "total_message_count / 1000.0")))} FROM f"""


@query(_PANEL)
def vessel_panel(read):
    """The whole panel: identity, counts, means, maxima, rates and labels of every vessel and month."""
    p = _positions(read)
    who = p.groupBy("mmsi", "imo", "ship_type").agg(F.count("*").alias("message_count"))
    k = F.col("mmsi")
    roster = who.withColumns({"is_orphaned": k % 7 == 0, "is_reused": k % 5 == 0, "flag_country": F.when(k % 3 == 0, "Panama").when(k % 3 == 1, "Denmark")})
    trips = _sessions(read).select((F.col("user_id") + 219000000).alias("mmsi"), "start_time", "end_time")
    gaps = tl.session_gaps(_sessions(read), "user_id").select((F.col("user_id") + 219000000).alias("mmsi"), "gap_end", ((F.unix_micros(F.col("gap_end").cast("timestamp")) - F.unix_micros(F.col("gap_start").cast("timestamp"))) / 3.6e9).alias("duration_hours")).withColumn("probability", k % 10 / 10)
    pick = lambda t: F.get(F.array(*(F.lit(x) for x in _KINDS[t])), (F.col("event_id") % len(_KINDS[t])).cast("int")).alias("kind")
    of = lambda t, ts: p.where(F.col("name") == _TYPES[t]).select("mmsi", pick(t), F.col("timestamp").alias(ts))
    met = p.where("name = 'purchase'").select(k.alias("mmsi_a"), (219000000 + k * 3 % 97).alias("mmsi_b"), F.col("timestamp").alias("end_time"), (F.col("event_id") % 10 / 10).alias("confidence"))
    matches = roster.where(k % 6 == 0).select("imo", (k % 2).cast("string").alias("source"), F.lit("1").alias("source_id"), F.date_add(F.lit("2024-01-05").cast("date"), (k % 60).cast("int")).alias("designation_date"))
    spine = ft.month_spine(roster.select("mmsi"), "2023-12-01", "2024-02-20")
    out = ft.vessel_panel(spine, roster, roster, roster, trips, dt.presence(p, [], "timestamp", "mmsi"), gaps, of("spoofing", "event_time"), met, of("identity", "knowable_at"), of("behaviour", "knowable_at"), matches, "2024-02-01")
    return _rounded(out, [c for c in out.columns if c.startswith(("rate_", "mean_", "max_"))])


@query(f"""WITH {_P}, h AS (SELECT mmsi, date_trunc('hour', timestamp) AS hour, CAST(timestamp AS DATE) AS day FROM p GROUP BY ALL), i AS (SELECT mmsi, imo, CASE mmsi % 3 WHEN 0 THEN 'PA' WHEN 1 THEN 'DK' END AS flag, 'SHIP ' || (mmsi % 40) AS name FROM p GROUP BY ALL),
s AS (SELECT imo, unnest(['a', 'b']) AS source, unnest([DATE '2024-01-02', DATE '2024-02-02']) + CAST(mmsi % 30 AS INT) AS d FROM i WHERE mmsi % 4 = 0), l AS (SELECT imo, min(d) AS designated, array_to_string(list_sort(list_distinct(list(CAST(d AS VARCHAR) || ' ' || source))), ',') AS designations FROM s GROUP BY imo),
k AS (SELECT mmsi, count(DISTINCT hour) AS hours, min(day) AS first, max(day) AS last FROM h GROUP BY mmsi), e AS (SELECT mmsi, count(*) AS n FROM p WHERE name = 'error' GROUP BY mmsi), j AS (SELECT imo, count(DISTINCT day) AS n_days FROM h JOIN i USING (mmsi) GROUP BY imo),
f AS (SELECT imo, flag, min(first) AS first FROM k JOIN i USING (mmsi) WHERE flag IS NOT NULL GROUP BY ALL)
SELECT imo, arg_min(name, (-hours, mmsi)) AS name, string_agg(mmsi, ',' ORDER BY hours DESC, mmsi) AS mmsis, coalesce((SELECT string_agg(flag, ',' ORDER BY f.first, flag) FROM f WHERE f.imo = i.imo), '') AS flags, min(first) AS first, max(last) AS last, max(n_days) AS n_days, CAST(sum(hours) AS BIGINT) AS hours, CAST(sum(coalesce(n, 0)) AS BIGINT) AS n_events, designated, designations, designated - min(first) AS lead_days
FROM i JOIN l USING (imo) JOIN k USING (mmsi) JOIN j USING (imo) LEFT JOIN e USING (mmsi) GROUP BY imo, designated, designations""")
def fleet_dossiers(read):
    p = _positions(read)
    k = F.col("mmsi")
    ids = p.select("mmsi", "imo", F.when(k % 3 == 0, "PA").when(k % 3 == 1, "DK").alias("flag"), F.concat(F.lit("SHIP "), (k % 40).cast("string")).alias("name")).distinct()
    day = lambda text: F.date_add(F.lit(text).cast("date"), (k % 30).cast("int"))
    listed = ids.where(k % 4 == 0).select("imo", F.explode(F.array(*(F.struct(F.lit(s).alias("source"), day(d).alias("designation_date")) for s, d in (("a", "2024-01-02"), ("b", "2024-02-02"))))).alias("x")).select("imo", "x.*")
    out = dt.fleet_dossiers(dt.presence(p, [], "timestamp", "mmsi"), ids, listed, p.where("name = 'error'"))
    return out.withColumns({c: F.array_join(F.col(c).cast("array<string>"), ",") for c in ("mmsis", "flags", "designations")}).withColumn("lead_days", F.col("lead_days").cast("long"))


@query(f"""WITH {_P}, c AS (SELECT mmsi, CAST(time_bucket(INTERVAL 1 DAY, timestamp) AS TIMESTAMP) AS slot, name, count(*) AS n FROM p GROUP BY ALL), m AS (SELECT mmsi, slot, arg_min(name, (-n, name)) AS name FROM c GROUP BY ALL)
SELECT mmsi, slot, round(median(sog), 6) AS sog, m.name FROM p JOIN m USING (mmsi) WHERE CAST(time_bucket(INTERVAL 1 DAY, timestamp) AS TIMESTAMP) = slot GROUP BY ALL""")
def slot_status(read):
    return dt.slots(_positions(read), "mmsi", "timestamp", "latitude", "longitude", "sog", 1440, "name").select("mmsi", "slot", r6("sog").alias("sog"), "name")
