"""Every registered query of the engine's own operators, with the same result as DuckDB SQL.

Keys and times are those of the driver's tables: user_id stands for a vessel and ts for its time.
Doubles are rounded to 6 places on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import columns as fn
from tidemark.operators import aggregates as ag
from tidemark.operators import evaluation as ev
from tidemark.operators import identity as ident
from tidemark.operators import joins as jn
from tidemark.operators import timeline as tl

QUERIES: dict = {}
ORACLES: dict = {}
GAP_SECONDS = 6 * 3600


def query(sql: str | None = None):
    """Registers a function (read, spark) -> DataFrame under its name, with its SQL."""

    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet"))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def r6(c) -> "F.Column":
    return F.round(c, 6)


_SESSIONS = """
e AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6 > 21600 THEN 1 ELSE 0 END AS st
      FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, CAST(sum(st) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session_seq FROM e),
v AS (SELECT user_id, session_seq, min(ts) AS start_time, max(ts) AS end_time, count(*) AS point_count,
      arg_min(value, (ts, event_id)) AS start_value, arg_max(value, (ts, event_id)) AS end_value FROM s GROUP BY ALL)
"""


def _sessions(read):
    e = tl.sessionize(read("events"), ["user_id"], "ts", GAP_SECONDS, ["event_id"])
    return tl.session_summary(e, ["user_id"], "ts", ["value"], tie="event_id")


@query(f"""WITH {_SESSIONS} SELECT user_id, session_seq, gap_start, gap_end, last_value, next_value, round((epoch_us(gap_end) - epoch_us(gap_start)) / 1e6 / 3600, 6) AS gap_hours
FROM (SELECT user_id, session_seq, end_time AS gap_start, lead(start_time) OVER w AS gap_end, end_value AS last_value, lead(start_value) OVER w AS next_value FROM v WINDOW w AS (PARTITION BY user_id ORDER BY session_seq)) WHERE gap_end IS NOT NULL""")
def flagship_gap_sessions(read):
    return tl.session_gaps(_sessions(read), "user_id", values=["value"])


@query(f"WITH {_SESSIONS} SELECT user_id, session_seq, start_time, end_time, point_count, start_value, end_value, round((epoch_us(end_time) - epoch_us(start_time)) / 1e6, 6) AS duration_seconds FROM v")
def voyage_summary(read):
    return _sessions(read).withColumn("duration_seconds", r6("duration_seconds"))


@query("SELECT min(doc_id) AS doc_id, lang, source, length(text) AS n FROM documents GROUP BY text, lang, source")
def dedup_first(read):
    # a grouped minimum over a digest: combined before the shuffle, and no text is moved
    each = read("documents").groupBy(F.sha2("text", 256).alias("digest"), "lang", "source")
    return each.agg(F.min("doc_id").alias("doc_id"), F.first(F.length("text")).cast("long").alias("n")).drop("digest")


def _thin_sql(seconds: int) -> str:
    return f"SELECT event_id, user_id, ts, bucket, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, bucket ORDER BY ts, event_id) AS rn FROM (SELECT *, time_bucket(INTERVAL {seconds} SECOND, ts) AS bucket FROM events)) WHERE rn = 1"


@query(_thin_sql(300))
def thin_5min(read):
    return tl.thin(read("events"), "user_id", "ts", 300, ["event_id"]).select("event_id", "user_id", "ts", "bucket", "value")


@query(_thin_sql(3600))
def thin_1h(read):
    return tl.thin(read("events"), "user_id", "ts", 3600, ["event_id"]).select("event_id", "user_id", "ts", "bucket", "value")


@query("""WITH p AS (SELECT * FROM events WHERE event_type = 'purchase'), v AS (SELECT * FROM events WHERE event_type = 'view')
SELECT p.event_id, p.user_id, p.ts, v.ts AS asof_ts, v.event_id AS asof_event_id, v.value AS asof_value FROM p ASOF JOIN v ON p.user_id = v.user_id AND p.ts >= v.ts""")
def asof_last_view(read):
    e = read("events")
    left = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return jn.asof_join(left, e.where("event_type = 'view'"), ["user_id"], "ts", "ts", ["event_id", "value"], ["event_id"])


@query("""SELECT p.event_id, p.user_id, p.ts, n.ts AS next_ts, n.event_id AS next_event_id, n.value AS next_value FROM events p, LATERAL (
  SELECT ts, event_id, value FROM events v WHERE v.user_id = p.user_id AND v.event_type = 'view' AND v.ts > p.ts ORDER BY v.ts, v.event_id LIMIT 1) n WHERE p.event_type = 'purchase'""")
def next_view_after_purchase(read):
    e = read("events").select("event_id", "user_id", "ts", "event_type", "value")
    out = jn.next_event(e, ["user_id"], "ts", F.col("event_type") == "purchase", F.col("event_type") == "view", ["event_id", "value"], [])
    return out.select("event_id", "user_id", "ts", "next_ts", "next_event_id", "next_value")


@query(f"WITH {_SESSIONS} SELECT e.event_id, v.user_id, v.session_seq, e.event_type FROM events e JOIN v ON e.user_id = v.user_id AND e.ts BETWEEN v.start_time AND v.end_time")
def range_join_sessions(read):
    s = _sessions(read).select("user_id", "session_seq", "start_time", "end_time")
    return jn.points_in_intervals(read("events"), s, "user_id", "ts", "start_time", "end_time").select("event_id", "user_id", "session_seq", "event_type")


@query(f"""WITH {_SESSIONS}
SELECT l.user_id AS user_a, l.session_seq AS seq_a, r.user_id AS user_b, r.session_seq AS seq_b FROM v l JOIN v r ON l.user_id < r.user_id
 AND l.start_time - INTERVAL 30 MINUTE <= r.end_time + INTERVAL 30 MINUTE AND r.start_time - INTERVAL 30 MINUTE <= l.end_time + INTERVAL 30 MINUTE""")
def interval_overlap_pairs(read):
    s = _sessions(read).select("user_id", "session_seq", "start_time", "end_time")
    pairs = jn.overlapping_pairs(s, s, [], "start_time", "end_time", 1800)
    return pairs.where("l.user_id < r.user_id").select(F.col("l.user_id").alias("user_a"), F.col("l.session_seq").alias("seq_a"), F.col("r.user_id").alias("user_b"), F.col("r.session_seq").alias("seq_b"))


@query("""SELECT a.p_partkey AS a_key, b.p_partkey AS b_key, round(sqrt(pow(a.p_size - b.p_size, 2) + pow(a.p_retailprice - b.p_retailprice, 2)), 6) AS distance
FROM part a JOIN part b ON a.p_partkey < b.p_partkey AND sqrt(pow(a.p_size - b.p_size, 2) + pow(a.p_retailprice - b.p_retailprice, 2)) <= 2""")
def proximity_pairs(read):
    d = F.sqrt(F.pow(F.col("a.p_size") - F.col("b.p_size"), 2) + F.pow(F.col("a.p_retailprice") - F.col("b.p_retailprice"), 2))
    pairs = jn.proximity_pairs(read("part").select("p_partkey", "p_size", "p_retailprice"), "p_partkey", "p_size", "p_retailprice", 2.0, d <= 2, values={"distance": r6(d)})
    return pairs.select(F.col("a.p_partkey").alias("a_key"), F.col("b.p_partkey").alias("b_key"), "distance")


@query("""WITH k AS (SELECT l_orderkey, l_shipdate, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_shipdate, l_linenumber ORDER BY l_partkey, l_suppkey) AS rn FROM lineitem) WHERE rn = 1)
SELECT a.l_orderkey, a.l_shipdate, a.l_linenumber AS line_a, b.l_linenumber AS line_b, a.l_partkey AS part_a, b.l_partkey AS part_b FROM k a JOIN k b ON a.l_orderkey = b.l_orderkey AND a.l_shipdate = b.l_shipdate AND a.l_linenumber < b.l_linenumber""")
def same_ts_pairs(read):
    k = tl.first_per(read("lineitem"), ["l_orderkey", "l_shipdate", "l_linenumber"], ["l_partkey", "l_suppkey"])
    a = k.select("l_orderkey", "l_shipdate", F.col("l_linenumber").alias("line_a"), F.col("l_partkey").alias("part_a"))
    b = k.select("l_orderkey", "l_shipdate", F.col("l_linenumber").alias("line_b"), F.col("l_partkey").alias("part_b"))
    return a.join(b, ["l_orderkey", "l_shipdate"]).where("line_a < line_b")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def semi_customers(read):
    o = read("orders").where("o_totalprice > 300000")
    return read("customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_mktsegment")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def anti_customers(read):
    o = read("orders").where("o_totalprice > 300000")
    return read("customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_mktsegment")


@query("SELECT doc_id, lang, source FROM documents WHERE (lang, source) IN (SELECT (lang, source) FROM documents GROUP BY lang, source HAVING count(DISTINCT doc_id) > 5)")
def tuple_in_shared(read):
    d = read("documents").select("doc_id", "lang", "source")
    shared = d.groupBy("lang", "source").agg(F.count_distinct("doc_id").alias("n")).where("n > 5")
    return d.join(shared, ["lang", "source"], "left_semi").select("doc_id", "lang", "source")


@query("""SELECT n_nationkey, count(*) AS n, round(sum(bal), 6) AS balance FROM nation JOIN (SELECT c_nationkey AS k1, c_custkey % 25 AS k2, c_acctbal AS bal FROM customer) c ON n_nationkey = k1 OR n_nationkey = k2 GROUP BY n_nationkey""")
def or_key_join(read):
    c = read("customer").select(F.col("c_nationkey").cast("long").alias("k1"), (F.col("c_custkey") % 25).alias("k2"), F.col("c_acctbal").alias("bal"))
    spread = jn.either_key(c, "k1", "k2", "k")
    return read("nation").join(spread, F.col("n_nationkey") == F.col("k")).groupBy("n_nationkey").agg(F.count("*").alias("n"), r6(F.sum("bal")).alias("balance"))


_MONTHS = "m AS (SELECT c_custkey, CAST(month_end AS TIMESTAMP) + INTERVAL 1 DAY - INTERVAL 1 MICROSECOND AS cutoff, CAST(month_end AS DATE) AS month_end FROM customer, (SELECT last_day(unnest(generate_series(DATE '1996-01-01', DATE '1996-12-01', INTERVAL 1 MONTH))) AS month_end))"


def _spine(read):
    months = F.explode(F.expr("sequence(DATE '1996-01-01', DATE '1996-12-01', INTERVAL 1 MONTH)")).alias("m")
    day = F.last_day("m")
    return read("customer").select("c_custkey", months).select("c_custkey", day.alias("month_end"), (F.date_add(day, 1).cast("timestamp_ntz") - F.expr("INTERVAL '0.000001' SECOND")).alias("cutoff"))


@query(f"WITH {_MONTHS} SELECT c_custkey, month_end, count(o_orderkey) AS n_orders, count(o_orderkey) FILTER (o_totalprice > 250000) AS n_large FROM m LEFT JOIN orders ON o_custkey = c_custkey AND o_orderdate <= cutoff GROUP BY c_custkey, month_end")
def nonequi_cutoff_counts(read):
    o = read("orders").withColumnRenamed("o_custkey", "c_custkey")
    out = jn.running_counts_at(_spine(read), o, ["c_custkey"], "cutoff", "o_orderdate", {"n_orders": ("count", F.lit(True)), "n_large": ("count", F.col("o_totalprice") > 250000)})
    return out.drop("cutoff")


@query("""WITH m AS (SELECT c_custkey, CAST(unnest(generate_series(DATE '1996-01-01', DATE '1996-12-01', INTERVAL 1 MONTH)) AS DATE) AS year_month FROM customer),
o AS (SELECT o_custkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS year_month, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS nf, count(DISTINCT CAST(o_orderdate AS DATE)) AS days FROM orders GROUP BY ALL)
SELECT c_custkey, m.year_month, coalesce(n, 0) AS n_orders, coalesce(nf, 0) AS n_finished, coalesce(days, 0) AS days_active, round(coalesce(nf, 0) / nullif(coalesce(n, 0), 0), 6) AS finished_rate, round(coalesce(n, 0) / nullif(coalesce(days, 0), 0), 6) AS orders_per_day
FROM m LEFT JOIN o ON o_custkey = c_custkey AND o.year_month = m.year_month""")
def cross_month_panel(read):
    spine = read("customer").select("c_custkey", F.explode(F.expr("sequence(DATE '1996-01-01', DATE '1996-12-01', INTERVAL 1 MONTH)")).alias("year_month"))
    o = read("orders").groupBy(F.col("o_custkey").alias("c_custkey"), F.trunc("o_orderdate", "month").alias("year_month")).agg(F.count("*").alias("n_orders"), F.count_if(F.col("o_orderstatus") == "F").alias("n_finished"), F.count_distinct(F.col("o_orderdate").cast("date")).alias("days_active"))
    out = spine.join(o, ["c_custkey", "year_month"], "left").fillna(0, ["n_orders", "n_finished", "days_active"])
    return out.withColumns({"finished_rate": r6(fn.ratio(F.col("n_finished"), F.col("n_orders"))), "orders_per_day": r6(fn.ratio(F.col("n_orders"), F.col("days_active")))})


@query("SELECT user_id, " + ", ".join(f"count(*) FILTER (event_type = '{k}') AS n_{k}" for k in ("view", "click", "purchase", "signup", "error")) + ", count(*) AS n_total FROM events GROUP BY user_id")
def pivot_filter_counts(read):
    return ag.count_by_kind(read("events"), ["user_id"], "event_type", ["view", "click", "purchase", "signup", "error"])


@query("SELECT user_id, event_type, n FROM (SELECT user_id, event_type, count(*) AS n, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS rn FROM events GROUP BY user_id, event_type) WHERE rn = 1")
def modal_value(read):
    return ag.modal_value(read("events"), ["user_id"], "event_type")


@query("SELECT user_id, round(median(value), 6) AS median_value, round(median(value) FILTER (event_type = 'view'), 6) AS median_view, round(quantile_cont(value, 0.001), 6) AS q_low, round(quantile_cont(value, 0.999), 6) AS q_high, round(stddev_pop(value), 6) AS sd FROM events GROUP BY user_id")
def median_quantiles(read):
    q = lambda p: r6(F.percentile("value", p))
    return read("events").groupBy("user_id").agg(r6(F.median("value")).alias("median_value"), r6(F.median(F.when(F.col("event_type") == "view", F.col("value")))).alias("median_view"), q(0.001).alias("q_low"), q(0.999).alias("q_high"), r6(F.stddev_pop("value")).alias("sd"))


@query("SELECT o_custkey, arg_min(o_orderstatus, (o_orderdate, o_orderkey)) AS first_status, arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS largest_order, max(o_totalprice) AS largest_price FROM orders GROUP BY o_custkey")
def minmax_by(read):
    return read("orders").groupBy("o_custkey").agg(F.min_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey")).alias("first_status"), F.max_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("largest_order"), F.max("o_totalprice").alias("largest_price"))


@query("""WITH p AS (SELECT user_id, lag(event_type) OVER w AS prev_event_type, (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6 AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, prev_event_type, count(*) AS n_pairs, count(*) FILTER (gap <= 1800) AS n_hits, round(CASE WHEN count(*) >= 10 THEN count(*) FILTER (gap <= 1800) / count(*) END, 6) AS ratio FROM p WHERE gap IS NOT NULL GROUP BY user_id, prev_event_type""")
def ratio_min_support(read):
    p = tl.pair_with_previous(read("events"), ["user_id"], "ts", ["event_type"], ["event_id"])
    out = ag.supported_ratio(p, ["user_id", "prev_event_type"], fn.seconds_between(F.col("ts"), F.col("prev_ts")) <= 1800, 10)
    return out.withColumn("ratio", r6("ratio"))


@query("SELECT event_type, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS cell_hour, user_id, bool_or(value > 100) AS is_large, count(*) AS n_messages, min(ts) AS first_seen, max(ts) AS last_seen FROM events GROUP BY ALL")
def presence_hour(read):
    from tidemark.operators.detectors import presence

    out = presence(read("events"), ["event_type"], "ts", "user_id", F.col("value") > 100)
    return out.select("event_type", "cell_hour", "user_id", F.col("flag").alias("is_large"), "n_messages", "first_seen", "last_seen")


@query(f"""WITH {_SESSIONS}, g AS (SELECT user_id, session_seq, end_time AS gap_start, lead(start_time) OVER (PARTITION BY user_id ORDER BY session_seq) AS gap_end FROM v),
q AS (SELECT * FROM g WHERE gap_end IS NOT NULL),
c AS (SELECT q.user_id, q.session_seq, e.event_type, floor(e.value) AS cell FROM q JOIN events e ON e.user_id = q.user_id AND e.ts = q.gap_start),
p AS (SELECT event_type, floor(value) AS cell, date_trunc('hour', ts) AS h, user_id, min(ts) AS first_seen, max(ts) AS last_seen FROM events GROUP BY ALL),
j AS (SELECT q.user_id, q.session_seq, count(DISTINCT p.user_id) FILTER (p.last_seen >= q.gap_start AND p.first_seen <= q.gap_end) AS n_corroborators,
  count(*) FILTER (p.h < date_trunc('day', q.gap_start) AND p.h >= date_trunc('day', q.gap_start) - INTERVAL 10 DAY) AS vh,
  count(DISTINCT p.user_id) FILTER (p.h < date_trunc('day', q.gap_start) AND p.h >= date_trunc('day', q.gap_start) - INTERVAL 10 DAY) AS n_baseline
  FROM q JOIN c USING (user_id, session_seq) LEFT JOIN p ON p.event_type = c.event_type AND p.cell = c.cell AND p.user_id <> q.user_id GROUP BY ALL)
SELECT q.user_id, q.session_seq, coalesce(n_corroborators, 0) AS n_corroborators, coalesce(n_baseline, 0) AS n_baseline, round(coalesce(vh, 0) / 240.0 * (epoch_us(gap_end) - epoch_us(gap_start)) / 3.6e9, 6) AS expected,
 CASE WHEN coalesce(n_corroborators, 0) >= 1 THEN 'receiver_alive' WHEN coalesce(vh, 0) / 240.0 * (epoch_us(gap_end) - epoch_us(gap_start)) / 3.6e9 >= 3 AND coalesce(n_baseline, 0) >= 3 THEN 'area_dark' ELSE 'no_evidence' END AS verdict
FROM q LEFT JOIN j USING (user_id, session_seq)""")
def corroboration_verdict(read):
    from tidemark.operators.detectors import liveness_verdict, presence

    e = read("events").withColumn("cell", F.floor("value"))
    gaps = tl.session_gaps(_sessions(read), "user_id")
    cells = gaps.join(e.select("user_id", F.col("ts").alias("gap_start"), "event_type", "cell"), ["user_id", "gap_start"]).select("user_id", "session_seq", "event_type", "cell")
    out = liveness_verdict(gaps, cells, presence(e, ["event_type", "cell"], "ts", "user_id"), ["user_id", "session_seq"], ["event_type", "cell"], "user_id", baseline_days=10)
    return out.select("user_id", "session_seq", "n_corroborators", "n_baseline", r6("expected").alias("expected"), "verdict")


@query("SELECT user_id, event_type, count(*) AS n, CAST(grouping(user_id, event_type) AS BIGINT) AS grouping_id FROM events GROUP BY GROUPING SETS ((user_id), (event_type), (user_id, event_type), ())")
def grouping_sets_counts(read):
    return ag.counts_over_sets(read("events"), [["user_id"], ["event_type"], ["user_id", "event_type"], []])


@query("SELECT l_orderkey, array_to_string(list_sort(list_distinct(list(l_suppkey))), ',') AS suppliers, count(DISTINCT l_suppkey) AS n_suppliers FROM lineitem GROUP BY l_orderkey")
def distinct_array(read):
    return read("lineitem").groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_set("l_suppkey")), ",").alias("suppliers"), F.count_distinct("l_suppkey").alias("n_suppliers"))


@query("SELECT l_orderkey, string_agg(DISTINCT l_returnflag, '+' ORDER BY l_returnflag) AS flags FROM lineitem GROUP BY l_orderkey")
def string_agg_ordered(read):
    return read("lineitem").groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_set("l_returnflag")), "+").alias("flags"))


@query("SELECT c_custkey, ntile(5) OVER (ORDER BY c_acctbal, c_custkey) AS tile FROM customer")
def ordered_ntile(read):
    return ag.ordered_ntile(read("customer").select("c_custkey", "c_acctbal"), 5, ["c_acctbal", "c_custkey"]).select("c_custkey", "tile")


@query("SELECT event_id, user_id, last_value(x IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_known FROM (SELECT *, CASE WHEN event_type <> 'error' THEN value END AS x FROM events)")
def last_non_null_prior(read):
    e = read("events").withColumn("x", F.when(F.col("event_type") != "error", F.col("value")))
    return tl.last_known(e, ["user_id"], "ts", "x", ["event_id"]).select("event_id", "user_id", "last_known")


@query("""WITH f AS (SELECT *, row_number() OVER w > 1 AND event_type IS DISTINCT FROM lag(event_type) OVER w AS ch FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, arg_max(event_type, (ts, event_id)) AS state, count(*) FILTER (ch) AS n_changes, coalesce(max(ts) FILTER (ch), min(ts)) AS run_start FROM f GROUP BY user_id""")
def running_state_change(read):
    return tl.state_runs(read("events"), "user_id", "ts", "event_type", ["event_id"])


@query("""WITH s AS (SELECT *, sum(st) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM (
  SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6 > 7200 THEN 1 ELSE 0 END AS st FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))),
t AS (SELECT user_id, k, CAST(min(ts) AS DATE) AS day, arg_min(event_type, (ts, event_id)) AS cell, (epoch_us(max(ts)) - epoch_us(min(ts))) / 3.6e9 AS hours FROM s GROUP BY user_id, k),
d AS (SELECT cell, user_id, day, max(hours) AS hours FROM t GROUP BY ALL)
SELECT cell, count(DISTINCT user_id) AS n_vessels, count(*) AS n_vessel_days, round(sum(hours), 6) AS total_hours FROM d WHERE hours >= 1 GROUP BY cell HAVING count(DISTINCT user_id) >= 5""")
def stay_two_level(read):
    from tidemark.operators.detectors import stay_cells

    e = tl.sessionize(read("events"), ["user_id"], "ts", 7200, ["event_id"])
    out = stay_cells(e, "user_id", "ts", "session_seq", F.min_by("event_type", F.struct("ts", "event_id")), least_hours=1, least_vessels=5)
    return out.select("cell", "n_vessels", "n_vessel_days", r6("total_hours").alias("total_hours"))


@query("""WITH i AS (SELECT user_id, event_type, date_trunc('day', ts) AS d, min(ts) AS mn, max(ts) AS mx FROM events GROUP BY ALL),
o AS (SELECT *, max(mx) OVER (PARTITION BY user_id, d ORDER BY mn, mx, event_type ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= mn AS ov FROM i)
SELECT user_id, CAST(d AS DATE) AS day, count(*) AS n_values, count(*) FILTER (ov) AS n_overlapping, CASE WHEN count(*) FILTER (ov) > 0 THEN 'flapping' ELSE 'clean_switch' END AS kind FROM o GROUP BY user_id, d HAVING count(*) > 1""")
def interval_flapping(read):
    e = read("events").withColumn("day", F.col("ts").cast("date"))
    return ident.classify_intervals(ident.value_intervals(e, ["user_id", "day"], "event_type", "ts"), ["user_id", "day"], "event_type")


@query("""WITH g AS (SELECT *, count(*) OVER (PARTITION BY lang, source ORDER BY doc_id RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM documents),
k AS (SELECT * FROM g WHERE n <= 5)
SELECT a.lang, a.source, a.doc_id AS member, b.doc_id AS other, greatest(a.doc_id, b.doc_id) AS knowable_at, greatest(a.n, b.n) AS group_size FROM k a JOIN k b ON a.lang = b.lang AND a.source = b.source AND a.doc_id <> b.doc_id""")
def shared_pairs_as_of(read):
    return ident.shared_pairs(read("documents").select("lang", "source", "doc_id"), ["lang", "source"], "doc_id", "doc_id", 5)


@query("""WITH RECURSIVE e AS (SELECT DISTINCT o_custkey AS a, l_suppkey + 1000000000 AS b FROM orders JOIN lineitem ON l_orderkey = o_orderkey), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(node, component) USING KEY (node) AS (SELECT a, min(least(a, b)) FROM u GROUP BY a
 UNION SELECT u.b, min(r.component) FROM r JOIN u ON u.a = r.node JOIN recurring.r AS old ON old.node = u.b GROUP BY u.b HAVING min(r.component) < min(old.component))
SELECT node, component FROM r""")
def connected_components(read):
    """Customers and the suppliers of what they ordered."""
    e = read("orders").join(read("lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("a"), (F.col("l_suppkey") + 1000000000).alias("b"))
    return ident.connected_components(e, "a", "b")


@query("""SELECT user_id, n, round((degrees(atan2(s, c)) + 360) % 360, 6) AS mean_deg, round(sqrt(s * s + c * c), 6) AS resultant FROM (
SELECT user_id, count(*) AS n, avg(cos(radians(value % 360))) AS c, avg(sin(radians(value % 360))) AS s FROM events GROUP BY user_id)""")
def circular_mean(read):
    out = ag.circular_mean(read("events").withColumn("angle", F.col("value") % 360), ["user_id"], "angle")
    return out.withColumns({"mean_deg": r6("mean_deg"), "resultant": r6("resultant")})


@query("""WITH p AS (SELECT label, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings),
c AS (SELECT *, x - avg(x) OVER (PARTITION BY label) AS u, y - avg(y) OVER (PARTITION BY label) AS v, avg(x) OVER (PARTITION BY label) AS mx, avg(y) OVER (PARTITION BY label) AS my FROM p),
m AS (SELECT label, count(*) AS n, first(mx) AS mx, first(my) AS my, sum(u*u) AS uu, sum(u*v) AS uv, sum(v*v) AS vv, sum(u*(u*u+v*v)) AS uz, sum(v*(u*u+v*v)) AS vz, sum(u*u+v*v) AS z FROM c GROUP BY label),
f AS (SELECT label, n, mx + (uz*vv - vz*uv) / (2*(uu*vv-uv*uv)) AS cx, my + (vz*uu - uz*uv) / (2*(uu*vv-uv*uv)) AS cy, sqrt(pow((uz*vv - vz*uv) / (2*(uu*vv-uv*uv)), 2) + pow((vz*uu - uz*uv) / (2*(uu*vv-uv*uv)), 2) + z / n) AS radius FROM m)
SELECT label, n AS n_points, round(cx, 6) AS center_x, round(cy, 6) AS center_y, round(radius, 6) AS radius, round(sqrt(avg(pow(sqrt(pow(x - cx, 2) + pow(y - cy, 2)) - radius, 2))), 6) AS rms_residual,
 round(sqrt(pow(avg((x - cx) / sqrt(pow(x - cx, 2) + pow(y - cy, 2))), 2) + pow(avg((y - cy) / sqrt(pow(x - cx, 2) + pow(y - cy, 2))), 2)), 6) AS resultant FROM p JOIN f USING (label) GROUP BY label, n, cx, cy, radius""")
def circle_fit_moments(read):
    p = read("embeddings").select("label", F.get("embedding", F.lit(0)).cast("double").alias("x"), F.get("embedding", F.lit(1)).cast("double").alias("y"))
    out = ag.fit_circles(p, ["label"], "x", "y")
    return out.select("label", "n_points", *(r6(c).alias(c) for c in ("center_x", "center_y", "radius", "rms_residual", "resultant")))


@query("""WITH p AS (SELECT p_partkey, (p_size % 60) - 30.0 AS lat1, (p_retailprice % 180) - 90.0 AS lon1, (p_partkey % 50) - 25.0 AS lat2, (p_partkey % 170) - 85.0 AS lon2 FROM part),
h AS (SELECT *, pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2) AS a,
 sin(radians(lon2 - lon1)) * cos(radians(lat2)) AS y, cos(radians(lat1)) * sin(radians(lat2)) - sin(radians(lat1)) * cos(radians(lat2)) * cos(radians(lon2 - lon1)) AS x FROM p)
SELECT p_partkey, round(2 * 6371.0 * asin(sqrt(CASE WHEN a > 1 THEN 1 ELSE a END)), 6) AS km, round((degrees(atan2(y, x)) + 360) % 360, 6) AS bearing FROM h""")
def bearing_haversine(read):
    p = read("part").select("p_partkey", ((F.col("p_size") % 60) - 30.0).alias("lat1"), ((F.col("p_retailprice") % 180) - 90.0).alias("lon1"), ((F.col("p_partkey") % 50) - 25.0).alias("lat2"), ((F.col("p_partkey") % 170) - 85.0).alias("lon2"))
    c = [F.col(x) for x in ("lat1", "lon1", "lat2", "lon2")]
    return p.select("p_partkey", r6(fn.haversine_m(*c, radius=6371.0)).alias("km"), r6(fn.bearing_deg(*c)).alias("bearing"))


@query("SELECT source, bool_or(regexp_matches(text, '(trash|Licensed under|cookies)')) AS any_match, count(*) FILTER (regexp_matches(text, '^[A-Z]')) AS n_upper FROM documents GROUP BY source")
def regex_any_match(read):
    return read("documents").groupBy("source").agg(F.bool_or(F.col("text").rlike("(trash|Licensed under|cookies)")).alias("any_match"), F.count_if(F.col("text").rlike("^[A-Z]")).alias("n_upper"))


@query(r"SELECT p_partkey, nullif(trim(regexp_replace(upper(trim('@ ' || p_name || '  @', ' @')), '\s+', ' ', 'g')), '') AS name, upper(trim(p_type, ' @')) NOT IN ('UNKNOWN', 'UNDEFINED', 'N/A', 'NONE', 'NIL', '0') AS known FROM part")
def text_normalise(read):
    return read("part").select("p_partkey", fn.normal_text(F.concat(F.lit("@ "), "p_name", F.lit("  @"))).alias("name"), fn.known_text(fn.normal_text(F.col("p_type"))).alias("known"))


@query("""WITH k AS (SELECT l_orderkey, l_linenumber, lpad(CAST((l_orderkey * 7 + l_linenumber) % 10000000 AS VARCHAR), 7, '0') AS imo FROM lineitem)
SELECT l_orderkey, l_linenumber, imo, regexp_full_match(imo, '[0-9]{7}') AND imo <> '0000000' AND (7 * CAST(imo[1] AS INT) + 6 * CAST(imo[2] AS INT) + 5 * CAST(imo[3] AS INT) + 4 * CAST(imo[4] AS INT) + 3 * CAST(imo[5] AS INT) + 2 * CAST(imo[6] AS INT)) % 10 = CAST(imo[7] AS INT) AS is_valid FROM k""")
def imo_checksum(read):
    k = read("lineitem").select("l_orderkey", "l_linenumber", F.lpad(((F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 10000000).cast("string"), 7, "0").alias("imo"))
    return k.withColumn("is_valid", fn.valid_imo(F.col("imo")))


_SCORED = "d AS (SELECT doc_id, quality AS y, CAST(n_chars // 200 AS BIGINT) AS score FROM documents JOIN labels USING (doc_id))"


def _scored(read):
    return read("documents").join(read("labels"), "doc_id").select("doc_id", F.col("quality").alias("y"), F.floor(F.col("n_chars") / 200).alias("score"))


@query(f"WITH {_SCORED}, r AS (SELECT *, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS ar FROM d) SELECT CAST(sum(y) AS BIGINT) AS n_positive, CAST(count(*) - sum(y) AS BIGINT) AS n_negative, round((sum(ar) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))), 6) AS auc FROM r")
def avg_rank_auc(read):
    return ev.auc(_scored(read), "score", "y").withColumn("auc", r6("auc"))


@query(f"WITH {_SCORED}, t AS (SELECT * FROM d ORDER BY score DESC, doc_id LIMIT 50) SELECT (SELECT count(*) FROM t) AS k, round((SELECT avg(y) FROM t), 6) AS precision_at_k, (SELECT count(*) FROM d WHERE score = (SELECT min(score) FROM t)) AS n_tied_at_cutoff")
def precision_at_k(read):
    return ev.precision_at(_scored(read), "score", "y", "doc_id", 50).withColumn("precision_at_k", r6("precision_at_k"))


@query(f"""WITH {_SCORED}, l AS (SELECT score, count(*) AS w, sum(y) AS h FROM d GROUP BY score), c AS (SELECT *, coalesce(sum(w) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bw FROM l)
SELECT round(sum(CASE WHEN 50 - bw <= 0 THEN 0 WHEN 50 - bw >= w THEN h ELSE (50 - bw) * h / w END), 6) AS expected_hits, CAST(least(50, sum(w)) AS BIGINT) AS k, round(sum(CASE WHEN 50 - bw <= 0 THEN 0 WHEN 50 - bw >= w THEN h ELSE (50 - bw) * h / w END) / least(50, sum(w)), 6) AS expected_precision FROM c""")
def expected_precision_at_k(read):
    out = ev.expected_hits_at(_scored(read), "score", "y", 50)
    return out.select(r6("expected_hits").alias("expected_hits"), "k", r6("expected_precision").alias("expected_precision"))


@query(f"""WITH {_SCORED}, s AS (SELECT *, doc_id % 5 AS cutoff FROM d), l AS (SELECT cutoff, score, count(*) AS w, sum(y) AS h FROM s GROUP BY cutoff, score),
c AS (SELECT *, coalesce(sum(w) OVER (PARTITION BY cutoff ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bw FROM l),
e AS (SELECT cutoff, sum(CASE WHEN 20 - bw <= 0 THEN 0 WHEN 20 - bw >= w THEN h ELSE (20 - bw) * h / w END) AS hits, least(20, sum(w)) AS k, least(sum(h), 20, sum(w)) AS best FROM c GROUP BY cutoff)
SELECT count(*) AS n_cutoffs, CAST(sum(k) AS BIGINT) AS k_total, round(sum(hits) / sum(k), 6) AS pooled_precision, round(sum(best) / sum(k), 6) AS ceiling FROM e""")
def pooled_precision(read):
    out = ev.pooled_precision(_scored(read).withColumn("cutoff", F.col("doc_id") % 5), "cutoff", "score", "y", 20)
    return out.withColumns({"pooled_precision": r6("pooled_precision"), "ceiling": r6("ceiling")})


@query(f"""WITH {_SCORED}, c AS (SELECT count(*) FILTER (score > 10 AND y = 1) AS tp, count(*) FILTER (score > 10 AND y = 0) AS fp, count(*) FILTER (score <= 10 AND y = 1) AS fn, count(*) FILTER (score <= 10 AND y = 0) AS tn FROM d)
SELECT tp, fp, fn, tn, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round((tp / nullif(tp + fp, 0)) / nullif((tp + fn) / nullif(tp + fp + fn + tn, 0), 0), 6) AS lift FROM c""")
def rule_report(read):
    out = ev.rule_report(_scored(read).withColumn("rule", F.col("score") > 10), "rule", "y")
    return out.withColumns({c: r6(c) for c in ("precision", "recall", "lift")})


@query(f"""WITH {_SCORED}, t AS (SELECT *, ntile(5) OVER (ORDER BY score, doc_id) AS tile FROM d), g AS (SELECT tile, doc_id % 3 AS grp, count(*) FILTER (y = 1) AS n_positive, count(*) FILTER (y = 0) AS n_negative FROM t GROUP BY ALL) SELECT * FROM g WHERE n_positive > 0 AND n_negative > 0""")
def matched_groups(read):
    d = ag.ordered_ntile(_scored(read), 5, ["score", "doc_id"]).withColumn("grp", F.col("doc_id") % 3)
    return ev.matched_groups(d, "tile", "grp", "y")


@query("""WITH s AS (SELECT doc_id, 'salt|' || CAST(doc_id AS VARCHAR) AS s FROM documents)
SELECT doc_id, xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, length(s) + 1), lambda i: ascii(s[i])::BIGINT)), lambda r, b: list_reduce(list_concat([xor(r, b)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, z: xor(x >> 1, 3988292384 * (x & 1))))) % 2 AS part FROM s""")
def crc_split(read):
    salted = F.concat(F.lit("salt|"), F.col("doc_id").cast("string"))
    return read("documents").select("doc_id", (F.crc32(salted.cast("binary")) % 2).alias("part"))


@query("""WITH n AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n, sqrt(list_sum(list_transform(embedding, lambda x : CAST(x AS DOUBLE) * x))) AS norm FROM embeddings),
u AS (SELECT vec_id, label, n, list_transform(embedding, lambda x : x / norm) AS u FROM n WHERE n <= 2),
p AS (SELECT q.label AS query_label, q.vec_id AS query_id, c.label, list_inner_product(CAST(q.u AS DOUBLE[]), CAST(c.u AS DOUBLE[])) AS cosine FROM u q, u c WHERE q.n = 1 AND c.n = 2)
SELECT p.query_label, p.query_id, count(*) FILTER (p.cosine > o.cosine) + 1 AS rank, round(max(o.cosine), 6) AS own_cosine FROM p JOIN p o ON o.query_label = p.query_label AND o.label = o.query_label GROUP BY ALL""")
def retrieval_rank(read):
    return ev.retrieval_rank(read("embeddings"), "vec_id", "embedding", "label").select("query_label", "query_id", "rank", "own_cosine")


@query("""WITH d AS (SELECT DISTINCT user_id, event_type, CAST(ts AS DATE) AS day FROM events), g AS (SELECT *, day - CAST(row_number() OVER (PARTITION BY user_id, event_type ORDER BY day) AS INT) AS k FROM d)
SELECT user_id, event_type, min(day) AS first_day, max(day) AS last_day, count(*) AS n_days FROM g GROUP BY user_id, event_type, k""")
def month_islands(read):
    return tl.day_islands(read("events").withColumn("day", F.col("ts").cast("date")), ["user_id", "event_type"], "day")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_props_extract(read):
    return read("events").select("event_id", F.from_json("props", "k long").getField("k").alias("k"))


@query("SELECT event_id, user_id, NULL AS o_orderkey, value FROM events UNION ALL SELECT NULL, o_custkey, o_orderkey, o_totalprice FROM orders")
def union_by_name(read):
    e = read("events").select("event_id", "user_id", "value")
    o = read("orders").select(F.col("o_custkey").alias("user_id"), "o_orderkey", F.col("o_totalprice").alias("value"))
    return e.unionByName(o, allowMissingColumns=True).select("event_id", "user_id", "o_orderkey", "value")


@query("SELECT event_id, user_id, rn AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 64")
def topk_per_key(read):
    return tl.first_per(read("events"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 64, "rank").select("event_id", "user_id", "rank")


@query("SELECT user_id, max(ts) AS ts, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY user_id")
def stateful_latest(read):
    """Last known state per key: the batch twin of the streaming fold."""
    at = F.struct("ts", "event_id")
    return read("events").groupBy("user_id").agg(F.max("ts").alias("ts"), F.max_by("event_type", at).alias("event_type"), F.max_by("value", at).alias("value"))


from tidemark.plans import assessment, maritime  # noqa: E402,F401  (register their queries)
