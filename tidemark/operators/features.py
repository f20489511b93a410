"""Point-in-time features: nothing that becomes known after a cutoff enters a row before it."""

from __future__ import annotations

import datetime
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import clip, micros, ratio, seconds_between, signed_turn, time_bucket
from tidemark.operators.joins import running_counts_at
from tidemark.operators.timeline import first_per

#: Destinations in words that tell a trade, and how a blank one looks.
FOR_ORDERS = r"(FOR ORDER|\bOPL\b)"
BLANK_DESTINATIONS = ("", "UNKNOWN")
REGION_LAT_EDGES, REGION_LON_EDGES = (55.5, 57.3), (9.0, 11.0, 13.0)


def month_spine(keys: DataFrame, start: str, end: str) -> DataFrame:
    """Every key with every month between two dates, and each month's last day, the last one cut at `end`."""
    months = F.explode(F.expr(f"sequence(trunc(DATE '{start}', 'month'), DATE '{end}', INTERVAL 1 MONTH)"))
    day = F.least(F.last_day("year_month"), F.lit(end).cast("date"))
    return keys.withColumn("year_month", months).withColumn("month_end", day).withColumn("cutoff", F.date_add(day, 1).cast("timestamp_ntz") - F.expr("INTERVAL '0.000001' SECOND"))


def exposure(presence: DataFrame, key: str, hour: str = "cell_hour") -> DataFrame:
    """Hours and days per key and month in which it was heard."""
    month = F.trunc(F.col(hour).cast("date"), "month").alias("year_month")
    return presence.groupBy(key, month).agg(F.count_distinct(hour).alias("hours_present"), F.count_distinct(F.col(hour).cast("date")).alias("days_present"))


def panel(spine: DataFrame, key: str, counts: dict[str, tuple[DataFrame, str, Column]], presence: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """A row per key and month: cumulative counts of what was knowable by its end, exposure, rates and labels.

    counts maps a column to (events with the key, time when knowable, condition). labels has key
    and label_date (the earliest); a label is as of the month's end, or later.
    """
    # all counts in one sorted sequence per key: each event says which count it is of
    events = None
    for name, (df, ts, condition) in counts.items():
        one = df.where(condition).select(key, F.col(ts).alias("__ts"), F.lit(name).alias("__count"))
        events = one if events is None else events.unionByName(one)
    out = spine if events is None else running_counts_at(spine, events, [key], "cutoff", "__ts", {n: ("count", F.col("__count") == n) for n in counts})
    out = out.join(exposure(presence, key), [key, "year_month"], "left").fillna(0, ["hours_present", "days_present"])
    for name in counts:
        out = out.withColumns({f"{name}_per_day": ratio(F.col(name), F.col("days_present")), f"{name}_per_100h": 100 * ratio(F.col(name), F.col("hours_present"))})
    if labels is not None:
        known = F.col("label_date") <= F.col("month_end")
        out = out.join(labels, key, "left").withColumns({"label_is_known": F.coalesce(known, F.lit(False)), "label_comes_later": F.coalesce(~known, F.lit(False))}).drop("label_date")
    return out.drop("cutoff")


#: The kinds of events that a vessel's panel counts, the counts that get rates, and the probability from which a gap counts as deliberate.
SPOOFING_KINDS = ("impossible_speed", "on_land", "synthetic_circle", "simultaneous_position")
IDENTITY_KINDS = ("no_valid_imo", "name_change", "name_flapping", "callsign_change", "callsign_flapping", "reused_mmsi", "shared_imo", "shared_identity")
BEHAVIOUR_KINDS = ("destination_course_mismatch", "draught_change_unexplained")
RATED = ("n_gaps", "n_gaps_high_probability", "n_spoofing_events_total", "n_sts_episodes", "n_identity_anomalies_total", "n_destination_course_mismatch", "n_draught_change_unexplained")
HIGH_PROBABILITY = 0.6


def vessel_panel(
    spine: DataFrame, roster: DataFrame, flags: DataFrame, types: DataFrame, voyages: DataFrame, presence: DataFrame, gaps: DataFrame, spoofing: DataFrame,
    encounters: DataFrame, identity: DataFrame, behaviour: DataFrame, matches: DataFrame, window_end: str, key: str = "mmsi",
) -> DataFrame:
    """A row for each vessel of the roster and month of the spine: who it is, what was knowable of it by the month's end, rates, and labels.

    Counts, means and maxima are of gaps by their end, spoofing by its time, encounters of either side
    by their end, identity and behaviour by when they were knowable: all in one sorted sequence for
    each vessel, not a join for each table. A rate is a count by voyages, by days heard, and by
    thousands of messages, and null where nothing divides it. Labels, all named label_, are by the
    roster's number; what isn't known is no event, and what has no events has zero counts and null means.
    """
    row = lambda df, k, ts, table, kind, value: df.select(F.col(k).alias(key), F.col(ts).alias("at"), F.lit(table).alias("table"), kind.alias("kind"), value.cast("double").alias("value"))
    none, text = F.lit(None).cast("double"), F.lit(None).cast("string")
    longest = F.struct("gap_end", "probability", "duration_hours")
    g = gaps.select(key, longest.alias("g"), F.explode(F.array(F.struct(F.lit("gap").alias("t"), F.col("probability").cast("double").alias("v")), F.struct(F.lit("length").alias("t"), F.col("duration_hours").cast("double").alias("v")))).alias("e"))
    events = g.select(key, F.col("g.gap_end").alias("at"), F.col("e.t").alias("table"), text.alias("kind"), F.col("e.v").alias("value"))
    sides = encounters.select(F.explode(F.array_distinct(F.array("mmsi_a", "mmsi_b"))).alias("side"), "end_time", "confidence")
    for part in (row(spoofing, key, "event_time", "spoofing", F.col("kind"), none), row(sides, "side", "end_time", "sts", text, F.col("confidence")), row(identity, key, "knowable_at", "identity", F.col("kind"), none), row(behaviour, key, "knowable_at", "behaviour", F.col("kind"), none)):
        events = events.unionByName(part)
    of = lambda table, kind=None: (F.col("table") == table) if kind is None else (F.col("table") == table) & (F.col("kind") == kind)
    value = lambda table: F.when(of(table), F.col("value"))
    wanted = {
        "n_gaps": ("count", of("gap")), "n_gaps_high_probability": ("count", of("gap") & (F.col("value") >= HIGH_PROBABILITY)), "gap_total": ("sum", value("gap")), "max_gap_duration_hours": ("max", value("length")),
        **{f"n_{k}": ("count", of("spoofing", k)) for k in SPOOFING_KINDS}, "n_spoofing_events_total": ("count", of("spoofing")),
        "n_sts_episodes": ("count", of("sts")), "sts_total": ("sum", value("sts")), "max_sts_confidence": ("max", value("sts")),
        **{f"n_{k}": ("count", of("identity", k)) for k in IDENTITY_KINDS}, "n_identity_anomalies_total": ("count", of("identity")), **{f"n_{k}": ("count", of("behaviour", k)) for k in BEHAVIOUR_KINDS},
    }
    counted = running_counts_at(spine.join(roster.select(key), key, "left_semi"), events, [key], "cutoff", "at", wanted)
    counted = counted.withColumns({"mean_gap_probability": ratio(F.col("gap_total"), F.col("n_gaps")), "mean_sts_confidence": ratio(F.col("sts_total"), F.col("n_sts_episodes"))}).drop("gap_total", "sts_total", "cutoff")
    heard = exposure(presence, key).select(key, "year_month", F.col("hours_present").alias("n_observed_hours"), F.col("days_present").alias("n_observed_days"))
    who = roster.select(key, "imo", "is_orphaned", "is_reused", F.col("message_count").alias("total_message_count"))
    trips = voyages.groupBy(key).agg(F.count("*").alias("voyage_count"))
    out = counted.join(who, key).join(flags.select(key, "flag_country"), key, "left").join(types.select(key, "ship_type"), key, "left").join(trips, key, "left").join(heard, [key, "year_month"], "left")
    out = out.fillna(0, ["voyage_count", "n_observed_hours", "n_observed_days"])
    per = {"voyage": F.col("voyage_count"), "observed_day": F.col("n_observed_days"), "1000_messages": F.col("total_message_count") / 1000}
    out = out.withColumns({f"rate_{c.removeprefix('n_')}_per_{name}": ratio(F.col(c), by) for c in RATED for name, by in per.items()})
    listed = matches.where(F.col("imo").isNotNull()).groupBy("imo").agg(F.min("designation_date").alias("label_earliest_designation_date"), F.count_distinct(F.concat_ws(":", "source", "source_id")).alias("label_n_sanctions_sources"), F.lit(True).alias("label_is_sanctioned_ever"))
    first, end = F.col("label_earliest_designation_date"), F.lit(window_end).cast("date")
    no = F.lit(False)
    return out.join(listed, "imo", "left").withColumns({
        "label_is_sanctioned_ever": F.coalesce("label_is_sanctioned_ever", no), "label_n_sanctions_sources": F.coalesce("label_n_sanctions_sources", F.lit(0)),
        "label_is_sanctioned_as_of_window_end": F.coalesce(first <= end, no), "label_is_sanctioned_after_window_end": F.coalesce(first > end, no),
    })


def static_features(df: DataFrame, key: str, length: str, width: str, draught: str, destination: str) -> DataFrame:
    """Medians of plausible sizes, and whether any destination matches a pattern or is blank."""
    positive = lambda c: F.median(F.when(F.col(c) > 0, F.col(c)))
    d = F.upper(F.trim(F.coalesce(destination, F.lit(""))))
    return df.groupBy(key).agg(positive(length).alias("median_length"), positive(width).alias("median_width"), F.max(draught).alias("max_draught"), (F.max(draught) - F.min(F.when(F.col(draught) > 0, F.col(draught)))).alias("draught_range"), F.bool_or(d.rlike(FOR_ORDERS)).alias("any_for_orders"), F.bool_or(d.isin(*BLANK_DESTINATIONS)).alias("any_blank"), F.count_distinct(F.when(~d.isin(*BLANK_DESTINATIONS), d)).alias("n_destinations"))


def identity_history(segments: DataFrame, cutoffs: DataFrame, key: str, since: str, values: Sequence[str], lookback_days: int = 730) -> DataFrame:
    """Per key and cutoff: distinct values and changes among segments active in the lookback, and the age of the latest state.

    Active are the segments that began in the lookback, and the latest that began before it.
    """
    rows = segments.join(cutoffs, key).where(F.col(since) < F.col("cutoff"))
    early = F.col(since) < F.col("cutoff") - F.expr(f"INTERVAL {lookback_days} DAYS")
    order = Window.partitionBy(key, "cutoff", early).orderBy(F.desc(since))
    active = rows.withColumn("__early", early).withColumn("__rn", F.row_number().over(order)).where(~F.col("__early") | (F.col("__rn") == 1))
    by_time = Window.partitionBy(key, "cutoff").orderBy(since)
    for v in values:
        active = active.withColumn(f"__ch_{v}", F.when(F.row_number().over(by_time) > 1, ~F.col(v).eqNullSafe(F.lag(v).over(by_time))).otherwise(False))
    stats = [x for v in values for x in (F.count_distinct(v).alias(f"n_{v}"), F.count_if(f"__ch_{v}").alias(f"n_{v}_changes"))]
    last = F.greatest(*(F.coalesce(F.max(F.when(F.col(f"__ch_{v}"), F.col(since))), F.min(since)) for v in values)) if len(values) > 1 else F.coalesce(F.max(F.when(F.col(f"__ch_{values[0]}"), F.col(since))), F.min(since))
    return active.groupBy(key, "cutoff").agg(*stats, (seconds_between(F.col("cutoff"), last) / 86400).alias("state_age_days"))


def switched_into(segments: DataFrame, cutoffs: DataFrame, key: str, since: str, value: str, group: Sequence[str], tie: str | None = None, lookback_days: int = 730, name: str = "switched") -> DataFrame:
    """Per key and cutoff, whether a segment that began in the lookback has a value of the group while the one before it has none.

    The first segment of all is no switch; an unknown value is none of the group. Segments that begin
    at one time go by the tie column.
    """
    rows = segments.join(cutoffs, key).where(F.col(since) < F.col("cutoff"))
    order = Window.partitionBy(key, "cutoff").orderBy(since, *([tie] if tie else []))
    inside = lambda c: F.coalesce(c.isin(*group), F.lit(False))
    near = F.col(since) >= F.col("cutoff") - F.expr(f"INTERVAL {lookback_days} DAYS")
    marked = rows.select(key, "cutoff", (near & inside(F.col(value)) & ~inside(F.lag(value).over(order)) & F.lag(F.lit(True), 1, False).over(order)).alias("s"))
    return marked.groupBy(key, "cutoff").agg(F.bool_or("s").alias(name))


def visit_features(visits: DataFrame, cutoffs: DataFrame, key: str, end: str, flag: str, groups: dict[str, Sequence[str]], confidence: str | None = None, least_confidence: int = 3, lookback_days: int = 270) -> DataFrame:
    """Per key and cutoff, visits that ended in the lookback before it: all, distinct flags, and by flag group with days since the last."""
    if confidence:
        visits = visits.where(F.col(confidence) >= least_confidence)
    near = (F.col(end) < F.col("cutoff")) & (F.col(end) >= F.col("cutoff") - F.expr(f"INTERVAL {lookback_days} DAYS"))
    rows = cutoffs.join(visits.withColumnRenamed(key, "__k"), (F.col(key) == F.col("__k")) & near, "left")
    each = []
    for name, flags in groups.items():
        inside = F.col(flag).isin(*flags)
        each += [F.count_if(inside).alias(f"n_{name}"), F.least(F.floor(seconds_between(F.col("cutoff"), F.max(F.when(inside, F.col(end)))) / 86400), F.lit(lookback_days)).alias(f"days_since_{name}")]
    return rows.groupBy(key, "cutoff").agg(F.count(end).alias("n_visits"), F.count_distinct(flag).alias("n_flags"), *each)


def prior_share(df: DataFrame, key: str, window: str, flag: Column, most: int = 6) -> DataFrame:
    """Share of a key's previous windows, up to `most` of them, in which a condition held; null for its first."""
    each = df.groupBy(key, window).agg(F.bool_or(flag).cast("int").alias("__f"))
    before = Window.partitionBy(key).orderBy(window).rowsBetween(-most, -1)
    return each.select(key, window, F.count("__f").over(before).alias("n_prior"), F.avg("__f").over(before).alias("prior_share"))


def region(lat: Column, lon: Column) -> Column:
    """Number of the band of latitude and longitude, row by row."""
    row = sum(((lat >= e).cast("int") for e in REGION_LAT_EDGES), F.lit(0))
    return (row * (len(REGION_LON_EDGES) + 1) + sum(((lon >= e).cast("int") for e in REGION_LON_EDGES), F.lit(0))).cast("int")


def track_tokens(df: DataFrame, key: str, ts: str, lat: str, lon: str, sog: str, cog: str, draught: str) -> DataFrame:
    """One token per key and hour: mean position, speed, turning, draught step since the last known one, region, time since the last token."""
    hour = time_bucket(F.col(ts), 3600)
    a = F.radians(cog)
    t = df.groupBy(key, hour.alias("hour")).agg(F.count("*").alias("n"), F.avg(lat).alias("lat"), F.avg(lon).alias("lon"), F.avg(sog).alias("sog"), F.stddev_pop(sog).alias("sog_sd"), F.avg(F.cos(a)).alias("cog_cos"), F.avg(F.sin(a)).alias("cog_sin"), F.median(F.when(F.col(draught) > 0, F.col(draught))).alias("draught"))
    order = Window.partitionBy(key).orderBy("hour")
    known = F.last("draught", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    heading = F.degrees(F.atan2("cog_sin", "cog_cos"))
    t = t.withColumns({"heading": heading, "draught_step": F.col("draught") - known, "hours_since": (micros(F.col("hour")) - micros(F.lag("hour").over(order))) / 3.6e9})
    return t.withColumns({"turn": signed_turn(F.col("heading"), F.lag("heading").over(order)), "sog_clipped": clip(F.col("sog"), 0.0, 30.0), "region": region(F.col("lat"), F.col("lon")), "hour_of_day": F.hour("hour")})


def event_tokens(kinds: dict[str, tuple[DataFrame, str]], key: str, start: str, hours: int, most: int = 64) -> DataFrame:
    """The latest `most` events of each key from several tables, as (kind, hour since start), hours kept in range."""
    rows = None
    for kind, (df, ts) in kinds.items():
        one = df.select(key, F.lit(kind).alias("kind"), F.col(ts).alias("event_time"))
        rows = one if rows is None else rows.unionByName(one)
    at = F.floor((micros(F.col("event_time")) - micros(F.lit(start).cast("timestamp_ntz"))) / 3.6e9)
    rows = rows.withColumn("hour_idx", F.when(at < 0, 0).when(at > hours - 1, hours - 1).otherwise(at).cast("long"))
    return first_per(rows, [key], [F.desc("event_time"), "kind"], most, "rank")


def trip_features(identity: DataFrame, trips: DataFrame, start: str, end: str, lookback_days: int = 270, earliest: str | None = None) -> DataFrame:
    """For every key of a window: round trips that came back in the lookback before its end, how many laden, their share and rate per 30 days.

    identity has mmsi, imo and last_seen: a key stands for the number that it sent last (of those, the
    largest). trips have imo, west_time and is_laden_return; a share of no trips is null.
    """
    last = datetime.date.fromisoformat(end)
    low = max(d for d in (datetime.date.fromisoformat(earliest) if earliest else last - datetime.timedelta(lookback_days), last - datetime.timedelta(lookback_days)))
    roster = identity.groupBy("mmsi").agg(F.max_by("imo", F.when(F.col("imo").isNotNull(), F.struct("last_seen", "imo"))).alias("imo"))
    inside = trips.where((F.col("west_time") >= F.lit(str(low)).cast("timestamp_ntz")) & (F.col("west_time") < F.lit(str(last + datetime.timedelta(1))).cast("timestamp_ntz")))
    each = inside.groupBy("imo").agg(F.count("*").alias("__n"), F.count_if("is_laden_return").alias("__l"))
    n, laden = (F.coalesce(c, F.lit(0)) for c in ("__n", "__l"))
    days = max((last - low).days, 1)
    return roster.join(each, "imo", "left").select("mmsi", n.alias("n_trips"), laden.alias("n_laden_returns"), ratio(laden, n).alias("laden_share"), (laden / days * 30).alias("laden_per_30d"), F.lit(start).cast("date").alias("window_start"), F.lit(end).cast("date").alias("window_end"))
