"""Operators on rows ordered by time per key: de-duplication, thinning, sessions, gaps, runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import in_range, seconds_between, time_bucket, valid_position
from tidemark.operators.aggregates import totals_before


def first_per(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], n: int = 1, rank: str | None = None) -> DataFrame:
    """The first n rows of each key in an order; rank keeps the row number under that name."""
    name = rank or "__rank"
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")).where(F.col(name) <= n)
    return out if rank else out.drop(name)


def clean(df: DataFrame, ordinal: str, key: str = "mmsi", ts: str = "timestamp", lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """Rows with a key in range and a real position, the first by ordinal of each (key, time, position)."""
    return first_per(df.where(in_range(F.col(key))).where(valid_position(F.col(lat), F.col(lon))), [key, ts, lat, lon], [ordinal])


def clean_counts(df: DataFrame, ordinal: str, key: str = "mmsi", ts: str = "timestamp", lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """How many rows each rule of `clean` drops, in its order, and how many stay; one row, one pass and one exchange."""
    rule = F.when(~F.coalesce(in_range(F.col(key)), F.lit(False)), "key").when(~valid_position(F.col(lat), F.col(lon)), "position")
    groups = df.withColumn("__rule", rule).groupBy("__rule", key, ts, lat, lon).agg(F.count("*").alias("n"))
    count = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    kept = F.col("__rule").isNull()
    return groups.agg(
        count("n").alias("n_in"),
        count(F.when(F.col("__rule") == "key", F.col("n"))).alias("n_bad_key"),
        count(F.when(F.col("__rule") == "position", F.col("n"))).alias("n_bad_position"),
        count(F.when(kept, F.col("n") - 1)).alias("n_repeats"),
        count(F.when(kept, 1)).alias("n_out"),
    )


def thin(df: DataFrame, key: str, ts: str, seconds: int, tie: Sequence[str] = ()) -> DataFrame:
    """The first row per key and time bucket, with the bucket."""
    return first_per(df.withColumn("bucket", time_bucket(F.col(ts), seconds)), [key, "bucket"], [ts, *tie])


def sessionize(df: DataFrame, keys: Sequence[str], ts: str, max_gap_seconds: float, tie: Sequence[str] = (), name: str = "session_seq") -> DataFrame:
    """Numbers each key's sessions from 1: a new one starts where the gap is strictly larger than max_gap_seconds."""
    order = Window.partitionBy(*keys).orderBy(ts, *tie)
    gap = seconds_between(F.col(ts), F.lag(ts).over(order))
    start = F.when(gap.isNull() | (gap > max_gap_seconds), 1).otherwise(0)
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("__start", start).withColumn(name, F.sum("__start").over(running).cast("long")).drop("__start")


def session_summary(df: DataFrame, keys: Sequence[str], ts: str, values: Sequence[str] = (), session: str = "session_seq", tie: str | None = None) -> DataFrame:
    """One row per session: start, end, count, duration, and the values at both ends."""
    order = F.struct(ts, tie) if tie else F.col(ts)
    ends = [f(v, order).alias(f"{p}_{v}") for v in values for f, p in ((F.min_by, "start"), (F.max_by, "end"))]
    out = df.groupBy(*keys, session).agg(F.min(ts).alias("start_time"), F.max(ts).alias("end_time"), F.count("*").alias("point_count"), *ends)
    return out.withColumn("duration_seconds", seconds_between(F.col("end_time"), F.col("start_time")))


def session_gaps(sessions: DataFrame, key: str, session: str = "session_seq", values: Sequence[str] = ()) -> DataFrame:
    """Each session's end with the start of the key's next session."""
    order = Window.partitionBy(key).orderBy(session)
    nxt = [F.lead(f"start_{v}").over(order).alias(f"next_{v}") for v in values]
    rows = sessions.select(key, session, F.col("end_time").alias("gap_start"), F.lead("start_time").over(order).alias("gap_end"), *(F.col(f"end_{v}").alias(f"last_{v}") for v in values), *nxt)
    return rows.where("gap_end is not null").withColumn("gap_hours", F.round(seconds_between(F.col("gap_end"), F.col("gap_start")) / 3600, 6))


def pair_with_previous(df: DataFrame, keys: Sequence[str], ts: str, columns: Sequence[str], tie: Sequence[str] = ()) -> DataFrame:
    """Every row with prev_ values of the row before it; a key's first row goes."""
    order = Window.partitionBy(*keys).orderBy(ts, *tie)
    return df.select("*", *(F.lag(c).over(order).alias(f"prev_{c}") for c in (ts, *columns))).where(F.col(f"prev_{ts}").isNotNull())


def state_runs(df: DataFrame, key: str, ts: str, state: str, tie: Sequence[str] = ()) -> DataFrame:
    """Start of each key's current run of one state: its latest change, or its first row if it never changed."""
    order = Window.partitionBy(key).orderBy(ts, *tie)
    prev = F.lag(state).over(order)
    changed = F.when(F.row_number().over(order) > 1, ~F.col(state).eqNullSafe(prev)).otherwise(False)
    flagged = df.withColumn("__changed", changed)
    now = F.max_by(state, F.struct(ts, *tie))
    return flagged.groupBy(key).agg(now.alias("state"), F.count_if("__changed").alias("n_changes"), F.coalesce(F.max(F.when(F.col("__changed"), F.col(ts))), F.min(ts)).alias("run_start"))


def last_known(df: DataFrame, keys: Sequence[str], ts: str, value: str, tie: Sequence[str] = (), name: str = "last_known") -> DataFrame:
    """The last non-null value before each row."""
    before = Window.partitionBy(*keys).orderBy(ts, *tie).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(before))


def day_islands(df: DataFrame, keys: Sequence[str], day: str) -> DataFrame:
    """Runs of consecutive days: first, last and number of days."""
    days = df.select(*keys, day).where(F.col(day).isNotNull()).distinct()
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(day))
    island = days.withColumn("__island", F.date_sub(F.col(day), number))
    return island.groupBy(*keys, "__island").agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"), F.count("*").alias("n_days")).drop("__island")


def trip_runs(df: DataFrame, key: str, trip: str, least: int = 2) -> DataFrame:
    """Each trip of `least` points or more with its number of points, and where it begins when all of them stand end to end by key and trip."""
    runs = df.groupBy(key, trip).agg(F.count("*").alias("n_points")).where(F.col("n_points") >= least)
    return totals_before(runs, [key, trip], {"first_point": F.col("n_points")})
