"""Identity operators: which keys share an identity, how values changed over time, and linked groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import mid_of, valid_imo
from tidemark.storage import discard, written


def resolve_identity(df: DataFrame, key: str = "mmsi", imo: str = "imo", day: str = "date") -> DataFrame:
    """Valid (key, imo) pairs with counts and days, one row with a null imo per key without any, and whether a key has several."""
    pairs = df.where(valid_imo(F.col(imo))).groupBy(key, imo).agg(F.count("*").alias("message_count"), F.min(day).alias("first_seen"), F.max(day).alias("last_seen"))
    orphans = df.groupBy(key).agg(F.count("*").alias("message_count"), F.min(day).alias("first_seen"), F.max(day).alias("last_seen")).join(pairs.select(key), key, "left_anti")
    both = pairs.withColumn("is_orphaned", F.lit(False)).unionByName(orphans.withColumn("is_orphaned", F.lit(True)), allowMissingColumns=True)
    return both.withColumn("is_reused", F.count(imo).over(Window.partitionBy(key)) > 1)


def value_intervals(df: DataFrame, keys: Sequence[str], value: str, ts: str) -> DataFrame:
    """First and last time and count of each value of a key."""
    return df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.min(ts).alias("min_ts"), F.max(ts).alias("max_ts"), F.count("*").alias("n"))


def classify_intervals(intervals: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Per key with several values: flapping if any two of their intervals overlap, touching included, else clean switches.

    An interval overlaps an earlier one exactly if it starts no later than the latest end so far.
    """
    order = Window.partitionBy(*keys).orderBy("min_ts", "max_ts", value)
    before = F.max("max_ts").over(order.rowsBetween(Window.unboundedPreceding, -1))
    flagged = intervals.withColumn("__over", F.coalesce(before >= F.col("min_ts"), F.lit(False)))
    out = flagged.groupBy(*keys).agg(F.count("*").alias("n_values"), F.count_if("__over").alias("n_overlapping")).where("n_values > 1")
    return out.withColumn("kind", F.when(F.col("n_overlapping") > 0, "flapping").otherwise("clean_switch"))


def value_changes(intervals: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Consecutive transitions of keys that switch cleanly: old value, new value, when."""
    clean = classify_intervals(intervals, keys, value).where("kind = 'clean_switch'").select(*keys)
    order = Window.partitionBy(*keys).orderBy("min_ts", value)
    rows = intervals.join(clean, list(keys), "left_semi").withColumns({"old_value": F.lag(value).over(order), "event_time": F.col("min_ts")})
    return rows.where("old_value is not null").select(*keys, "old_value", F.col(value).alias("new_value"), "event_time")


def shared_pairs(members: DataFrame, group: Sequence[str], member: str, since: str, largest: int = 20) -> DataFrame:
    """Symmetric pairs (member, other) of a group, knowable when both are in it.

    A pair counts only if the group had at most `largest` members by then, ties at that moment
    included. Only a group's first `largest` members by time can ever be in such a pair, so no
    group is expanded beyond them.
    """
    # one more than can be in a pair is enough to tell the size; the limit works before the shuffle
    first = Window.partitionBy(*group).orderBy(since, member)
    members = members.withColumn("__n", F.row_number().over(first)).where(F.col("__n") <= largest + 1).drop("__n")
    by_time = Window.partitionBy(*group).orderBy(since)
    upto = members.withColumn("__size", F.count("*").over(by_time.rangeBetween(Window.unboundedPreceding, Window.currentRow))).where(F.col("__size") <= largest)
    a = upto.select(*group, F.col(member).alias("member"), F.col(since).alias("__s1"), F.col("__size").alias("__n1"))
    b = upto.select(*group, F.col(member).alias("other"), F.col(since).alias("__s2"), F.col("__size").alias("__n2"))
    return a.join(b, list(group)).where("member <> other").select(*group, "member", "other", F.greatest("__s1", "__s2").alias("knowable_at"), F.greatest("__n1", "__n2").alias("group_size"))


def connected_components(edges: DataFrame, a: str, b: str, rounds: int = 50) -> DataFrame:
    """(node, component): the smallest node reachable.

    Labels spread along edges and jump to their label's label, so that long chains take about the
    logarithm of their length in rounds. Every round is two grouped minima, written to the shared
    folder; only a count reaches the driver.
    """
    both = edges.select(F.col(a).alias("node"), F.col(b).alias("other")).unionByName(edges.select(F.col(b).alias("node"), F.col(a).alias("other"))).where("node is not null and other is not null").distinct()
    both = written(both, "links")
    labels = written(both.groupBy("node").agg(F.least(F.min("other"), F.first("node")).alias("component")), "labels")
    before = labels
    for _ in range(rounds):
        near = both.join(labels.toDF("other", "__c"), "other").groupBy("node").agg(F.min("__c").alias("__m"))
        spread = labels.join(near, "node").select("node", "component", F.least("component", "__m").alias("new"))
        jump = labels.toDF("new", "__j")
        step = written(spread.join(jump, "new").select("node", "component", F.least("new", "__j").alias("new")), "labels")
        changed = step.where("component <> new").limit(1).count()
        discard(before)
        before = step
        labels = step.select("node", F.col("new").alias("component"))
        if not changed:
            return labels
    raise RuntimeError(f"labels did not settle in {rounds} rounds")


def vessel_links(links: DataFrame, a: str = "mmsi_a", b: str = "mmsi_b") -> DataFrame:
    """Every linked key with its group ("vessel-" and the smallest key), the basis and confidence of its best link, and when that was first knowable."""
    found = connected_components(links, a, b)
    sides = links.select(F.col(a).alias("node"), "basis", "confidence", "knowable_at").unionByName(links.select(F.col(b).alias("node"), "basis", "confidence", "knowable_at"))
    best = sides.groupBy("node").agg(F.min_by("basis", F.struct(-F.col("confidence"), "knowable_at", "basis")).alias("link_basis"), F.max("confidence").alias("confidence"), F.min("knowable_at").alias("knowable_at"))
    return best.join(found, "node").select(F.col("node").alias("mmsi"), F.concat(F.lit("vessel-"), "component").alias("vessel_key"), "link_basis", "confidence", "knowable_at")


def with_flag(df: DataFrame, countries: DataFrame, key: str = "mmsi") -> DataFrame:
    """df with the flag state of each key, from a table of (mid, country); null where the prefix isn't in it."""
    return df.withColumn("mid", mid_of(F.col(key))).join(countries.select(F.col("mid").cast("int").alias("mid"), F.col("country").alias("flag_country")), "mid", "left")


def shared_value_events(static: DataFrame, values: Sequence[str], kind: str, base: float, key: str = "mmsi", ts: str = "timestamp", largest: int = 20, cross_bonus: float = 0.1) -> DataFrame:
    """A row for each ordered pair of keys that sent the same values (a number, or name and call sign), from when both had.

    Pairs of different flag states are marked and, with a bonus, surer. Groups of over `largest`
    keys make no pairs from then on: so many share a value by mistake.
    """
    firsts = static.where(" and ".join(f"{v} is not null" for v in values)).groupBy(*values, key).agg(F.min(ts).alias("__since"))
    pairs = shared_pairs(firsts, list(values), key, "__since", largest)
    cross = mid_of(F.col("member")) != mid_of(F.col("other"))
    return pairs.select(F.col("member").alias(key), F.col("other").alias(f"related_{key}"), F.lit(kind).alias("kind"), F.concat_ws(" / ", *values).alias("shared_value"), "knowable_at", cross.alias("cross_mid"), F.least(F.lit(1.0), F.lit(base) + F.when(cross, cross_bonus).otherwise(0.0)).alias("confidence"))


def flapping_values(intervals: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """One row for each key whose values overlap in time: how many, how many overlaps, and when it began to be knowable."""
    kinds = classify_intervals(intervals, keys, value).where("kind = 'flapping'")
    order = Window.partitionBy(*keys).orderBy("min_ts", "max_ts", value)
    seen = intervals.withColumn("__end", F.max("max_ts").over(order.rowsBetween(Window.unboundedPreceding, -1))).where(F.col("__end") >= F.col("min_ts"))
    return kinds.join(seen.groupBy(*keys).agg(F.min("min_ts").alias("event_time")), list(keys)).select(*keys, "n_values", "n_overlapping", "event_time")
