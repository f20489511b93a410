"""Aggregations with a definite answer on ties, and fits from sufficient statistics."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.storage import written


def modal_value(df: DataFrame, keys: Sequence[str], value: str, count: str = "n") -> DataFrame:
    """Each key's most frequent value; ties go to the smallest."""
    n = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias(count))
    # the largest of (count, smallest value): one more aggregation, no window over a hot key
    top = n.groupBy(*keys).agg(F.max(count).alias("__top"))
    return n.join(top, list(keys)).where(F.col(count) == F.col("__top")).groupBy(*keys).agg(F.min(value).alias(value), F.max(count).alias(count))


def supported_ratio(df: DataFrame, keys: Sequence[str], hit: Column, least: int, n: str = "n_pairs", hits: str = "n_hits", name: str = "ratio") -> DataFrame:
    """Share of rows with hit per key; null with fewer than `least` rows."""
    out = df.groupBy(*keys).agg(F.count("*").alias(n), F.count_if(hit).alias(hits))
    return out.withColumn(name, F.when(F.col(n) >= least, F.col(hits) / F.col(n)))


def count_by_kind(df: DataFrame, keys: Sequence[str], kind: str, kinds: Sequence[str], prefix: str = "n_") -> DataFrame:
    """One count column per kind, and n_total."""
    return df.groupBy(*keys).agg(*(F.count_if(F.col(kind) == k).alias(f"{prefix}{k}") for k in kinds), F.count("*").alias(f"{prefix}total"))


def counts_over_sets(df: DataFrame, sets: Sequence[Sequence[str]]) -> DataFrame:
    """Counts over several groupings in one pass, with grouping_id telling which."""
    columns = list(dict.fromkeys(c for s in sets for c in s))
    return df.groupingSets([[F.col(c) for c in s] for s in sets], *columns).agg(F.count("*").alias("n"), F.grouping_id().alias("grouping_id")).select(*columns, "n", "grouping_id")


def circular_mean(df: DataFrame, keys: Sequence[str], angle: str) -> DataFrame:
    """Mean direction in [0, 360) and resultant length (1: all alike, 0: spread evenly)."""
    a = F.radians(angle)
    out = df.groupBy(*keys).agg(F.avg(F.cos(a)).alias("__c"), F.avg(F.sin(a)).alias("__s"), F.count("*").alias("n"))
    mean = F.pmod(F.degrees(F.atan2("__s", "__c")) + 360.0, F.lit(360.0))
    return out.select(*keys, "n", mean.alias("mean_deg"), F.hypot("__c", "__s").alias("resultant"))


def fit_circles(df: DataFrame, keys: Sequence[str], x: str, y: str, least: int = 3) -> DataFrame:
    """Algebraic least-squares circle per key: centre, radius, RMS residual, and resultant length of the directions.

    The 3x3 normal equations are solved by Cramer's rule over moment sums; a second pass over the
    rows gives the residuals. Keys with under `least` rows, or all on one line, give none.
    """
    X, Y = F.col(x).cast("double"), F.col(y).cast("double")
    mean = df.groupBy(*keys).agg(F.avg(X).alias("__mx"), F.avg(Y).alias("__my"))
    centred = df.join(mean, list(keys)).withColumns({"__x": X - F.col("__mx"), "__y": Y - F.col("__my")})
    u, v = F.col("__x"), F.col("__y")
    z = u * u + v * v
    m = centred.groupBy(*keys).agg(
        F.count("*").alias("n_points"), F.first("__mx").alias("__mx"), F.first("__my").alias("__my"),
        *(F.sum(e).alias(f"__{k}") for k, e in {"uu": u * u, "uv": u * v, "vv": v * v, "uz": u * z, "vz": v * z, "z": z}.items()),
    ).where(F.col("n_points") >= least)
    c = lambda k: F.col(f"__{k}")
    det = c("uu") * c("vv") - c("uv") * c("uv")
    a, b = (c("uz") * c("vv") - c("vz") * c("uv")) / (2 * det), (c("vz") * c("uu") - c("uz") * c("uv")) / (2 * det)
    fitted = m.where(F.abs(det) > 1e-12).select(*keys, "n_points", (c("mx") + a).alias("center_x"), (c("my") + b).alias("center_y"), F.sqrt(a * a + b * b + c("z") / F.col("n_points")).alias("radius"))
    rows = df.join(fitted, list(keys))
    dx, dy = X - F.col("center_x"), Y - F.col("center_y")
    r = F.hypot(dx, dy)
    unit = F.nullif(r, F.lit(0.0))
    second = rows.groupBy(*keys).agg(F.sqrt(F.avg(F.pow(r - F.col("radius"), 2))).alias("rms_residual"), F.hypot(F.avg(dx / unit), F.avg(dy / unit)).alias("resultant"))
    return fitted.join(second, list(keys))


def ordered_ntile(df: DataFrame, k: int, order: Sequence[str | Column], name: str = "tile") -> DataFrame:
    """Buckets 1 to k of equal size over the whole table in an order.

    A global window would pull all rows into one task; instead rows are range-partitioned and their
    rank is the partition's offset plus the rank inside it.
    """
    [rank] = unused(df, "rank")
    ranked = global_rank(df, order, rank)
    n = ranked.count()
    size, extra = divmod(n, k)
    r = F.col(rank) - 1
    big = extra * (size + 1)
    tile = F.when(r < big, F.floor(r / (size + 1))).otherwise(extra + F.floor((r - big) / max(size, 1))) + 1
    return ranked.withColumn(name, tile.cast("long")).drop(rank)


def global_rank(df: DataFrame, order: Sequence[str | Column], name: str = "rank") -> DataFrame:
    """1, 2, ... over the whole table in a total order, without one task that holds all rows."""
    before = totals_before(df, order, {name: F.lit(1)})
    out = before.withColumn(name, (F.col(name) + 1).cast("long"))
    out.written_to = before.written_to
    return out


def totals_before(df: DataFrame, order: Sequence[str | Column], sums: dict[str, Column], keys: Sequence[str] = ()) -> DataFrame:
    """df with sums over all rows before each in an order, per key or over the whole table.

    A window would pull a key's rows, or all of them, into one task. Instead rows are dealt to ranges
    of (keys, order) and written once, so that counts and rows agree whatever is recomputed; a row's
    sum is that of its key in its own range so far and in all ranges before. Ranges are contiguous, so
    at most one key goes on from one to the next, and what is broadcast has under two rows a range.
    The table of ranges can be discarded once the result has been written.
    """
    part, at, *others = unused(df, "part", "at", *(f"{w}_{n}" for w in ("v", "before") for n in sums), *(f"key_{k}" for k in keys))
    values, sooner, held = dict(zip(sums, others)), dict(zip(sums, others[len(sums) :])), others[2 * len(sums) :]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(df.withColumns({values[n]: c for n, c in sums.items()}).repartitionByRange(parts, *keys, *order).withColumn(part, F.spark_partition_id()), "ranges")
    each = dealt.groupBy(F.col(part).alias(at), *(F.col(k).alias(h) for k, h in zip(keys, held))).agg(*(F.sum(v).alias(v) for v in values.values()))
    if keys:
        several = each.groupBy(*held).agg(F.count("*").alias("n")).where("n > 1")
        each = each.alias("l").join(several.alias("r"), [F.col(f"l.{h}").eqNullSafe(F.col(f"r.{h}")) for h in held], "left_semi")
    earlier = Window.partitionBy(*held).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    offsets = each.select(at, *held, *(F.sum(values[n]).over(earlier).alias(sooner[n]) for n in sums))
    inside = Window.partitionBy(part, *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    same = [F.col(part) == F.col(at), *(F.col(k).eqNullSafe(F.col(h)) for k, h in zip(keys, held))]
    rows = dealt.withColumns({n: F.coalesce(F.sum(v).over(inside), F.lit(0)) for n, v in values.items()}).join(F.broadcast(offsets), same, "left")
    out = rows.withColumns({n: F.col(n) + F.coalesce(sooner[n], F.lit(0)) for n in sums}).select(*df.columns, *(n for n in sums if n not in df.columns))
    out.written_to = dealt.written_to
    return out


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes to be no column of df."""
    taken = {c.lower() for c in df.columns}
    line = "__"
    while any(f"{line}{n}".lower() in taken for n in names):
        line += "_"
    return [line + n for n in names]


def exact_quantiles(df: DataFrame, column: str, shares: Sequence[float]) -> list[float | None]:
    """Exact quantiles of a column, interpolated between neighbours; None without values.

    Values collapse into levels that are ranked over ranges, so that no task holds them all; what
    reaches the driver is two values for each share.
    """
    levels = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("v")).agg(F.count("*").alias("w"))
    ranked = totals_before(levels, ["v"], {"before": F.col("w")})
    n = ranked.agg(F.sum("w").alias("n")).first().n
    if not n:
        return [None] * len(shares)
    places = [s * (n - 1) for s in shares]
    at = lambda i: F.max(F.when((F.col("before") <= i) & (F.col("before") + F.col("w") > i), F.col("v")))
    found = ranked.agg(*(at(math.floor(p)).alias(f"a{i}") for i, p in enumerate(places)), *(at(math.ceil(p)).alias(f"b{i}") for i, p in enumerate(places))).first()
    return [found[f"a{i}"] + (found[f"b{i}"] - found[f"a{i}"]) * (p - math.floor(p)) for i, p in enumerate(places)]
