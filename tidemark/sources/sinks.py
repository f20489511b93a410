"""Sinks: idempotent writes with provenance, and compact exports of bounded results."""

from __future__ import annotations

import datetime
import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.aggregates import totals_before


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path or glob matches anything, in whatever store it names."""
    jvm = spark._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    found = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hadoop)
    return found is not None and len(found) > 0


def with_provenance(df: DataFrame, start: str, end: str, version: str) -> DataFrame:
    """Which window a row is of, and when and by which code it was built."""
    built = datetime.datetime.now(datetime.UTC).replace(tzinfo=None)
    return df.withColumns({"window_start": F.lit(start).cast("date"), "window_end": F.lit(end).cast("date"), "built_at": F.lit(built).cast("timestamp_ntz"), "git_sha": F.lit(version)})


def write_sorted(df: DataFrame, path: str, order: Sequence[str], partition_by: Sequence[str] = ()) -> None:
    """Parquet sorted within files, so that readers can skip row groups; partitions that are written are replaced, others stay."""
    out = df.sortWithinPartitions(*partition_by, *order).write.mode("overwrite")
    if partition_by:
        out = out.option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by)
    out.parquet(path)


def build_once(spark: SparkSession, path: str, build: Callable[[], DataFrame], force: bool = False) -> DataFrame:
    """The table at path, built if it isn't there (its _SUCCESS marker tells), or if forced."""
    if force or not path_exists(spark, f"{path}/_SUCCESS"):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def day_states(raw: DataFrame, clean: DataFrame, reduced: DataFrame, days: DataFrame) -> DataFrame:
    """Each day's place on the way absent, raw_only, clean, reduced, from the days that three tables have."""
    has = lambda d, n: d.select("date").distinct().withColumn(n, F.lit(True))
    all_ = days.join(has(raw, "r"), "date", "left").join(has(clean, "c"), "date", "left").join(has(reduced, "x"), "date", "left")
    return all_.select("date", F.when(F.col("x"), "reduced").when(F.col("c"), "clean").when(F.col("r"), "raw_only").otherwise("absent").alias("state"))


def verify(df: DataFrame, minimum_rows: int, unique: Sequence[str] = (), not_null: Sequence[str] = ()) -> dict[str, int]:
    """Counts of what is wrong with a written table; all zero if it can be relied on. One pass."""
    n = df.agg(F.count("*").alias("rows"), *(F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in not_null)).first().asDict()
    bad = {"missing_rows": max(0, minimum_rows - n.pop("rows")), **n}
    if unique:
        bad["repeated_keys"] = df.groupBy(*unique).count().where("count > 1").count()
    return bad


def export_json(df: DataFrame, path: str, most: int = 1_000_000) -> int:
    """A bounded result as one JSON array; more rows than `most` are an error, not a silent cut."""
    rows = [json.loads(r) for r in df.limit(most + 1).toJSON().collect()]
    if len(rows) > most:
        raise ValueError(f"over {most} rows; write Parquet instead")
    with open(path, "w") as out:
        json.dump(rows, out)
    return len(rows)


def pack_tracks(df: DataFrame, key: str, ts: str, lat: str, lon: str, box: tuple[float, float, float, float], most: int = 50_000) -> DataFrame:
    """(key, part, start, n, planes): tracks as little-endian 16-bit planes of longitude, latitude and minutes since the part's start, over a box.

    A part has at most `most` points and spans at most 65,535 minutes of its key's time, so a row is
    bounded however long a key has been heard.
    """
    south, west, north, east = box
    points = df.select(F.col(key).alias("key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("t"), F.col(lat).alias("lat"), F.col(lon).alias("lon"))
    first = points.groupBy(F.col("key").alias("own")).agg(F.min("t").alias("first"))
    placed = totals_before(points, ["t", "lat", "lon"], {"before": F.lit(1)}, ["key"]).join(first, F.col("key").eqNullSafe(F.col("own")))
    part = F.struct(F.floor((F.col("t") - F.col("first")) / (65_535 * 6e7)).alias("span"), F.floor(F.col("before") / most).alias("block"))
    ordered = F.array_sort(F.collect_list(F.struct("t", "lat", "lon")))
    scale = lambda x, low, high: F.rint((x - low) / (high - low) * 65535)

    def plane(value):
        whole = lambda p: F.greatest(F.least(value(p), F.lit(65535)), F.lit(0)).cast("long")
        byte = lambda v: F.lpad(F.hex(v), 2, "0")
        return F.array_join(F.transform("p", lambda p: F.concat(byte(whole(p).bitwiseAND(F.lit(255))), byte(F.call_function("shiftright", whole(p), F.lit(8))))), "")

    start = F.col("p")[0].t
    planes = F.concat(plane(lambda p: scale(p.lon, west, east)), plane(lambda p: scale(p.lat, south, north)), plane(lambda p: F.floor((p.t - start) / 6e7)))
    rows = placed.groupBy("key", part.alias("part")).agg(F.count("*").alias("n"), ordered.alias("p"))
    return rows.select(F.col("key").alias(key), "part", F.timestamp_micros(start).cast("timestamp_ntz").alias("start"), "n", F.unhex(planes).alias("planes"))
