"""What has been done to each day of a table: a manifest beside it, written under a lock, and listings of its days."""

from __future__ import annotations

import contextlib
import datetime
import json
import os
import re
import time
import uuid
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The fields that tell how far a day has come, from the last step to the first.
STATES = {"clean_discarded_at": "reduced", "cleaned_at": "clean", "downloaded_at": "raw_only"}
#: Seconds from which a lock counts as left behind, and between two tries.
STALE, EVERY = 60.0, 0.05
DAY = re.compile(r"date=(\d{4}-\d{2}-\d{2})$")


def store_of(spark: SparkSession, path: str):
    """The Hadoop file system that holds a path, and the path in it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def created(spark: SparkSession, path: str, text: str) -> bool:
    """Whether a file was made that wasn't there: one of several that try at a time succeeds."""
    if local := local_path(spark, path):  # the local store's own creation isn't exclusive
        os.makedirs(os.path.dirname(local), exist_ok=True)
        try:
            with open(os.open(local, os.O_CREAT | os.O_EXCL | os.O_WRONLY), "w", encoding="utf-8") as out:
                out.write(text)
        except FileExistsError:
            return False
        return True
    store, at = store_of(spark, path)
    try:
        out = store.create(at, False)
    except Exception as e:
        if "exist" in str(e).lower():
            return False
        raise
    out.write(bytearray(text.encode()))
    out.close()
    return True


def local_path(spark: SparkSession, path: str) -> str | None:
    """The path on this machine's own file system, or None if another store has it."""
    store, at = store_of(spark, path)
    where = urlparse(store.makeQualified(at).toString())
    return unquote(where.path) if where.scheme == "file" else None


def replace(spark: SparkSession, new: str, path: str) -> None:
    """Puts a file in the place of another, or of none, at once."""
    if local := local_path(spark, path):
        os.replace(local_path(spark, new), local)
        return
    hadoop = spark._jvm.org.apache.hadoop.fs
    at, to = hadoop.Path(new), hadoop.Path(path)
    options = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    options[0] = hadoop.Options.Rename.OVERWRITE
    hadoop.FileContext.getFileContext(to.toUri(), spark._jsc.hadoopConfiguration()).rename(at, to, options)


def text_of(spark: SparkSession, path: str) -> str | None:
    store, at = store_of(spark, path)
    if not store.exists(at):
        return None
    stream = store.open(at)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


@contextlib.contextmanager
def locked(spark: SparkSession, path: str, stale: float = STALE) -> Iterator[None]:
    """Holds the lock of a path, a file beside it in the same store that only one can make.

    A lock older than `stale` seconds was left by a process that ended; it is put aside under a name of
    its own, which one of several that wait can do, and then anyone's to take. A holder that finds its lock taken by another, having been slow,
    leaves that one alone.
    """
    lock, mine = f"{path}.lock", uuid.uuid4().hex
    while not created(spark, lock, mine):
        store, at = store_of(spark, lock)
        with contextlib.suppress(Exception):  # gone in the meantime
            if time.time() - store.getFileStatus(at).getModificationTime() / 1000 > stale:
                aside = store_of(spark, f"{lock}.{uuid.uuid4().hex}")[1]
                if store.rename(at, aside):
                    store.delete(aside, False)
                continue
        time.sleep(EVERY)
    try:
        yield
    finally:
        if text_of(spark, lock) == mine:
            store, at = store_of(spark, lock)
            store.delete(at, False)


def load(spark: SparkSession, path: str) -> dict[str, dict]:
    """The entries by day; none if there is no manifest yet."""
    text = text_of(spark, path)
    return json.loads(text) if text else {}


def record(spark: SparkSession, path: str, day: str, stale: float = STALE, **fields) -> dict[str, dict]:
    """Adds fields to a day's entry; what other processes write meanwhile stays. A reader never sees half a manifest."""
    with locked(spark, path, stale):
        entries = load(spark, path)
        entries[day] = entries.get(day, {}) | fields
        whole = f"{path}.{uuid.uuid4().hex}"
        created(spark, whole, json.dumps(entries, indent=1, sort_keys=True))
        replace(spark, whole, path)
    return entries


def day_state(entry: dict | None) -> str:
    """absent, raw_only, clean or reduced: the furthest step that a day's entry tells."""
    return next((state for field, state in STATES.items() if entry and field in entry), "absent")


def day_paths(spark: SparkSession, root: str, start: str, end: str, legacy: str | None = None) -> dict[str, str | None]:
    """Each day of a range with what holds it: its folder, else the legacy file if that covers it, else None.

    The root is listed once, whatever the range. The legacy table, from before days had folders, has a
    `date` column, of which the first and last are looked up if a folder is missing.
    """
    store, at = store_of(spark, root)
    folders = {m[1]: s.getPath().toString() for s in (store.listStatus(at) if store.exists(at) else []) if s.isDirectory() and (m := DAY.search(s.getPath().getName()))}
    first = datetime.date.fromisoformat(start)
    days = [str(first + datetime.timedelta(i)) for i in range((datetime.date.fromisoformat(end) - first).days + 1)]
    held: tuple[str, str] | None = None
    if legacy and any(d not in folders for d in days) and store_of(spark, legacy)[0].exists(store_of(spark, legacy)[1]):
        r = spark.read.parquet(legacy).agg(F.min("date").cast("string").alias("a"), F.max("date").cast("string").alias("b")).first()
        held = (r.a, r.b) if r.a else None
    return {d: folders.get(d, legacy if held and held[0] <= d <= held[1] else None) for d in days}


def read_listed_days(spark: SparkSession, root: str, start: str, end: str, legacy: str | None = None) -> tuple[DataFrame | None, list[str]]:
    """The rows of a range of days, from their folders first and the legacy table for the rest, and the days that neither has."""
    found = day_paths(spark, root, start, end, legacy)
    own = [p for p in found.values() if p not in (None, legacy)]
    rest = [d for d, p in found.items() if p is not None and p == legacy]
    out = spark.read.option("basePath", root).parquet(*own).withColumn("date", F.col("date").cast("date")) if own else None
    if rest:
        old = spark.read.parquet(legacy).withColumn("date", F.col("date").cast("date")).where(F.col("date").isin([datetime.date.fromisoformat(d) for d in rest]))
        out = old if out is None else out.unionByName(old, allowMissingColumns=True)
    return out, [d for d, p in found.items() if p is None]


def retention_gate(before: DataFrame, after: DataFrame, day: str = "date", least: float = 0.3) -> DataFrame:
    """(day, n_before, n_after, retained, passes): whether a step kept any of a day's rows, and a plausible share of them."""
    a, b = (df.groupBy(day).agg(F.count("*").alias(n)) for df, n in ((before, "n_before"), (after, "n_after")))
    out = a.join(b, day, "full").select(day, F.coalesce("n_before", F.lit(0)).alias("n_before"), F.coalesce("n_after", F.lit(0)).alias("n_after"))
    share = F.col("n_after") / F.nullif(F.col("n_before"), F.lit(0))
    return out.withColumn("retained", share).withColumn("passes", F.coalesce((share >= least) & (F.col("n_after") > 0), F.lit(False)))


def rate_gate(events: DataFrame, kind: str, per_day: dict[str, float], n_days: int, most: float = 10.0) -> DataFrame:
    """(kind, observed, expected, off_by, passes): whether each kind's count is within an order of magnitude of its usual rate.

    off_by is how many times too many or too few there are, infinite for none; a rate that expects
    none, or less than one and finds none, tells nothing and passes.
    """
    usual = events.sparkSession.createDataFrame([(k, float(v) * n_days) for k, v in sorted(per_day.items())], f"{kind} string, expected double")
    seen = events.groupBy(kind).agg(F.count("*").alias("observed"))
    n, e = F.coalesce("observed", F.lit(0)).cast("double"), F.col("expected")
    off = F.when((e <= 0) | ((n == 0) & (e < 1)), None).when(n == 0, float("inf")).otherwise(F.greatest(n / e, e / n))
    return usual.join(seen, kind, "left").select(kind, n.cast("long").alias("observed"), "expected", off.alias("off_by"), F.coalesce(off <= most, F.lit(True)).alias("passes"))
