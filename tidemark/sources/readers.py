"""Sources: positions from CSV, partitioned tables, sanction lists, and gates that count what they drop."""

from __future__ import annotations

import datetime
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.columns import valid_imo
from tidemark.sources.sinks import path_exists

#: The raw position files' columns, after `header_name`, and how they write time.
POSITION_SCHEMA = "timestamp timestamp_ntz, type_of_mobile string, mmsi long, latitude double, longitude double, navigational_status string, sog double, cog double, ship_type string"
POSITION_TIME = "dd/MM/yyyy HH:mm:ss"
#: Columns that a list with a preamble may have.
MOST_COLUMNS = 100


def header_name(name: str) -> str:
    """A column name in lower case, without a leading #, with _ for spaces and dashes."""
    return re.sub(r"[ -]+", "_", name.strip().lstrip("#").strip().lower())


def read_positions_csv(spark: SparkSession, paths: str | Sequence[str], schema: str = POSITION_SCHEMA) -> DataFrame:
    """Position files with a header; rows that don't fit the schema go. No inference pass."""
    return spark.read.option("header", True).option("mode", "DROPMALFORMED").option("timestampNTZFormat", POSITION_TIME).option("enforceSchema", True).schema(schema).csv(paths)


def with_source_file(df: DataFrame, name: str = "source_file") -> DataFrame:
    return df.withColumn(name, F.col("_metadata.file_path"))


def read_days(spark: SparkSession, root: str, start: str, end: str) -> tuple[DataFrame, list[str]]:
    """The days of a table partitioned by date, and those of the range that it lacks.

    The range prunes partitions before anything is read; for missing days only their folders are
    looked up, one of each day.
    """
    df = spark.read.parquet(root).where(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    days = (datetime.date.fromisoformat(end) - datetime.date.fromisoformat(start)).days + 1
    wanted = [str(datetime.date.fromisoformat(start) + datetime.timedelta(i)) for i in range(days)]
    return df, [d for d in wanted if not path_exists(spark, f"{root}/date={d}")]


def read_by_name(frames: Sequence[DataFrame]) -> DataFrame:
    """Tables whose columns drifted, one after the other; missing columns are null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def within_box(df: DataFrame, lat: str, lon: str, south: float, west: float, north: float, east: float) -> DataFrame:
    return df.where(F.col(lat).between(south, north) & F.col(lon).between(west, east))


def dedup_mirrored(df: DataFrame, id_col: str, ordinal: str) -> DataFrame:
    """One record per base id, which is the id without the suffix that marks a mirror; the first by ordinal stays."""
    base = F.regexp_replace(id_col, r"[.-](1|2)$", "")
    return df.groupBy(base.alias("base_id")).agg(F.min_by(F.struct(*df.columns), ordinal).alias("r")).select("base_id", "r.*")


def read_eu_list(spark: SparkSession, path: str) -> DataFrame:
    """A consolidated list in CSV (id, schema, name, countries, identifiers, sanctions, program_ids): vessels, one row per number, with the earliest date."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path).where(F.col("schema") == "Vessel")
    dates = F.transform(F.regexp_extract_all("sanctions", F.lit(r"(\d{4}-\d{2}-\d{2})"), 1), lambda d: d.try_cast("date"))
    imos = F.regexp_extract_all("identifiers", F.lit(r"IMO(\d+)"), 1)
    return rows.select(F.lit("EU").alias("source"), F.col("id").alias("source_id"), F.col("name").alias("vessel_name"), F.explode_outer(imos).alias("imo"), F.col("countries").alias("flag"), F.col("program_ids").alias("program"), F.array_min(dates).alias("designation_date"))


def read_uk_list(spark: SparkSession, path: str) -> DataFrame:
    """A list in CSV under one line of preamble: ships, one row per id with its primary name and its earliest date."""
    # a file is read in order by one task, as quoted fields may hold line breaks; the preamble has fewer fields than the rest
    wide = ", ".join(f"c{i} string" for i in range(MOST_COLUMNS))
    lines = spark.read.schema(wide).option("multiLine", True).option("escape", '"').csv(path).withColumn("n", F.monotonically_increasing_id())
    head = lines.where(F.array_contains(F.array(*(f"c{i}" for i in range(MOST_COLUMNS))), "Unique ID")).orderBy("n").limit(1).first()
    if head is None:
        raise ValueError(f"{path} has no header with a Unique ID")
    names = {i: head[f"c{i}"] for i in range(MOST_COLUMNS) if head[f"c{i}"]}
    rows = lines.where(F.col("n") > head.n).select(*(F.col(f"c{i}").alias(name) for i, name in names.items())).where(F.col("Designation Type") == "Ship")
    date = F.coalesce(F.try_to_timestamp("Date Designated", F.lit("dd/MM/yyyy")).cast("date"), F.col("Date Designated").try_cast("date"))
    primary = F.struct(F.when(F.col("Name type") == "Primary name", 0).otherwise(1).alias("p"), F.col("Name 6").alias("n"))
    return rows.groupBy(F.col("Unique ID").alias("source_id")).agg(F.min_by("Name 6", primary).alias("vessel_name"), F.min("IMO number").alias("imo"), F.first("Current believed flag of ship", ignorenulls=True).alias("flag"), F.min(date).alias("designation_date")).withColumn("source", F.lit("UK"))


def read_xml_records(spark: SparkSession, path: str, row_tag: str, schema: str) -> DataFrame:
    """Repeated elements of an XML file as rows of an explicit schema."""
    return spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)


def apply_gates(candidates: DataFrame, gates: Sequence[tuple[str, Column]]) -> tuple[DataFrame, DataFrame]:
    """Rows that fail no gate, and a count of the others by the first gate that each fails."""
    gate = F.lit(None).cast("string")
    for name, fails in reversed(gates):
        gate = F.when(F.coalesce(fails, F.lit(False)), name).otherwise(gate)
    marked = candidates.withColumn("gate", gate)
    return marked.where("gate is null").drop("gate"), marked.where("gate is not null").groupBy("gate").agg(F.count("*").alias("n"))


def designation_gates(cutoff: str) -> list[tuple[str, Column]]:
    """The gates of a sanction list, in order: no date, no valid number, designated after the cutoff."""
    return [("no_date", F.col("designation_date").isNull()), ("invalid_imo", ~valid_imo(F.col("imo"))), ("after_cap", F.col("designation_date") > F.lit(cutoff).cast("date"))]


def match_sanctions(identity: DataFrame, sanctions: DataFrame) -> DataFrame:
    """Keys joined to list entries by valid number; windows of one identity are collapsed first."""
    ids = identity.where(valid_imo(F.col("imo"))).groupBy("mmsi", "imo").agg(F.sum("message_count").alias("message_count"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.bool_or("is_reused").alias("is_reused"))
    return ids.join(sanctions.where(valid_imo(F.col("imo"))), "imo")


def keep_consistent_keys(aggregated: DataFrame, key: str, other: str) -> DataFrame:
    """Rows with a flag whether their key stands for several others."""
    shared = aggregated.groupBy(key).agg((F.count_distinct(other) > 1).alias("is_shared"))
    return aggregated.join(shared, key, "left")


def empty(spark: SparkSession, schema: str) -> DataFrame:
    """A typed relation without rows, for an input that is absent."""
    return spark.createDataFrame([], schema)
