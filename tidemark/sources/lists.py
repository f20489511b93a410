"""Sanction lists whose parts refer to each other, and registries whose entries disagree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.columns import valid_imo
from tidemark.sources.readers import read_xml_records

#: The labels of the kinds that an advanced list names by number, and its number of the Latin script.
KINDS = {"PartySubType": "Vessel", "FeatureType": "Vessel Flag", "IDRegDocType": "Vessel Registration Identification", "EntryEventType": "Created"}
LATIN = "215"
PROFILE = """_ID string, _PartySubTypeID string,
 Identity array<struct<_ID: string, _Primary: string, Alias: array<struct<_Primary: string, DocumentedName: array<struct<DocumentedNamePart: array<struct<NamePartValue: array<struct<_ScriptID: string, _VALUE: string>>>>>>>>>>,
 Feature array<struct<_FeatureTypeID: string, FeatureVersion: array<struct<VersionDetail: array<string>>>, IdentityReference: array<struct<_IdentityID: string>>>>"""
ENTRY = """_ProfileID string, EntryEvent array<struct<_EntryEventTypeID: string, Date: array<struct<Year: string, Month: string, Day: string>>>>, SanctionsMeasure array<struct<Comment: string>>"""
DOCUMENT = "_IDRegDocTypeID string, _IdentityID string, IDRegistrationNo string"


class ListError(ValueError):
    """A list isn't built as it should be."""


def none_of(df: DataFrame, complaint: str) -> None:
    """An error that names the first row, if there is one."""
    for row in df.limit(1).collect():
        raise ListError(f"{complaint}: {row}")


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def whole_number(c: Column) -> Column:
    """A text of digits alone as a number; null for any other."""
    return F.when(F.trim(c).rlike("^[0-9]+$"), F.trim(c).try_cast("int"))


def read_advanced_list(spark: SparkSession, path: str) -> DataFrame:
    """A list in advanced XML: its vessels, each with its name, flag, number and earliest designation.

    Names of kinds are resolved to the list's numbers first. Profiles of vessels have a primary identity
    with a primary name (of several scripts the Latin one, else the first), a flag among the features
    that refer to that identity, and a number among the documents that do, its first of digits alone. Of all entries of a
    profile the earliest "Created" event counts, with the program of its entry; a date may lack its day
    or month, which precision tells. A list without those kinds, a vessel without primary name or
    designation, or a designation without a year is an error.
    """
    read = lambda tag, schema: read_xml_records(spark, path, tag, schema)
    number = {}
    for tag, label in KINDS.items():
        found = [r._ID for r in read(tag, "_ID string, _VALUE string").where(F.trim("_VALUE") == label).select("_ID").distinct().limit(2).collect()]
        if len(found) != 1:
            raise ListError(f"{tag} has {len(found)} kinds {label!r}")
        number[tag] = found[0]
    first = lambda xs, test: F.get(F.filter(xs, test), F.lit(0))
    primary = lambda x: x["_Primary"] == "true"
    vessels = read("Profile", PROFILE).where(F.col("_PartySubTypeID") == number["PartySubType"])
    v = vessels.select(F.col("_ID").alias("profile_id"), first(F.col("Identity"), primary).alias("identity"), "Feature").withColumn("alias", first(F.col("identity.Alias"), primary))
    parts = F.flatten(F.transform("alias.DocumentedName", lambda n: F.flatten(F.transform(n["DocumentedNamePart"], lambda p: p["NamePartValue"]))))
    v = v.withColumn("names", F.filter(parts, lambda p: blank_to_null(p["_VALUE"]).isNotNull()))
    latin = first(F.col("names"), lambda p: p["_ScriptID"] == LATIN)["_VALUE"]
    refers = lambda f: (f["_FeatureTypeID"] == number["FeatureType"]) & F.exists(f["IdentityReference"], lambda r: r["_IdentityID"] == F.col("identity._ID"))
    detail = lambda f: blank_to_null(F.get(F.flatten(F.transform(f["FeatureVersion"], lambda x: x["VersionDetail"])), F.lit(0)))
    flags = F.filter(F.transform(F.filter("Feature", refers), detail), lambda d: d.isNotNull())
    v = v.select("profile_id", F.col("identity._ID").alias("identity_id"), F.trim(F.coalesce(latin, F.get("names", F.lit(0))["_VALUE"])).alias("vessel_name"), F.get(flags, F.lit(0)).alias("flag"))
    none_of(v.where("vessel_name is null"), "a vessel has no primary name")
    papers = read("IDRegDocument", DOCUMENT).where(F.col("_IDRegDocTypeID") == number["IDRegDocType"]).withColumn("n", F.monotonically_increasing_id())
    papers = papers.select(F.col("_IdentityID").alias("identity_id"), "n", F.trim(F.regexp_replace("IDRegistrationNo", "^IMO", "")).alias("imo")).where(F.col("imo").rlike("^[0-9]+$"))
    imos = papers.groupBy("identity_id").agg(F.min_by("imo", "n").alias("imo"))
    created = F.filter("EntryEvent", lambda e: e["_EntryEventTypeID"] == number["EntryEventType"])
    program = F.coalesce(F.get(F.filter(F.transform("SanctionsMeasure", lambda m: blank_to_null(m["Comment"])), lambda c: c.isNotNull()), F.lit(0)), F.lit("UNKNOWN"))
    events = read("SanctionsEntry", ENTRY).select(F.col("_ProfileID").alias("profile_id"), program.alias("program"), F.explode(created).alias("e")).withColumn("d", F.get("e.Date", F.lit(0)))
    events = events.join(v.select("profile_id"), "profile_id", "left_semi")
    year, month, day = (whole_number(F.col(f"d.{p}")) for p in ("Year", "Month", "Day"))
    none_of(events.where(year.isNull()), "a designation has no year")
    known = F.when(month >= 1, F.when(day >= 1, "day").otherwise("month")).otherwise("year")
    date = F.make_date(year, F.when(month >= 1, month).otherwise(1), F.when((month >= 1) & (day >= 1), day).otherwise(1))
    least = events.select("profile_id", "program", date.alias("designation_date"), known.alias("precision")).groupBy("profile_id").agg(F.min(F.struct("designation_date", "precision", "program")).alias("e"))
    out = v.join(imos, "identity_id", "left").join(least, "profile_id", "left")
    none_of(out.where("e is null").select("profile_id", "vessel_name"), "a vessel has no designation")
    return out.select(F.lit("ofac").alias("source"), F.col("profile_id").alias("source_id"), "vessel_name", "imo", "flag", "e.program", "e.designation_date", F.col("e.precision").alias("designation_date_precision"))


#: The fields of a schedule list's records.
SCHEDULE = {"imo": "ShipIMONumber-NumeroOMIDuNavire", "date": "DateOfListing-DateDinscription", "name": "EntityOrShip-EntiteOuNavire", "schedule": "Schedule-Annexe", "item": "Item-NumeroDarticle"}


def read_schedule_list(spark: SparkSession, path: str) -> DataFrame:
    """A consolidated list of schedules in XML: its ships, one row a number, by their earliest dated record.

    Records without a number are no ships. A ship without any date has a null one, for a gate to drop;
    the country that a record names is the regime's and no flag.
    """
    rows = read_xml_records(spark, path, "record", ", ".join(f"`{f}` string" for f in SCHEDULE.values()))
    r = rows.select(*(blank_to_null(F.col(f"`{f}`")).alias(n) for n, f in SCHEDULE.items()), F.monotonically_increasing_id().alias("n")).where("imo is not null").withColumn("date", F.col("date").try_cast("date"))
    order = F.struct(F.col("date").isNull().alias("undated"), "date", "n")
    one = r.groupBy("imo").agg(F.min_by(F.struct("date", "name", "schedule", "item"), order).alias("r")).select("imo", "r.*")
    source_id = F.when(F.col("schedule").isNotNull() & F.col("item").isNotNull(), F.concat_ws("-", F.lit("ca"), "schedule", "item")).otherwise(F.concat(F.lit("ca-"), F.col("imo")))
    return one.select(F.lit("ca").alias("source"), source_id.alias("source_id"), F.coalesce("name", F.lit("")).alias("vessel_name"), "imo", F.lit(None).cast("string").alias("flag"), F.coalesce(F.concat(F.lit("SEMA Schedule "), F.col("schedule")), F.lit("UNKNOWN")).alias("program"), F.col("date").alias("designation_date"))


def read_eu_vessels(spark: SparkSession, path: str, program: str = "Article 3s") -> DataFrame:
    """A list of designated vessels in CSV with semicolons: those under a program, one row a number, by their earliest date.

    Header names are trimmed. A vessel without any date has a null one, for a gate to drop.
    """
    raw = spark.read.option("header", True).option("sep", ";").option("multiLine", True).option("escape", '"').csv(path)
    rows = raw.toDF(*(c.strip().lstrip("\ufeff") for c in raw.columns))
    missing = {"IMO number", "Date of application", "Vessel name", "Subject to"} - set(rows.columns)
    if missing:
        raise ListError(f"{path} lacks {sorted(missing)}")
    r = rows.select(F.trim(F.regexp_replace(F.trim(F.coalesce("IMO number", F.lit(""))), "^IMO", "")).alias("imo"), F.try_to_timestamp(F.trim("Date of application"), F.lit("dd.MM.yyyy")).cast("date").alias("date"), F.trim(F.coalesce("Vessel name", F.lit(""))).alias("name"), F.trim("Subject to").alias("program"), F.monotonically_increasing_id().alias("n"))
    r = r.where(F.col("program").startswith(program))
    one = r.groupBy("imo").agg(F.min_by(F.struct("date", "name", "program"), F.struct(F.col("date").isNull().alias("undated"), "date", "n")).alias("r")).select("imo", "r.*")
    return one.select(F.lit("eu_vessels").alias("source"), F.concat(F.lit("dma-eu-"), F.coalesce(blank_to_null(F.col("imo")), F.lit("unknown"))).alias("source_id"), F.col("name").alias("vessel_name"), "imo", F.lit(None).cast("string").alias("flag"), "program", F.col("date").alias("designation_date"))


PAGE = "results struct<bindings: array<struct<item: struct<value: string>, imo: struct<value: string>, p729: struct<value: string>, p571: struct<value: string>>>>"


def read_registry_pages(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Pages of a registry query's JSON results, one document a file: (item, imo, service_entry, inception).

    A date that is no date, as an unknown value is, counts as none. A file that isn't such a page, or
    an entry without a number, is an error.
    """
    pages = spark.read.schema(PAGE).option("multiLine", True).json(paths)
    none_of(pages.where("results.bindings is null"), "a file has no results")
    rows = pages.select(F.explode("results.bindings").alias("b"))
    none_of(rows.where("b.imo.value is null"), "an entry has no number")
    date = lambda p: F.try_to_timestamp(F.regexp_replace(f"b.{p}.value", "(T.*)?$", ""), F.lit("yyyy-MM-dd")).cast("date")
    return rows.select(F.substring_index("b.item.value", "/", -1).alias("item"), F.col("b.imo.value").alias("imo"), date("p729").alias("service_entry"), date("p571").alias("inception"))


def reconcile_build_years(rows: DataFrame) -> DataFrame:
    """(imo, n_items, date_source, has_date_conflict, build_year, is_ambiguous): one row for each valid number.

    An item's year is that of its entry into service, else of its inception; the two conflict if over
    a year apart. Items of one number that are within a year of each other agree on the earliest;
    further apart they are ambiguous, and have none.
    """
    a, b = F.year("service_entry"), F.year("inception")
    r = rows.where(valid_imo(F.col("imo"))).select("imo", F.coalesce(a, b).alias("year"), F.coalesce(F.abs(a - b) > 1, F.lit(False)).alias("conflict"), a.isNotNull().alias("a"), b.isNotNull().alias("b"))
    g = r.groupBy("imo").agg(F.count("*").alias("n_items"), F.min("year").alias("low"), F.max("year").alias("high"), F.bool_or("conflict").alias("has_date_conflict"), F.bool_or("a").alias("a"), F.bool_or("b").alias("b"))
    return g.select("imo", "n_items", F.when(F.col("a"), "P729").when(F.col("b"), "P571").alias("date_source"), "has_date_conflict", F.when(F.col("high") - F.col("low") <= 1, F.col("low")).alias("build_year"), F.coalesce(F.col("high") - F.col("low") > 1, F.lit(False)).alias("is_ambiguous"))


def match_summary(identity: DataFrame, sanctions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One row of what a match by number finds, and the list's entries whose numbers can't be right.

    The row has the list's entries with a valid number, those and the distinct numbers that are seen, and
    the keys that send them.
    """
    fine = sanctions.where(valid_imo(F.col("imo")))
    ids = identity.where(valid_imo(F.col("imo"))).select("imo", "mmsi").distinct()
    seen = ids.select("imo").distinct().withColumn("seen", F.lit(True))
    met = fine.join(seen, "imo", "left")
    entries = met.agg(F.count("*").alias("n_valid"), F.count_if("seen").alias("n_matched"), F.count_distinct(F.when(F.col("seen"), F.col("imo"))).alias("n_numbers"), F.lit(0).alias("n_keys"))
    keys = ids.join(fine.select("imo").distinct(), "imo", "left_semi").agg(*(F.lit(0).alias(c) for c in entries.columns[:3]), F.count_distinct("mmsi").alias("n_keys"))
    row = entries.unionByName(keys).agg(*(F.max(c).alias(c) for c in entries.columns))
    return row, sanctions.where(F.col("imo").isNotNull() & ~F.coalesce(valid_imo(F.col("imo")), F.lit(False)))
