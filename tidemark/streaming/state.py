"""Structured Streaming: the last-known state per vessel, with expiry, and a sliding message rate."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import valid_imo

#: What the protocol sends for "not available", how long a silent vessel is kept, and the regions served.
SOG_NA, COG_NA, HEADING_NA = 102.3, 360.0, 511
STALE_SECONDS = 30 * 60
REGIONS = {"dk": (53.3, 2.0, 59.3, 19.0), "gib": (35.6, -6.4, 36.4, -4.8)}

MESSAGE_SCHEMA = """MessageType string, MetaData struct<MMSI: long, latitude: double, longitude: double, time_utc: timestamp>,
Message struct<
 PositionReport: struct<Latitude: double, Longitude: double, Sog: double, Cog: double, TrueHeading: int, NavigationalStatus: int>,
 StandardClassBPositionReport: struct<Latitude: double, Longitude: double, Sog: double, Cog: double, TrueHeading: int>,
 ExtendedClassBPositionReport: struct<Latitude: double, Longitude: double, Sog: double, Cog: double, TrueHeading: int, Name: string, Type: int>,
 ShipStaticData: struct<Name: string, CallSign: string, ImoNumber: long, Type: int, Destination: string, MaximumStaticDraught: double>,
 StaticDataReport: struct<ReportA: struct<Name: string>, ReportB: struct<CallSign: string, ShipType: int>>>"""
RECORD = "mmsi long, latitude double, longitude double, sog double, cog double, heading int, name string, callsign string, imo long, ship_type int, destination string, draught double, position_time timestamp, static_time timestamp"
_FIELDS = [f.split()[0] for f in RECORD.split(", ")]
_POSITION, _STATIC = _FIELDS[1:6], _FIELDS[6:12]
_WHOLE = [f.split()[0] for f in RECORD.split(", ") if f.split()[1] in ("int", "long")]


def decode_messages(raw: DataFrame, column: str = "value") -> DataFrame:
    """JSON messages of five types as flat updates; values that mean "not available", and numbers with a wrong check digit, become null.

    Positions that are impossible or outside the regions served are no updates, and neither are messages of other types.
    """
    m = raw.select(F.from_json(column, MESSAGE_SCHEMA).alias("m")).select("m.*").where("MetaData.MMSI is not null")
    body = lambda *paths: F.coalesce(*(F.col(f"Message.{p}") for p in paths))
    positions = ("PositionReport", "StandardClassBPositionReport", "ExtendedClassBPositionReport")
    of = lambda field: body(*(f"{p}.{field}" for p in positions))
    real = lambda c, bad: F.when(c < bad, c)
    text = lambda c: F.nullif(F.trim(F.trim(c, F.lit("@"))), F.lit(""))
    at = F.col("MetaData.time_utc")
    lat, lon = of("Latitude"), of("Longitude")
    fine = F.coalesce(lat.between(-90, 90) & lon.between(-180, 180) & in_regions(lat, lon).isNotNull(), F.lit(False))
    static = F.col("MessageType").isin("ShipStaticData", "StaticDataReport", "ExtendedClassBPositionReport")
    imo = body("ShipStaticData.ImoNumber")
    return m.where(F.when(F.col("MessageType").isin(*positions), fine | (static & lat.isNull())).otherwise(static)).select(
        F.col("MetaData.MMSI").alias("mmsi"), F.when(fine, lat).alias("latitude"), F.when(fine, lon).alias("longitude"), real(of("Sog"), SOG_NA).alias("sog"), real(of("Cog"), COG_NA).alias("cog"), real(of("TrueHeading"), HEADING_NA).alias("heading"),
        text(body("ShipStaticData.Name", "StaticDataReport.ReportA.Name", "ExtendedClassBPositionReport.Name")).alias("name"), text(body("ShipStaticData.CallSign", "StaticDataReport.ReportB.CallSign")).alias("callsign"),
        F.when(valid_imo(F.lpad(imo.cast("string"), 7, "0")), imo).alias("imo"), F.nullif(body("ShipStaticData.Type", "StaticDataReport.ReportB.ShipType", "ExtendedClassBPositionReport.Type"), F.lit(0)).alias("ship_type"),
        text(body("ShipStaticData.Destination")).alias("destination"), F.nullif(body("ShipStaticData.MaximumStaticDraught"), F.lit(0.0)).alias("draught"),
        F.when(fine, at).alias("position_time"), F.when(static, at).alias("static_time"),
        F.coalesce(at, F.current_timestamp()).alias("event_time"),
    )


def in_regions(lat: Column, lon: Column) -> Column:
    """Name of the first region that holds a position, or null."""
    found = F.lit(None).cast("string")
    for name, (south, west, north, east) in reversed(REGIONS.items()):
        found = F.when(lat.between(south, north) & lon.between(west, east), name).otherwise(found)
    return found


def fold(record: dict | None, update: dict) -> dict:
    """One update onto a record: a position replaces all position fields, static fields only what is not empty.

    What is older than what the record has of its kind changes nothing: batches may come out of order.
    """
    out = dict(record or dict.fromkeys(_FIELDS))
    out["mmsi"] = update["mmsi"]
    newer = lambda t: update[t] is not None and (out[t] is None or update[t] >= out[t])
    if newer("position_time"):
        out |= {f: update[f] for f in (*_POSITION, "position_time")}
    if newer("static_time"):
        out |= {f: update[f] for f in _STATIC if update[f] is not None}
        out["static_time"] = update["static_time"]
    return out


def last_known_state(updates: DataFrame, stale_seconds: int = STALE_SECONDS, watermark: str = "0 seconds") -> DataFrame:
    """A stream of (record, is_removed): each vessel's state after every batch that touched it, and its removal once silent.

    State is one record per vessel, kept for stale_seconds of event time after its last position,
    or its last static message if it has no position.
    """
    fields = [f for f in RECORD.split(", ")]

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            old = dict(zip(_FIELDS, state.get))
            state.remove()
            yield pd.DataFrame([old | {"is_removed": True}])
            return
        record = dict(zip(_FIELDS, state.get)) if state.exists else None
        rows = pd.concat(list(batches)).sort_values("event_time", kind="stable")
        for row in rows.astype(object).where(rows.notna(), None).to_dict("records"):
            # pandas has numbers with gaps as floats, which the state would keep as nulls
            record = fold(record, row | {f: int(row[f]) for f in _WHOLE if row[f] is not None})
        state.update(tuple(record[f] for f in _FIELDS))
        seen = record["position_time"] or record["static_time"] or rows["event_time"].max()
        due = int(pd.Timestamp(seen).timestamp() * 1000) + stale_seconds * 1000
        state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([record | {"is_removed": False}])

    schema = ", ".join(fields)
    return updates.withWatermark("event_time", watermark).groupBy("mmsi").applyInPandasWithState(step, f"{schema}, is_removed boolean", schema, "update", "EventTimeTimeout")


def latest_per_key(df: DataFrame, key: str, ts: str, columns: list[str]) -> DataFrame:
    """The same fold in built-in functions, for streams of complete records: latest values per key."""
    return df.groupBy(key).agg(F.max(ts).alias(ts), *(F.max_by(c, ts).alias(c) for c in columns))


def message_rate(df: DataFrame, ts: str, watermark: str = "1 minute", window: str = "10 seconds", slide: str = "1 second") -> DataFrame:
    """Messages per sliding window, with late data up to the watermark."""
    return df.withWatermark(ts, watermark).groupBy(F.window(ts, window, slide)).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n")


def publish(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, every: str = "1 second"):
    """Hands every micro-batch of updates to a sink; the checkpoint makes a restart carry on."""
    return stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(processingTime=every).foreachBatch(sink).start()
