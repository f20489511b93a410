import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from tidemark.sources import readers, sinks
from tidemark.streaming import state


def test_positions_csv_drops_malformed_rows(spark, tmp_path):
    path = tmp_path / "raw.csv"
    path.write_text("# Timestamp,Type of mobile,MMSI,Latitude,Longitude,Navigational status,SOG,COG,Ship type\n01/06/2024 00:00:00,Class A,219000001,55.0,12.0,Moored,0.1,10.0,Tanker\n02/06/2024 10:00:00,Class A,x,55.0,12.0,Moored,0.1,10.0,Tanker\n03/06/2024 00:00:00,Class A,219000001,55.0,12.0,Moored,0.1,10.0,Tanker,extra\n")
    out = readers.read_positions_csv(spark, str(path)).collect()
    assert [(r.mmsi, r.timestamp) for r in out] == [(219000001, dt.datetime(2024, 6, 1))]
    assert [readers.header_name(x) for x in ("# Timestamp", "Type of mobile", " SOG ", "A-B c")] == ["timestamp", "type_of_mobile", "sog", "a_b_c"]


def test_days_gates_and_matches(spark, tmp_path):
    spark.createDataFrame([(1, dt.date(2024, 6, 1)), (2, dt.date(2024, 6, 3))], "v long, date date").write.partitionBy("date").parquet(f"{tmp_path}/t")
    df, missing = readers.read_days(spark, f"{tmp_path}/t", "2024-06-01", "2024-06-03")
    assert df.count() == 2 and missing == ["2024-06-02"]
    s = spark.createDataFrame([("9074729", dt.date(2024, 1, 1)), ("9074729", None), ("1234560", dt.date(2024, 1, 1)), ("9074729", dt.date(2030, 1, 1))], "imo string, designation_date date")
    kept, dropped = readers.apply_gates(s, readers.designation_gates("2026-01-01"))
    assert kept.count() == 1 and {r.gate: r.n for r in dropped.collect()} == {"no_date": 1, "invalid_imo": 1, "after_cap": 1}
    ids = spark.createDataFrame([(1, "9074729", 3, dt.date(2024, 1, 1), dt.date(2024, 1, 2), False), (1, "9074729", 4, dt.date(2024, 2, 1), dt.date(2024, 2, 2), True)], "mmsi long, imo string, message_count long, first_seen date, last_seen date, is_reused boolean")
    (m,) = readers.match_sanctions(ids, kept).collect()
    assert (m.mmsi, m.message_count, m.is_reused) == (1, 7, True)


def test_lists(spark, tmp_path):
    eu = tmp_path / "eu.csv"
    eu.write_text('id,schema,name,countries,identifiers,sanctions,program_ids\na,Vessel,One,pa,"IMO9074729;IMO1111111","EU 2024-05-01 and 2023-02-02",P\nb,Person,Two,,,,\nc,Vessel,Three,,,,\n')
    assert sorted((r.source_id, r.imo, r.designation_date) for r in readers.read_eu_list(spark, str(eu)).collect() if r.imo) == [("a", "1111111", dt.date(2023, 2, 2)), ("a", "9074729", dt.date(2023, 2, 2))]
    uk = tmp_path / "uk.csv"
    uk.write_text("Report Date: 1\nUnique ID,Designation Type,Name 6,Name type,Date Designated,IMO number,Current believed flag of ship\nX1,Ship,ALIAS,Alias,02/03/2024,9074729,Panama\nX1,Ship,MAIN,Primary name,01/03/2024,9074729,Panama\nX2,Individual,P,Primary name,,,\n")
    (r,) = readers.read_uk_list(spark, str(uk)).collect()
    assert (r.vessel_name, r.imo, r.designation_date) == ("MAIN", "9074729", dt.date(2024, 3, 1))
    xml = tmp_path / "l.xml"
    xml.write_text("<list><record><Name>A</Name><Imo>1</Imo></record><record><Name>B</Name></record></list>")
    assert readers.read_xml_records(spark, str(xml), "record", "Name string, Imo string").count() == 2


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, dt.date(2024, 6, 1)), (1, dt.date(2024, 6, 1))], "v long, date date")
    sinks.write_sorted(df, f"{tmp_path}/p", ["v"], ["date"])
    sinks.write_sorted(df.withColumn("date", F.date_add("date", 1)), f"{tmp_path}/p", ["v"], ["date"])
    assert spark.read.parquet(f"{tmp_path}/p").count() == 4
    calls = []
    for force in (False, False, True):
        sinks.build_once(spark, f"{tmp_path}/once", lambda: (calls.append(1), df)[1], force)
    assert len(calls) == 2
    assert sinks.verify(df, 3, ["date"], ["v"]) == {"missing_rows": 1, "null_v": 0, "repeated_keys": 1}
    assert sinks.export_json(df, f"{tmp_path}/x.json") == 2 and len(json.load(open(f"{tmp_path}/x.json"))) == 2
    with pytest.raises(ValueError):
        sinks.export_json(df, f"{tmp_path}/y.json", most=1)
    t = spark.createDataFrame([(1, dt.datetime(2024, 6, 1), 55.0, 12.0), (1, dt.datetime(2024, 6, 1, 1), 60.0, 14.0)], "k long, t timestamp_ntz, lat double, lon double")
    (r,) = sinks.pack_tracks(t, "k", "t", "lat", "lon", (50.0, 10.0, 60.0, 14.0)).collect()
    assert [int.from_bytes(r.planes[i : i + 2], "little") for i in range(0, 12, 2)] == [32768, 65535, 32768, 65535, 0, 60]
    long = spark.createDataFrame([(1, dt.datetime(2024, 1, 1) + dt.timedelta(hours=8 * i), 55.0, 12.0) for i in range(300)] + [(None, dt.datetime(2024, 1, 1), 55.0, 12.0)], "k long, t timestamp_ntz, lat double, lon double")
    parts = sorted(sinks.pack_tracks(long, "k", "t", "lat", "lon", (50.0, 10.0, 60.0, 14.0), 100).collect(), key=lambda r: r.start)
    assert sum(r.n for r in parts) == 301 and max(r.n for r in parts) <= 100 and all(len(r.planes) == 6 * r.n for r in parts)
    assert [r.n for r in parts if r.k is None] == [1]
    minutes = [int.from_bytes(r.planes[-2:], "little") for r in parts]
    assert all(m == (r.n - 1) * 480 < 65535 for m, r in zip(minutes, parts)) and len(parts) > 3


def message(kind, mmsi, at, **body):
    return json.dumps({"MessageType": kind, "MetaData": {"MMSI": mmsi, "time_utc": at}, "Message": {kind: body}})


def test_fold_keeps_static_fields_and_replaces_positions(spark, tmp_path):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    src, out = tmp_path / "in", []
    src.mkdir()
    batches = [
        [message("PositionReport", 1, "2024-06-01T00:00:00Z", Latitude=55.0, Longitude=12.0, Sog=102.3, Cog=360.0, TrueHeading=511), message("ShipStaticData", 1, "2024-06-01T00:00:01Z", Name="TUG@@", CallSign="", ImoNumber=0, Destination="KIEL")],
        [message("ShipStaticData", 1, "2024-06-01T00:01:00Z", Name="", CallSign="OX1", ImoNumber=9074729), message("PositionReport", 1, "2024-06-01T00:02:00Z", Latitude=55.5, Longitude=12.0, Sog=3.0, Cog=10.0, TrueHeading=9)],
        [message("PositionReport", 2, "2024-06-01T02:00:00Z", Latitude=56.0, Longitude=12.0, Sog=3.0, Cog=10.0, TrueHeading=9)],
        [message("PositionReport", 2, "2024-06-01T02:01:00Z", Latitude=56.0, Longitude=12.0, Sog=3.0, Cog=10.0, TrueHeading=9)],
    ]
    for i, lines in enumerate(batches):
        (src / f"{i}.txt").write_text("\n".join(lines))
        os.utime(src / f"{i}.txt", (1_700_000_000 + i, 1_700_000_000 + i))  # the source goes by file times
    stream = spark.readStream.schema("value string").option("maxFilesPerTrigger", 1).text(str(src))
    q = state.publish(state.last_known_state(state.decode_messages(stream)), lambda df, n: out.extend(df.collect()), f"{tmp_path}/cp", "0 seconds")
    q.processAllAvailable()
    q.stop()
    one = [r for r in out if r.mmsi == 1]
    assert (one[0].name, one[0].sog, one[0].imo, one[0].destination) == ("TUG", None, None, "KIEL")
    assert (one[1].name, one[1].callsign, one[1].imo, one[1].latitude, one[1].sog) == ("TUG", "OX1", 9074729, 55.5, 3.0)
    assert one[-1].is_removed and not [r for r in out if r.mmsi == 2][-1].is_removed


def test_decoded_messages_and_late_updates(spark):
    lines = [
        message("PositionReport", 1, "2024-06-01T00:00:00Z", Latitude=10.0, Longitude=10.0, Sog=1.0),
        message("PositionReport", 2, "2024-06-01T00:00:00Z", Latitude=91.0, Longitude=181.0, Sog=1.0),
        message("PositionReport", 3, "2024-06-01T00:00:00Z", Latitude=55.0, Longitude=10.0, Sog=1.0),
        message("Unknown", 4, "2024-06-01T00:00:00Z"),
        message("ShipStaticData", 5, "2024-06-01T00:00:00Z", Name="A", ImoNumber=9074728),
        message("ShipStaticData", 6, "2024-06-01T00:00:00Z", Name="B", ImoNumber=9074729),
        message("StaticDataReport", 7, "2024-06-01T00:00:00Z", ReportA={"Name": "SEA@@"}),
        "not json",
    ]
    out = state.decode_messages(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert {r.mmsi: (r.imo, r.name) for r in out} == {3: (None, None), 5: (None, "A"), 6: (9074729, "B"), 7: (None, "SEA")}
    blank = dict.fromkeys(state._FIELDS)
    new = state.fold(None, blank | {"mmsi": 1, "position_time": 5, "latitude": 2.0})
    assert state.fold(new, blank | {"mmsi": 1, "position_time": 4, "latitude": 9.0})["latitude"] == 2.0


def test_message_rate_and_regions(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 0, 0, s),) for s in (0, 1, 9)], "t timestamp")
    assert max(r.n for r in state.message_rate(df, "t").collect()) == 3
    p = spark.createDataFrame([(55.0, 10.0), (36.0, -5.0), (0.0, 0.0)], "lat double, lon double")
    assert [r[0] for r in p.select(state.in_regions(F.col("lat"), F.col("lon"))).collect()] == ["dk", "gib", None]
