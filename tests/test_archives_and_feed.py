"""Zip archives as a source, a live feed that stops and resumes, and snapshots of its state."""

import datetime as dt
import io
import json
import socketserver
import threading
import time
import zipfile

import pytest

from tidemark.sources.archives import read_archives
from tidemark.streaming import feed, state

HEADER = "# Timestamp,Type of mobile,MMSI,Latitude,Longitude,Navigational status,SOG,COG,Ship type\n"
GOOD = ["05/06/2024 00:00:00,Class A,{},55.5,12.5,Moored,0.1,10.0,Cargo\n", "05/06/2024 00:00:10,Class A,{},55.6,,Moored,,10.0,\n"]
BAD = ["05/06/2024 00:00:20,Class A,{},55.5,12.5,Moored,0.1,10.0,Cargo,extra\n", "05/06/2024 00:00:30,Class A,{},north,12.5,Moored,0.1,10.0,Cargo\n", "not a time,Class A,{},55.5,12.5,Moored,0.1,10.0,Cargo\n"]


def day(mmsi):
    return HEADER + "".join(x.format(mmsi) for x in GOOD + BAD)


def zipped(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in members.items():
            z.writestr(name.replace("__", "."), text)
    return out.getvalue()


def test_a_mixed_folder(spark, tmp_path):
    days = tmp_path / "days" / "june"
    days.mkdir(parents=True)
    (days / "plain.csv").write_text(day(1))
    (days / "named_csv_but_zipped.csv").write_bytes(zipped(readme__txt="no", a__csv=day(2), b__csv=day(3)))
    (tmp_path / "days" / "large.zip").write_bytes(zipped(x__CSV=HEADER + (GOOD[0].format(4)) * 30_000))
    (days / "empty.csv").write_text("")
    (days / "_SUCCESS").write_text("")
    df = read_archives(spark, str(tmp_path / "days"))
    assert dict(df.dtypes)["timestamp"] == "timestamp_ntz" and dict(df.dtypes)["mmsi"] == "bigint"
    assert {r.mmsi: r["count"] for r in df.groupBy("mmsi").count().collect()} == {1: 2, 2: 2, 4: 30_000}
    one = df.where("mmsi = 1").orderBy("timestamp").collect()
    assert (one[0].timestamp, one[0].latitude, one[0].ship_type) == (dt.datetime(2024, 6, 5), 55.5, "Cargo") and (one[1].longitude, one[1].sog, one[1].ship_type) == (None, None, None)
    both = read_archives(spark, f"file://{tmp_path}/days", "mmsi long, member string, source_file string", members="all").where("mmsi in (2, 3)").distinct().collect()
    assert {(r.mmsi, r.member) for r in both} == {(2, "a.csv"), (3, "b.csv")} and all(r.source_file.endswith("named_csv_but_zipped.csv") for r in both)


def test_damage_is_an_error_and_never_a_part(spark, tmp_path):
    whole = zipped(a__csv=HEADER + GOOD[0].format(1) * 5000)
    flipped = bytearray(whole)
    flipped[len(whole) // 2] ^= 255
    for name, data in {"cut.zip": whole[: len(whole) // 2], "flipped.zip": bytes(flipped), "none.zip": zipped(a__txt="x")}.items():
        (tmp_path / name).write_bytes(data)
        with pytest.raises(Exception, match=name):
            read_archives(spark, str(tmp_path / name)).count()
    with pytest.raises(Exception, match="nowhere"):
        read_archives(spark, str(tmp_path / "nowhere")).count()


class Feed(socketserver.ThreadingTCPServer):
    """Keeps its messages, sends those after the number that a subscriber has, and hangs up now and then."""

    allow_reuse_address = daemon_threads = True

    def __init__(self, messages, each=10_000):
        super().__init__(("127.0.0.1", 0), Subscriber)
        self.messages, self.each, self.asked = messages, each, []
        threading.Thread(target=self.serve_forever, daemon=True).start()


class Subscriber(socketserver.StreamRequestHandler):
    def handle(self):
        asked = json.loads(self.rfile.readline())
        self.server.asked.append(asked)
        at = asked["after"]
        for m in self.server.messages[at : at + self.server.each]:
            self.wfile.write(m.encode() + b"\n")
        self.wfile.write(b"half a mess")
        self.wfile.flush()
        if len(self.server.messages) <= at + self.server.each:
            time.sleep(3)


def run_until(query, done, seconds=60):
    end = time.time() + seconds
    while time.time() < end and not done():
        time.sleep(0.2)
        assert query.exception() is None
    query.stop()


def test_a_feed_stops_and_resumes_without_loss_or_repeats(spark, tmp_path):
    server = Feed([f"message {i} é" for i in range(900)], each=130)
    out, cp, spool = (str(tmp_path / x) for x in ("out", "cp", "spool"))
    count = lambda: spark.read.schema("number long, value string").parquet(out).count() if (tmp_path / "out" / "_spark_metadata").exists() else 0
    for least in (200, 500, 900):
        stream = feed.read_feed(spark, "127.0.0.1", server.server_address[1], spool, {"regions": ["dk"]}, wait="0.2", maxMessages="100")
        query = stream.writeStream.format("parquet").option("checkpointLocation", cp).start(out)
        run_until(query, lambda: count() >= least)  # noqa: B023
    got = sorted((r.number, r.value) for r in spark.read.parquet(out).collect())
    assert got == [(i, f"message {i} é") for i in range(900)]
    assert all(a["regions"] == ["dk"] for a in server.asked) and len(server.asked) >= 7
    server.shutdown()


def test_what_was_spooled_is_read_again(tmp_path):
    server = Feed([str(i) for i in range(50)])
    options = {"host": "127.0.0.1", "port": server.server_address[1], "spool": str(tmp_path), "wait": "0.3", "maxmessages": "20"}
    first, end = feed.FeedReader(options).read({"at": 0})
    assert end == {"at": 20}
    again, same = feed.FeedReader(options).read({"at": 0})  # ended before the offset was known
    assert list(again) == list(first) and same == end
    reader = feed.FeedReader(options)
    assert list(reader.readBetweenOffsets({"at": 5}, {"at": 12})) == [(i, str(i)) for i in range(5, 12)]
    assert reader.read({"at": 20})[1] == {"at": 40}
    reader.commit({"at": 20})
    assert list(reader.readBetweenOffsets({"at": 20}, {"at": 40}))[0] == (20, "20")
    with pytest.raises(ValueError, match="no longer"):
        reader.readBetweenOffsets({"at": 10}, {"at": 30})
    server.shutdown()
    server.server_close()
    assert feed.FeedReader(options | {"port": 1}).read({"at": 40}) [1] == {"at": 40}  # nobody there: an empty batch


def test_a_snapshot_equals_the_fold_of_all_messages(spark, tmp_path):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    at = lambda minutes: f"2024-06-01T{minutes // 60:02d}:{minutes % 60:02d}:00Z"
    body = lambda kind, mmsi, t, **b: json.dumps({"MessageType": kind, "MetaData": {"MMSI": mmsi, "time_utc": at(t)}, "Message": {kind: b}})
    lines = [body("PositionReport", m, m + k, Latitude=55 + k / 10, Longitude=10.0 + m / 100, Sog=float(k)) for k in range(4) for m in range(1, 20)]
    lines += [body("ShipStaticData", m, m, Name=f"SHIP {m}", ImoNumber=9074729) for m in range(10, 30)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("\n".join(lines))
    stream = spark.readStream.schema("value string").text(str(tmp_path / "in"))
    query = state.publish(state.last_known_state(state.decode_messages(stream)), lambda df, n: df.collect(), f"{tmp_path}/cp", "0 seconds")
    query.processAllAvailable()
    query.stop()
    folded: dict = {}
    for r in state.decode_messages(spark.createDataFrame([(x,) for x in lines], "value string")).orderBy("event_time").collect():
        folded[r.mmsi] = state.fold(folded.get(r.mmsi), r.asDict())
    as_tuple = lambda r: tuple(r[f] for f in state._FIELDS)
    for positioned in (True, False):
        got = {as_tuple(r.asDict()) for r in feed.snapshot(spark, f"{tmp_path}/cp", positioned=positioned).collect()}
        assert got == {as_tuple(r) for r in folded.values() if r["position_time"] or not positioned}
    now = dt.datetime(2024, 6, 1, 0, 40, tzinfo=dt.timezone.utc)
    late = {r.mmsi for r in feed.snapshot(spark, f"{tmp_path}/cp", now, positioned=False).collect()}
    assert late == {m for m, r in folded.items() if (r["position_time"] or r["static_time"]) > dt.datetime(2024, 6, 1, 0, 10)}
