"""A live feed of messages as a streaming source that can be replayed, and snapshots of streaming state."""

from __future__ import annotations

import json
import re
import socket
import time
from collections.abc import Iterator

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from tidemark.streaming.state import STALE_SECONDS, decode_messages

SEGMENT = re.compile(r"(\d{18})-(\d{18})\.jsonl$")


class Spool:
    """Messages received, in files named by the numbers of their first and of the one after their last, until they are committed."""

    def __init__(self, root: str) -> None:
        self.store, self.path = pafs.FileSystem.from_uri(root) if "://" in root else (pafs.LocalFileSystem(), root)
        self.store.create_dir(self.path, recursive=True)

    def segments(self) -> list[tuple[int, int, str]]:
        files = self.store.get_file_info(pafs.FileSelector(self.path))
        return sorted((int(m[1]), int(m[2]), f.path) for f in files if (m := SEGMENT.search(f.base_name)))

    def put(self, start: int, lines: list[str]) -> None:
        """Under another name first, so that a segment that is there is whole."""
        name = f"{self.path}/{start:018d}-{start + len(lines):018d}.jsonl"
        with self.store.open_output_stream(f"{name}.tmp") as out:
            out.write("".join(f"{x}\n" for x in lines).encode())
        self.store.move(f"{name}.tmp", name)

    def get(self, start: int, end: int) -> list[str]:
        found: dict[int, str] = {}
        for a, b, path in self.segments():
            if a < end and b > start:
                with self.store.open_input_stream(path) as f:
                    found |= {a + i: x for i, x in enumerate(f.read().decode().split("\n")[: b - a])}
        missing = [n for n in range(start, end) if n not in found]
        if missing:
            raise ValueError(f"messages {missing[0]} to {missing[-1]} are no longer in {self.path}")
        return [found[n] for n in range(start, end)]

    def drop(self, end: int) -> None:
        for _, b, path in self.segments():
            if b <= end:
                self.store.delete_file(path)


class FeedReader(SimpleDataSourceStreamReader):
    """Messages from a socket, a line each, numbered in the order of their arrival.

    A message is spooled before its number is an offset, so a batch can be read again after a failure,
    from any machine that reaches the spool; what Spark has committed is dropped. On connecting, the
    reader sends the subscription with the number of messages it has, as `after`: a feed that keeps
    its messages goes on from there, a live one ignores it. A lost connection is made anew with the next batch.
    """

    def __init__(self, options: dict) -> None:
        self.options, self.spool, self.socket, self.rest = options, Spool(options["spool"]), None, b""

    def initialOffset(self) -> dict:  # noqa: N802
        return {"at": 0}

    def connect(self, at: int) -> None:
        self.socket, self.rest = socket.create_connection((self.options["host"], int(self.options["port"])), timeout=float(self.options.get("timeout", "5"))), b""
        self.socket.sendall(json.dumps(json.loads(self.options.get("subscription", "{}")) | {"after": at}).encode() + b"\n")

    def receive(self, at: int) -> list[str]:
        """What arrives within the wait, up to the largest batch; whole lines only."""
        most, until, lines = int(self.options.get("maxmessages", "10000")), time.monotonic() + float(self.options.get("wait", "0.5")), []
        try:
            if self.socket is None:
                self.connect(at)
            while True:
                parts = self.rest.split(b"\n")
                taken = parts[:-1][: most - len(lines)]
                lines += [x.decode("utf-8", "replace") for x in taken]
                self.rest = b"\n".join(parts[len(taken) :])
                left = until - time.monotonic()
                if len(lines) >= most or left <= 0:
                    break
                self.socket.settimeout(left)
                data = self.socket.recv(1 << 16)
                if not data:
                    raise ConnectionError("closed")
                self.rest += data
        except TimeoutError:
            pass
        except OSError:
            if self.socket is not None:
                self.socket.close()
            self.socket, self.rest = None, b""
        return lines

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        at = int(start["at"])
        ahead = [b for a, b, _ in self.spool.segments() if a <= at < b or a > at]
        if ahead:  # spooled, but never an offset: the process ended between the two
            lines = self.spool.get(at, max(ahead))
        else:
            lines = self.receive(at)
            if lines:
                self.spool.put(at, lines)
        return iter([(n, x) for n, x in enumerate(lines, at)]), {"at": at + len(lines)}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        return iter(list(enumerate(self.spool.get(int(start["at"]), int(end["at"])), int(start["at"]))))

    def commit(self, end: dict) -> None:
        self.spool.drop(int(end["at"]))


class MessageFeed(DataSource):
    """format("message_feed"): host, port, spool (a folder that outlives the driver), subscription (JSON), wait and timeout (seconds), maxMessages."""

    @classmethod
    def name(cls) -> str:
        return "message_feed"

    def schema(self) -> str:
        return "number long, value string"

    def simpleStreamReader(self, schema: T.StructType) -> FeedReader:  # noqa: N802
        return FeedReader({k.lower(): v for k, v in dict(self.options).items()})


def read_feed(spark: SparkSession, host: str, port: int, spool: str, subscription: dict | None = None, **options: str) -> DataFrame:
    """A stream of (number, value): a feed's messages, each once, in order."""
    spark.dataSource.register(MessageFeed)
    reader = spark.readStream.format("message_feed").option("host", host).option("port", str(port)).option("spool", spool)
    return reader.option("subscription", json.dumps(subscription or {})).options(**options).load()


def feed_updates(spark: SparkSession, host: str, port: int, spool: str, regions: list[str] | None = None) -> DataFrame:
    """The decoded updates of a position feed, for `last_known_state`."""
    return decode_messages(read_feed(spark, host, port, spool, {"regions": regions} if regions else None).select("value"))


def snapshot(spark: SparkSession, checkpoint: str, now=None, stale_seconds: int = STALE_SECONDS, positioned: bool = True) -> DataFrame:
    """The records that `last_known_state` holds as of its last finished batch, read from its checkpoint.

    With `now`, vessels silent since stale_seconds before it are left out, though no batch has removed
    them yet; `positioned` leaves out those without a position.
    """
    state = spark.read.format("statestore").load(checkpoint).select("value.groupState.*")
    seen = F.coalesce("position_time", "static_time")
    out = state.where(F.col("mmsi").isNotNull())
    if positioned:
        out = out.where(F.col("position_time").isNotNull())
    if now is not None:
        out = out.where(seen > F.lit(now) - F.expr(f"INTERVAL {stale_seconds} SECONDS"))
    return out
