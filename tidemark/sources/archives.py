"""Delimited files, zipped or not, as a Spark data source: a partition for each file, inflated as a stream."""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidemark.sources.readers import POSITION_SCHEMA, POSITION_TIME, header_name

#: Fixed value: the bytes that a zip archive begins with.
ZIP_MAGIC = b"PK\x03\x04"
ROWS = 8192
#: Columns that tell where a row is from, filled if the schema has them.
SOURCE_FILE, MEMBER = "source_file", "member"


class OneFile(InputPartition):
    def __init__(self, path: str) -> None:
        super().__init__(path)
        self.path = path


class ArchivedCsvReader(DataSourceReader):
    """Text columns by the names of a file's header; lines with another number of fields than the header go.

    What a file is, its first bytes tell, and not its name. An archive gives its first member named
    .csv, or all of them if asked; one without any is an error, as is a damaged or truncated one: a
    part of a file is never taken for the whole.
    """

    def __init__(self, options: dict, schema: T.StructType) -> None:
        self.options, self.names = options, schema.names

    def partitions(self) -> list[OneFile]:
        found = []
        for root in self.options["path"].split(","):
            store, path = pafs.FileSystem.from_uri(root) if "://" in root else (pafs.LocalFileSystem(), root)
            info = store.get_file_info(path)
            if info.type == pafs.FileType.NotFound:
                raise FileNotFoundError(root)
            files = [info] if info.type == pafs.FileType.File else store.get_file_info(pafs.FileSelector(path, recursive=True))
            prefix = root.split("://")[0] + "://" if "://" in root else ""
            found += [prefix + f.path for f in files if f.type == pafs.FileType.File and not f.base_name.startswith((".", "_"))]
        return [OneFile(p) for p in sorted(found)]

    def read(self, partition: OneFile) -> Iterator[pa.RecordBatch]:
        store, path = pafs.FileSystem.from_uri(partition.path) if "://" in partition.path else (pafs.LocalFileSystem(), partition.path)
        with store.open_input_file(path) as source:
            magic = source.read(4)
            source.seek(0)
            if magic != ZIP_MAGIC:
                yield from self.rows(source, partition.path, None)
                return
            try:
                with zipfile.ZipFile(source) as archive:
                    members = [m for m in archive.namelist() if m.lower().endswith(".csv")]
                    if not members:
                        raise ValueError(f"{partition.path} has no CSV member")
                    for member in members if self.options.get("members", "first") == "all" else members[:1]:
                        with archive.open(member) as inflated:
                            yield from self.rows(inflated, partition.path, member)
            except (zipfile.BadZipFile, EOFError) as e:
                raise ValueError(f"{partition.path} is damaged or truncated: {e}") from e

    def rows(self, raw, path: str, member: str | None) -> Iterator[pa.RecordBatch]:
        lines = csv.reader(io.TextIOWrapper(raw, "utf-8-sig", errors="replace", newline=""), delimiter=self.options.get("sep", ","))
        header = [header_name(c) for c in next(lines, [])]
        at = {c: i for i, c in reversed(list(enumerate(header)))}
        told = {SOURCE_FILE: path, MEMBER: member}
        held: list[list[str]] = []

        def batch() -> pa.RecordBatch:
            columns = list(zip(*held))
            fill = lambda c: [told[c]] * len(held) if c in told else [x or None for x in columns[at[c]]] if c in at else [None] * len(held)
            return pa.RecordBatch.from_arrays([pa.array(fill(c), pa.string()) for c in self.names], self.names)

        for line in lines:
            if len(line) == len(header):
                held.append(line)
            if len(held) >= ROWS:
                yield batch()
                held = []
        if held:
            yield batch()


class ArchivedCsv(DataSource):
    """format("archived_csv"): path (one, or several joined by commas), sep, members (first or all); the schema's columns are strings."""

    @classmethod
    def name(cls) -> str:
        return "archived_csv"

    def reader(self, schema: T.StructType) -> ArchivedCsvReader:
        return ArchivedCsvReader(dict(self.options), schema)


def read_archives(spark: SparkSession, path: str, schema: str = POSITION_SCHEMA, time_format: str = POSITION_TIME, members: str = "first", sep: str = ",") -> DataFrame:
    """The rows of delimited files and zip archives under a path that fit the schema; empty fields are null, files may be mixed."""
    spark.dataSource.register(ArchivedCsv)
    kinds = T.StructType.fromDDL(schema)
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in kinds])
    raw = spark.read.format("archived_csv").schema(text).option("members", members).option("sep", sep).load(path)

    def value(f: T.StructField):
        c = F.trim(F.col(f.name))
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            return F.try_to_timestamp(c, F.lit(time_format)).cast(f.dataType)
        return F.col(f.name) if isinstance(f.dataType, T.StringType) else c.try_cast(f.dataType)

    fits = F.lit(True)
    for f in kinds:
        fits = fits & (F.col(f.name).isNull() | value(f).isNotNull())
    return raw.where(fits).select(*(value(f).alias(f.name) for f in kinds))
