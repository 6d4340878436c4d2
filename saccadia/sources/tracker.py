"""Tracker text files as a Spark data source: `spark.read.format("tracker").load(folder)`.

A file is a recording and a partition of its own, read in one pass and a bounded batch at a
time. Only the columns that the schema names are parsed. Options choose recordings, before any
file is opened, and times, before a row's values are parsed. They are options and not filters
that Spark pushes down, because Spark 4.1 keeps a pushed filter with the loaded DataFrame: a
later query on it without the filter would miss rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from saccadia.sources.recordings import SIGNALS

SCHEMA = "recording_id string, i long, t_ms double, " + ", ".join(f"{s} double" for s in SIGNALS)
BATCH = 50_000


def _number(text: bytes):
    """A value of a field; blank, '.' and what is no number are missing."""
    try:
        return float(text)
    except ValueError:
        return None


class _File(InputPartition):
    def __init__(self, path: str, name: str):
        self.path, self.name = path, name


class TrackerReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.suffix = options["path"], options.get("suffix", ".tsv")
        self.columns = schema.fieldNames()
        if unknown := set(self.columns) - {x.split(" ")[0] for x in SCHEMA.split(", ")}:
            raise ValueError(f"unknown columns: {sorted(unknown)}")
        self.names = set(json.loads(options["recordings"])) if "recordings" in options else None
        self.start, self.end = float(options.get("start", "-inf")), float(options.get("end", "inf"))

    def partitions(self) -> list[InputPartition]:
        store, top = fs.FileSystem.from_uri(self.path)
        found = store.get_file_info(fs.FileSelector(top, recursive=True)) if store.get_file_info(top).type == fs.FileType.Directory else [store.get_file_info(top)]
        files = sorted((f.path, f.base_name.removesuffix(self.suffix)) for f in found if f.type == fs.FileType.File and f.base_name.endswith(self.suffix))
        return [_File(p, n) for p, n in files if self.names is None or n in self.names] or [_File("", "")]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        store, _ = fs.FileSystem.from_uri(self.path)
        fields = [(c, 1 + SIGNALS.index(c)) for c in self.columns if c in SIGNALS]
        rows: dict[str, list] = {c: [] for c in self.columns}
        i = n = 0
        with store.open_input_stream(partition.path) as stream:
            rest = b""
            while True:
                got = stream.read(1 << 20)
                *lines, rest = (rest + got).split(b"\n")
                if not got and rest:
                    lines, rest = [*lines, rest], b""
                for line in lines:
                    parts = line.split(b"\t")
                    t = _number(parts[0])
                    if t is None:
                        continue
                    if self.start <= t < self.end:
                        for c, k in fields:
                            rows[c].append(_number(parts[k]) if k < len(parts) else None)
                        for c, v in (("recording_id", partition.name), ("i", i), ("t_ms", t)):
                            if c in rows:
                                rows[c].append(v)
                        n += 1
                    i += 1
                    if n == BATCH:
                        yield self._batch(rows, n)
                        n = 0
                if not got:
                    break
        if n:
            yield self._batch(rows, n)

    def _batch(self, rows: dict[str, list], n: int) -> pa.RecordBatch:
        kinds = {"recording_id": pa.string(), "i": pa.int64()}
        out = pa.RecordBatch.from_arrays([pa.array(rows[c], kinds.get(c, pa.float64())) for c in self.columns], self.columns)
        for v in rows.values():
            v.clear()
        return out


class TrackerSource(DataSource):
    """Tab-separated time and six signals by line. recording_id is the file's name without `suffix`, i its line among those with a time."""

    @classmethod
    def name(cls) -> str:
        return "tracker"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return TrackerReader(self.options, schema)


def read_tracker(spark: SparkSession, path: str, recordings: list[str] | None = None, start: float | None = None, end: float | None = None, columns: list[str] | None = None, suffix: str = ".tsv") -> DataFrame:
    """The tracker files of a folder (or one file): named recordings alone, times in [start, end) ms, some columns.

    i counts all of a file's lines with a time, whatever is chosen.
    """
    spark.dataSource.register(TrackerSource)
    read = spark.read.format("tracker").option("suffix", suffix)
    if recordings is not None:
        read = read.option("recordings", json.dumps(list(recordings)))
    for name, bound in (("start", start), ("end", end)):
        read = read if bound is None else read.option(name, str(float(bound)))
    if columns is not None:
        kinds = dict(x.split(" ") for x in SCHEMA.split(", "))
        read = read.schema(", ".join(f"{c} {kinds.get(c, 'double')}" for c in columns))
    return read.load(path)
