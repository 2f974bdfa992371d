"""Reading and writing record files: recordio, wal and sstable.

``read_files`` reads through Spark's own file reader, so it reaches every store
that Spark reaches; files are decoded in parallel, each in one task. ``register``
adds the formats ``recordio``, ``wal`` and ``sstable`` to spark.read and df.write
for folders that all executors mount; logs are then read a segment a task, and
writes appear all at once when the job commits. Files are read and written in
steps. Options ``key``, or ``low`` and ``high``, read a table by its index.

Faulty files: mode FAILFAST (default) raises, PERMISSIVE keeps what can be read
before the fault.
"""

from __future__ import annotations

import bisect
import glob
import heapq
import itertools
import os
import shutil
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from . import codec
from ..model import with_watermark

KINDS = ("recordio", "wal", "sstable")
SCHEMA = "id string, partition_key string, watermark_ns bigint, tz string, data binary"
_NAMES = ["id", "partition_key", "watermark_ns", "tz", "data"]


def _permissive(mode: str) -> bool:
    if mode.upper() not in ("FAILFAST", "PERMISSIVE"):
        raise ValueError("mode is FAILFAST or PERMISSIVE")
    return mode.upper() == "PERMISSIVE"


def read_files(spark: SparkSession, path: str, kind: str, mode: str = "FAILFAST") -> DataFrame:
    """The records of all files of a path or folder, with the derived timestamp."""
    if kind not in KINDS:
        raise ValueError("kind is recordio, wal or sstable")
    permissive = _permissive(mode)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                held = []
                for r in codec.records_of(content.as_py(), kind, permissive):
                    held.append(r)
                    if len(held) == 4096:
                        yield _batch(held)
                        held = []
                yield _batch(held)

    files = spark.read.format("binaryFile").load(path).select("content")
    return with_watermark(files.mapInArrow(run, SCHEMA))


def _batch(records: list[codec.Record]) -> pa.RecordBatch:
    types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*records) if records else [()] * 5, types)], _NAMES)


def _local(path: str) -> str:
    """The path of a folder that every executor mounts; other stores are refused."""
    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme:
        return path
    if scheme != "file":
        raise ValueError(f"this format loads and saves mounted folders only, not {scheme}:; read_files reads any store")
    return "/" + rest.lstrip("/")


class _Segment(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


def _paths(options: dict) -> list[str]:
    path = _local(options["path"])
    if os.path.isdir(path):
        return sorted(p for p in glob.glob(f"{glob.escape(path)}/*") if os.path.isfile(p) and not os.path.basename(p).startswith(("_", ".")))
    found = sorted(glob.glob(path))
    if not found:
        raise FileNotFoundError(path)
    return found


class _Reader(DataSourceReader):
    def __init__(self, kind: str, options: dict):
        self.kind, self.options = kind, options
        self.permissive = _permissive(options.get("mode", "FAILFAST"))

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for path in _paths(self.options):
            if self.kind != "wal":
                out.append(_Segment(path, 0, -1))
                continue
            # Hop over the segments' sizes; their records are read by the tasks.
            with open(path, "rb") as f:
                total, at = os.fstat(f.fileno()).st_size, 0
                while at < total:
                    f.seek(at)
                    raw = f.read(8)
                    size = int.from_bytes(raw, "little", signed=True) if len(raw) == 8 else -1
                    if size < 8 or at + size > total:
                        if self.permissive:
                            break
                        raise codec.CodecError(f"segment goes beyond the end of {path}")
                    out.append(_Segment(path, at + 8, at + size))
                    at += size
        return out or [_Segment("", 0, 0)]

    def read(self, partition: _Segment) -> Iterator[tuple]:
        if not partition.path:
            return
        with open(partition.path, "rb") as f:
            end = os.fstat(f.fileno()).st_size if partition.end < 0 else partition.end
            f.seek(partition.start)
            for r in codec.scan_file(f, end - partition.start, self.permissive):
                yield tuple(r)


class _TableReader(_Reader):
    """Reads a table's records of one id (option ``key``) or of the ids from ``low``
    up to ``high``, both included, which the index finds.

    Options, not filters: Spark 4.1 goes on using a reader that filters were pushed
    to for later queries of the same frame that have none.
    """

    def __init__(self, kind: str, options: dict):
        super().__init__(kind, options)
        key = options.get("key")
        low, high = (key, key) if key is not None else (options.get("low", ""), options.get("high"))
        self.low, self.high = low.encode(), None if high is None else high.encode()

    def read(self, partition: _Segment) -> Iterator[tuple]:
        if not partition.path:
            return
        with open(partition.path, "rb") as f:
            try:
                index, end = codec.open_table(f)
            except codec.CodecError:
                if self.permissive:
                    return
                raise
            at = bisect.bisect_left(index, self.low, key=lambda e: e[0].encode())
            to = len(index) if self.high is None else bisect.bisect_right(index, self.high, key=lambda e: e[0].encode())
            if at >= to:
                return
            if to < len(index):
                end = index[to][1]
            f.seek(index[at][1])
            for r in codec.scan_file(f, end - index[at][1], self.permissive):
                yield tuple(r)


class _Written(WriterCommitMessage):
    def __init__(self, name: str | None):
        self.name = name


class _Writer(DataSourceWriter):
    def __init__(self, kind: str, options: dict, overwrite: bool):
        self.kind, self.overwrite = kind, overwrite
        self.path = _local(options["path"])
        self.most = int(options.get("segmentrecords", options.get("segmentRecords", 1000)))
        if self.most <= 0:
            raise ValueError("max records must be greater than 0")
        self.stage = f"{self.path}/_staging-{uuid.uuid4().hex}"

    def write(self, rows: Iterator) -> _Written:
        records = (codec.Record(r["id"], r["partition_key"], r["watermark_ns"], r["tz"], bytes(r["data"])) for r in rows)
        name = f"part-{uuid.uuid4().hex}.{self.kind}"
        first = next(records, None)
        if first is None:
            return _Written(None)
        os.makedirs(self.stage, exist_ok=True)
        with open(f"{self.stage}/{name}", "wb") as f:
            if self.kind == "recordio":
                f.write(codec.encode(first))
                for r in records:
                    f.write(codec.encode(r))
            elif self.kind == "sstable":
                codec.write_table(f, itertools.chain([first], records))
            else:
                held = {(first.partition_key, first.id, first.watermark_ns): first}
                for r in records:
                    held[(r.partition_key, r.id, r.watermark_ns)] = r  # of equal keys the last write stays
                    if len(held) >= self.most:
                        f.write(codec.encode_segment(held[k] for k in sorted(held)))
                        held = {}
                if held:
                    f.write(codec.encode_segment(held[k] for k in sorted(held)))
        return _Written(name)

    def commit(self, messages: list) -> None:
        os.makedirs(self.path, exist_ok=True)
        old = [p for p in glob.glob(f"{glob.escape(self.path)}/part-*") if self.overwrite]
        for m in messages:
            if m is not None and m.name:
                os.rename(f"{self.stage}/{m.name}", f"{self.path}/{m.name}")
        for p in old:
            os.remove(p)
        shutil.rmtree(self.stage, ignore_errors=True)

    def abort(self, messages: list) -> None:
        shutil.rmtree(self.stage, ignore_errors=True)


class _RecordFiles(DataSource):
    kind = ""

    @classmethod
    def name(cls) -> str:
        return cls.kind

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.kind, dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.kind, dict(self.options), overwrite)


class RecordioFiles(_RecordFiles):
    kind = "recordio"


class WalFiles(_RecordFiles):
    kind = "wal"


class SstableFiles(_RecordFiles):
    kind = "sstable"

    def reader(self, schema) -> DataSourceReader:
        return _TableReader(self.kind, dict(self.options))


def register(spark: SparkSession) -> None:
    for source in (RecordioFiles, WalFiles, SstableFiles):
        spark.dataSource.register(source)


def merged_log(logs: DataFrame) -> DataFrame:
    """Rows of a log's segments in record order."""
    from ..model import ORDER

    return logs.orderBy(*ORDER)


def merge_segments(*segments: Iterator[codec.Record]) -> Iterator[codec.Record]:
    """Sorted segments as one sorted sequence, lazily."""
    return heapq.merge(*segments, key=lambda r: (r.partition_key, r.id, r.watermark_ns))
