"""Values worked out once per distinct unit of text, and brought back to documents.

A corpus repeats its words, so what depends on a word alone (its pieces, their
number) is worked out once for each distinct word. Each task numbers the units of
its documents, some ``MOST_UNITS`` distinct ones to a block, and keeps documents
as compressed numbers, so a text is split once. The blocks' lists of units give
the distinct units; their values are joined to the lists by unit and meet the
documents by block.

A unit occurs once in a block's list, so common units are no hot keys of the
documents; a unit's rows grow with the number of blocks only, and adaptive
execution splits what is left of skew in the join. Nothing is broadcast.
"""

from __future__ import annotations

import zlib
from array import array
from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import exists, kept_aside, scratch, stored

#: Distinct units from which a block is closed.
MOST_UNITS = 500_000
#: Numbers of units that are compressed together, and such groups in a block.
GROUP, MOST_GROUPS = 250_000, 64
#: How hard zstd tries: blocks and cells are written, and shuffled once.
LEVEL = 7
#: Characters of the longest unit that is a key itself.
LONGEST_KEY = 61

#: A block's documents come after its units.
_DOCUMENTS = 0xFFFFFF


def unit_key(unit: str = "unit") -> Column:
    """What a unit is joined and grouped by: itself, or if it is long its digest after a NUL."""
    return F.when(F.length(unit) <= LONGEST_KEY, F.col(unit)).otherwise(F.concat(F.lit("\0"), F.sha2(unit, 256)))


def _planes(numbers: array) -> bytes:
    """The numbers' bytes, first all first ones: the high ones are nearly constant."""
    return np.array(numbers, np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes()


def _numbers(planes: bytes) -> np.ndarray:
    return np.frombuffer(planes, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()


#: What is kept of each document of a group.
HEAD = ["doc_id", "n_bytes", "n_units", "crc32"]


def _framed(head: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, head.schema) as out:
        out.write_batch(head)
    raw = sink.getvalue().to_pybytes()
    return len(raw).to_bytes(8, "little") + raw


def _group(raw: bytes) -> tuple[pa.RecordBatch, np.ndarray]:
    """Heads and numbers of a group of documents."""
    end = 8 + int.from_bytes(raw[:8], "little")
    return pa.ipc.open_stream(raw[8:end]).read_next_batch(), _numbers(raw[end:]).astype(np.int64)


def make_blocks(rows: DataFrame, make_split: Callable[[], Callable[[str], list[str]]], most_units: int = MOST_UNITS, counted: bool = False) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, text) as blocks, stored: the lists of units (key, at, unit), and
    groups of documents (at, packed) as numbers of units; with ``counted`` each of a
    document's units once, and how often it occurs. ``at`` is the block (36 bits)
    and the unit's number (24 bits)."""
    spark = rows.sparkSession
    kind = T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType)])
    schema = "at long, unit string, packed binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        doc_type = to_arrow_schema(kind).field(0).type
        units, pack = make_split(), zstandard.ZstdCompressor(level=LEVEL).compress
        block = TaskContext.get().partitionId() << 16
        known: dict[str, int] = {}
        new = known.setdefault
        held, times = array("I"), array("I")
        heads: list[tuple] = []
        groups = 0

        def batch(at: list[int] | np.ndarray, unit: list | None = None, packed: list | None = None) -> pa.RecordBatch:
            n = len(at)
            return pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(unit or [None] * n, pa.string()), pa.array(packed or [None] * n, pa.binary())], ["at", "unit", "packed"])

        def group() -> Iterator[pa.RecordBatch]:
            nonlocal held, times, groups
            if heads:
                ids, *rest = zip(*heads)
                head = pa.RecordBatch.from_arrays([pa.array(ids, doc_type), *(pa.array(c, pa.int64()) for c in rest)], HEAD)
                yield batch([block << 24 | _DOCUMENTS], packed=[pack(_framed(head) + _planes(held + times))])
                held, times = array("I"), array("I")
                heads.clear()
                groups += 1

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal block, groups
            yield from group()
            if len(known) > _DOCUMENTS:
                raise ValueError(f"a text has more than {_DOCUMENTS} distinct units")
            texts = list(known)
            for lo in range(0, len(texts), 50_000):
                some = texts[lo : lo + 50_000]
                yield batch(np.arange(lo, lo + len(some)) + (block << 24), unit=some)
            known.clear()
            block, groups = block + 1, 0

        for b in batches:
            # A slice at a time: Python copies of a whole batch of long texts would be large.
            for at in range(0, b.num_rows, 256):
                for doc_id, text in zip(*(c.to_pylist() for c in b.slice(at, 256).columns)):
                    raw, found = text.encode(), units(text)
                    if counted:
                        found = Counter(found)
                        times.extend(found.values())
                    held.extend([new(u, len(known)) for u in found])
                    heads.append((doc_id, len(raw), len(found), zlib.crc32(raw)))
                    if len(held) >= GROUP or len(heads) >= GROUP // 16:
                        yield from group()
                    if len(known) >= most_units or groups >= MOST_GROUPS:
                        yield from close()
        yield from close()

    made = rows.select("doc_id", "text").mapInArrow(run, schema).withColumn("kind", F.when(F.col("packed").isNull(), "units").otherwise("documents"))
    path = scratch(spark, "blocks")
    # Two files a task, so that a task needn't sort its rows.
    with kept_aside(spark, {"spark.sql.maxConcurrentOutputFileWriters": "2"}):
        made.write.option("compression", "zstd").partitionBy("kind").parquet(path)
    units, documents = (spark.read.schema(schema).parquet(f"{path}/kind={x}") if exists(spark, f"{path}/kind={x}") else spark.createDataFrame([], schema) for x in ("units", "documents"))
    return units.select(unit_key().alias("key"), "at", "unit"), documents.select("at", "packed")


def distinct_units(units: DataFrame) -> DataFrame:
    """key and unit of each distinct unit of ``units``, dealt by key. Units that are
    their own key aren't moved a second time."""
    tasks = int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    long = F.when(F.length("unit") > LONGEST_KEY, F.col("unit"))
    keys = units.select(unit_key().alias("key"), long.alias("long")).repartition(tasks, "key").distinct()
    return keys.select("key", F.coalesce("long", "key").alias("unit"))


class Ragged:
    """Lists of numbers, one after another."""

    def __init__(self, values: np.ndarray, sizes: np.ndarray):
        self.values, self.sizes = values, sizes
        self.starts = np.cumsum(sizes) - sizes

    def take(self, which: np.ndarray) -> np.ndarray:
        """The lists ``which``, joined."""
        sizes = self.sizes[which]
        return self.values[np.repeat(self.starts[which] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())]


def ragged(parts: list[pa.Array], width: int) -> Ragged:
    """Values that ``as_bytes`` has made of lists."""
    joined = pa.concat_arrays(parts) if parts else pa.array([], pa.binary())
    cuts = np.frombuffer(joined.buffers()[1], np.int32)[joined.offset : joined.offset + len(joined) + 1] if len(joined) else np.zeros(1, np.int32)
    values = np.frombuffer(joined.buffers()[2], f">u{width}", (cuts[-1] - cuts[0]) // width, cuts[0]) if cuts[-1] > cuts[0] else np.zeros(0)
    return Ragged(values.astype(np.int32), np.diff(cuts).astype(np.int64) // width)


def as_bytes(numbers: str, width: int) -> Column:
    """A list of ints as binary, ``width`` bytes each: that is less to shuffle, and
    Spark's Arrow writer takes time in the square of a batch's rows for lists."""
    return F.unhex(F.array_join(F.transform(numbers, lambda x: F.lpad(F.hex(x), 2 * width, "0")), ""))


def plain(parts: list[pa.Array]) -> np.ndarray:
    return pa.concat_arrays(parts).to_numpy() if parts else np.zeros(0, np.int64)


#: Parts of the join of lists to values: each part's shuffle files go before the next.
JOIN_PARTS = 2


def _cell(raw: bytes) -> tuple[np.ndarray, pa.Array]:
    """Units' numbers and values of a cell."""
    end = 8 + int.from_bytes(raw[:8], "little")
    batch = pa.ipc.open_stream(raw[8:end]).read_next_batch()
    values = batch.column("value")
    if values.type == pa.int32():
        cuts = np.concatenate([[0], np.cumsum(values.to_numpy())]).astype(np.int32)
        values = pa.Array.from_buffers(pa.binary(), len(values), [None, pa.py_buffer(cuts), pa.py_buffer(raw[end:])])
    return np.cumsum(batch.column("step").to_numpy()), values


def joined_values(units: DataFrame, known: DataFrame) -> DataFrame:
    """``known`` (key, value) for the lists of units, stored as cells: what a task of
    the join has of a block, compressed; ``at`` is the block and 0."""
    kind = known.schema["value"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=LEVEL).compress
        value_type = to_arrow_schema(T.StructType([T.StructField("value", kind)])).field(0).type
        held: list[pa.RecordBatch] = []
        block, rows = None, 0

        def cell() -> pa.RecordBatch:
            at = np.concatenate([b.column("at").to_numpy() for b in held])
            steps = pa.array(np.diff(at & _DOCUMENTS, prepend=0), pa.int32())
            values = pa.concat_arrays([b.column("value").cast(value_type) for b in held])
            held.clear()
            more = b""
            if pa.types.is_binary(value_type):  # sizes are smaller than offsets when they are compressed
                cuts = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1]
                more = values.buffers()[2][cuts[0] : cuts[-1]].to_pybytes() if cuts[-1] > cuts[0] else b""
                values = pa.array(np.diff(cuts), pa.int32())
            raw = pack(_framed(pa.RecordBatch.from_arrays([steps, values], ["step", "value"])) + more)
            return pa.RecordBatch.from_arrays([pa.array([block << 24], pa.int64()), pa.array([raw], pa.binary())], ["at", "cell"])

        for b in batches:
            blocks = b.column("at").to_numpy() >> 24
            cuts = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]
            for low, high in zip(cuts, cuts[1:]):
                if high > low:
                    if held and (blocks[low] != block or rows > 100_000):
                        yield cell()
                        rows = 0
                    block = int(blocks[low])
                    held.append(b.slice(low, high - low))
                    rows += high - low
        if held:
            yield cell()

    parts = []
    for i in range(JOIN_PARTS):
        own = F.pmod(F.xxhash64("key"), F.lit(JOIN_PARTS)) == i
        both = units.where(own).select("key", "at").join(known.where(own), "key").select("at", "value")
        parts.append(stored(both.sortWithinPartitions("at").mapInArrow(run, "at long, cell binary"), "cells"))
    return reduce(DataFrame.unionByName, parts)


def with_values(documents: DataFrame, found: DataFrame, gather: Callable[[list[pa.Array]], object], each: Callable[..., list[pa.Array]], schema: T.StructType) -> DataFrame:
    """Rows of ``schema`` from the documents of blocks and the values of their units.

    found: as of ``joined_values``. ``gather`` makes what ``each`` looks values up in;
    ``each(values, head, numbers, times)`` gives the columns for a group of
    documents: its heads, and their numbers one after another.
    """
    every = documents.unionByName(found, allowMissingColumns=True)
    tasks = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = every.repartition(tasks, F.shiftright("at", 24)).sortWithinPartitions("at").select("at", "cell", "packed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack, arrow = zstandard.ZstdDecompressor().decompress, to_arrow_schema(schema)
        cells: list[tuple[np.ndarray, pa.Array]] = []
        values, block = gather([]), None
        for b in batches:
            # A block's cells come before its documents.
            for at, cell, packed in zip(b.column("at").to_pylist(), b.column("cell"), b.column("packed")):
                if not packed.is_valid:
                    cells.append(_cell(unpack(cell.as_py())))
                else:
                    if at >> 24 != block:
                        at_numbers, parts = zip(*cells) if cells else ((), ())
                        ordered = [pa.concat_arrays(parts).take(pa.array(np.argsort(np.concatenate(at_numbers))))] if cells else []
                        values, block, cells = gather(ordered), at >> 24, []
                    head, numbers = _group(unpack(packed.as_py()))
                    made = each(values, head, *np.split(numbers, [head.column("n_units").to_numpy().sum()]))
                    yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(made, arrow)], schema=arrow)

    return dealt.mapInArrow(run, schema)
