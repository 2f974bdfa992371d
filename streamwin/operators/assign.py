"""Window assignment.

A key's windows follow each other in order of arrival, which makes time rules
sequential within a key. Count rules are not: a record's window is its number
within the key divided by N, and numbers come from counts of chunks, so even a
key that holds most rows is numbered by many tasks.
"""

from __future__ import annotations

import heapq
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.strategy import AnyOf, Count, Never, Strategy, Time

#: Range of ``seq`` that one task numbers for a key.
CHUNK = 1 << 20

#: A key's window before one of its records.
MARK = T.StructType([T.StructField(n, T.LongType()) for n in ("n", "first_ns", "window_id")])

#: Parts of a key's rows that are handed its first time.
ROW_PARTS = 1024

#: The global pass: parts in which keys are given codes, rows packed together, and
#: the length at which its queue is first cleared of stale entries.
KEY_PARTS, BLOB, QUEUE = 1024, 1024, 1 << 16


def numbered(df: DataFrame, key: str = "partition_key", seq: str = "seq", name: str = "number", chunk: int = CHUNK, carry: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``df`` with each row's number, from 0, within its key in order of ``seq`` (a distinct integer).

    Rows are numbered within (key, chunk of seq); offsets are running sums of
    the chunks' counts. ``carry`` adds columns to the chunks, which rows get too.
    """
    rows = df.withColumn("_chunk", F.floor(F.col(seq) / chunk))
    sizes = rows.groupBy(key, "_chunk").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(key, "_chunk", before.alias("_before"))
    offsets = carry(offsets) if carry else offsets
    place = F.row_number().over(Window.partitionBy(key, "_chunk").orderBy(seq)) - 1
    return rows.join(offsets, [key, "_chunk"]).withColumn(name, (place + F.col("_before")).cast("long")).select(*df.columns, name, *offsets.columns[3:])


def _limits(strategy: Strategy) -> tuple[int, int] | None:
    """(most records, longest ns) of rules that are counts and times only; None for others."""
    if isinstance(strategy, Never):
        return 1 << 62, 1 << 62
    if isinstance(strategy, Count):
        return max(strategy.n, 1), 1 << 62
    if isinstance(strategy, Time):
        return 1 << 62, strategy.ns
    if isinstance(strategy, AnyOf):
        parts = [_limits(r) for r in strategy.rules]
        if None not in parts:
            return min([p[0] for p in parts], default=1 << 62), min([p[1] for p in parts], default=1 << 62)
    return None


def _split(times: np.ndarray, n: int, first: int, window: int, strategy: Strategy, limits: tuple[int, int] | None) -> tuple[np.ndarray, np.ndarray, int, int, int]:
    """Window and first time of each record of one key's run, and the state after it; n is 0 before the key's first."""
    windows, firsts = np.empty(len(times), np.int64), np.empty(len(times), np.int64)
    at = 0
    if limits is None:
        for i, now in enumerate(times.tolist()):
            if n == 0 or strategy.closes(n, first, now):
                n, first, window = 0, now, window + 1
            n += 1
            windows[i], firsts[i] = window, first
        return windows, firsts, n, first, window
    most, longest = limits
    while at < len(times):
        if n == 0 or n >= most or times[at] - first > longest:
            n, first, window = 0, int(times[at]), window + 1
        # Up to the next record that closes the window, by count or by time.
        end = min(len(times), at + most - n)
        step = 64
        stop = at
        while stop < end:
            late = np.flatnonzero(times[stop : min(stop + step, end)] - first > longest)
            if len(late):
                end = stop + int(late[0])
                break
            stop, step = min(stop + step, end), step * 4
        windows[at:end], firsts[at:end] = window, first
        n += end - at
        at = end
    return windows, firsts, n, first, window


def _assigned(batch: pa.RecordBatch, windows: np.ndarray, firsts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, pa.array(windows), pa.array(firsts)], [*batch.schema.names, "window_id", "window_first_ns"])


def _schema(df: DataFrame) -> T.StructType:
    return T.StructType([*df.schema, T.StructField("window_id", T.LongType()), T.StructField("window_first_ns", T.LongType())])


def assign_windows(df: DataFrame, strategy: Strategy, eviction: str = "local") -> DataFrame:
    """``df`` (seq, partition_key, watermark_ns and more) with window_id, a number
    from 0 within the key, and window_first_ns, the time of its first arrival.

    eviction: 'local' closes a key's window by that key's records only. 'global' lets
    a record of any key close expired windows of others, as a single ordered pass
    does; that order is global, so one task makes the pass, over numbers only. On input in time order
    both give the same windows for rules that stay true once they are: all but
    ``Custom`` ones.
    """
    if strategy is None:
        raise ValueError("partition strategy is required")
    if eviction == "global":
        return _global_pass(df, strategy)
    if eviction != "local":
        raise ValueError("eviction is 'local' or 'global'")
    return _local(df, strategy)


def continue_windows(df: DataFrame, strategy: Strategy, state: DataFrame) -> DataFrame:
    """Windows by their keys' records only, as ``assign_windows`` gives them, that go on from
    ``state``: a row of partition_key, n, first_ns and window_id for each key so far, with n of 0
    where the window was closed otherwise."""
    limits = _limits(strategy)
    if limits is not None and limits[1] >= 1 << 62:
        return _by_count(df, limits[0], state)
    return _local(df, strategy, state.withColumn("seq", F.lit(None).cast("long")))


def _by_count(df: DataFrame, most: int, state: DataFrame | None = None) -> DataFrame:
    def carry(parts: DataFrame) -> DataFrame:
        """With what a key's first row meets: _n0 records in window _w0, of first time _f0."""
        goes_on = (F.col("n") > 0) & (F.col("n") < most)
        n, window = F.when(goes_on, F.col("n")).otherwise(0), F.when(goes_on, F.col("window_id")).otherwise(F.col("window_id") + 1)
        met = state.select("partition_key", n.alias("_n0"), window.alias("_w0"), F.when(goes_on, F.col("first_ns")).alias("_f0"))
        return parts.join(met, "partition_key", "left").fillna(0, ["_n0", "_w0"])

    if most >= 1 << 62:
        # No numbers are wanted, and a key may have all rows: they get its first time by parts.
        rows = df.withColumn("_part", F.pmod(F.xxhash64("seq"), F.lit(ROW_PARTS)))
        parts = rows.groupBy("partition_key", "_part").agg(F.min("seq").alias("_seq"), F.min_by("watermark_ns", "seq").alias("_ns"))
        first = F.min_by("_ns", "_seq").over(Window.partitionBy("partition_key"))
        parts = parts.select("partition_key", "_part", F.lit(0).cast("long").alias("window_id"), first.alias("window_first_ns"))
        if state is not None:
            parts = carry(parts.drop("window_id"))
            parts = parts.select("partition_key", "_part", F.col("_w0").alias("window_id"), F.coalesce("_f0", "window_first_ns").alias("window_first_ns"))
        return rows.join(parts, ["partition_key", "_part"]).select(*df.columns, "window_id", "window_first_ns")
    out, ns = numbered(df, name="_number", carry=carry if state is not None else None), F.min_by("watermark_ns", "seq")
    if state is None:
        out = out.withColumn("window_id", F.floor(F.col("_number") / F.lit(most)).cast("long"))
    else:
        out = out.withColumn("window_id", F.col("_w0") + F.floor((F.col("_number") + F.col("_n0")) / F.lit(most)).cast("long"))
        ns = F.coalesce(F.max(F.when(F.col("window_id") == F.col("_w0"), F.col("_f0"))), ns)
    first = out.groupBy("partition_key", "window_id").agg(ns.alias("window_first_ns"))
    return out.select(*df.columns, "window_id").join(first, ["partition_key", "window_id"]).select(*df.columns, "window_id", "window_first_ns")


def _local(df: DataFrame, strategy: Strategy, marks: DataFrame | None = None) -> DataFrame:
    """Each key's windows by its own records. ``marks`` has rows of partition_key, seq
    and n, first_ns, window_id: before the key's record of that seq, or its first one
    if seq is null, its window is as those say; a null window_id leaves the number as it is."""
    limits = _limits(strategy)
    if marks is None and limits is not None and limits[1] >= 1 << 62:
        return _by_count(df, limits[0])
    mark = "_mark"
    while mark in df.columns:
        mark += "_"
    columns, rows = df.columns, df.withColumn(mark, F.lit(None).cast(MARK))
    if marks is not None:
        state = F.struct(*(F.col(f.name).cast("long").alias(f.name) for f in MARK))
        rows = rows.unionByName(marks.select("partition_key", "seq", F.lit(0).cast("long").alias("watermark_ns"), state.alias(mark)), allowMissingColumns=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n, first, window = None, 0, 0, -1
        for b in batches:
            if not b.num_rows:
                continue
            names, marked = b.column("partition_key"), b.column(mark)
            times = b.column("watermark_ns").to_numpy()
            windows, firsts = np.empty(len(times), np.int64), np.empty(len(times), np.int64)
            codes = names.dictionary_encode().indices.to_numpy(zero_copy_only=False)
            is_mark = marked.is_valid().to_numpy(zero_copy_only=False)
            at = np.flatnonzero(is_mark)
            cuts = np.unique(np.concatenate([[0, len(times)], np.flatnonzero(np.diff(codes)) + 1, at, at + 1])).tolist()
            for lo, hi in zip(cuts, cuts[1:]):
                if (name := names[lo].as_py()) != key:
                    key, n, first, window = name, 0, 0, -1
                if is_mark[lo]:
                    state = marked[lo].as_py()
                    n, first = state["n"], state["first_ns"]
                    window = window if state["window_id"] is None else state["window_id"]
                else:
                    windows[lo:hi], firsts[lo:hi], n, first, window = _split(times[lo:hi], n, first, window, strategy, limits)
            b = pa.RecordBatch.from_arrays([b.column(c) for c in columns], columns)
            if len(at):
                b, windows, firsts = b.filter(pa.array(~is_mark)), windows[~is_mark], firsts[~is_mark]
            yield _assigned(b, windows, firsts)

    # Keys stream through their task in order; nothing is gathered.
    return rows.repartition("partition_key").sortWithinPartitions("partition_key", "seq", F.col(mark).isNull()).mapInArrow(run, _schema(df))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of seq, code and watermark_ns, in order, as few rows of compressed columns."""
    for b in batches:
        for at in range(0, b.num_rows, BLOB):
            seqs, codes, times = (c.to_numpy() for c in b.slice(at, BLOB).columns)
            raw = np.concatenate([np.diff(seqs, prepend=0), codes, times]).astype(np.int64).reshape(3, -1)
            # Bytes of the same weight side by side.
            data = pa.compress(raw.view(np.uint8).reshape(3, -1, 8).transpose(0, 2, 1).tobytes(), codec="zstd", asbytes=True)
            yield pa.RecordBatch.from_pydict({"low": [int(seqs[0])], "high": [int(seqs[-1])], "n": [len(seqs)], "data": [data]})


def _unpack(n: int, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = np.frombuffer(pa.decompress(data, n * 24, codec="zstd", asbytes=True), np.uint8)
    deltas, codes, times = np.ascontiguousarray(raw.reshape(3, 8, n).transpose(0, 2, 1)).view(np.int64).reshape(3, n)
    return np.cumsum(deltas), codes, times


def _global_pass(df: DataFrame, strategy: Strategy) -> DataFrame:
    """One task passes over all records in order, but over numbers only: arrival, key's
    code, time, packed. It says which records open a window that their key's own records
    would not have opened; with these marked, keys are cut into windows apart."""
    limits = _limits(strategy)
    if limits is not None and limits[1] >= 1 << 62:
        return _local(df, strategy)  # a window that is full takes no further record, whoever closes it
    # Codes are dense, or nearly so: the pass has arrays by code.
    place = F.row_number().over(Window.partitionBy("_part").orderBy("partition_key")) - 1
    keys = df.select("partition_key").distinct().withColumn("_part", F.pmod(F.xxhash64("partition_key"), F.lit(KEY_PARTS)))
    keys = keys.select(F.col("partition_key").alias("_key"), (place.cast("long") * KEY_PARTS + F.col("_part")).alias("_code"))
    slim = df.select(F.coalesce("seq", F.lit(-(1 << 63))).alias("seq"), "partition_key", "watermark_ns")
    slim = slim.join(keys, F.col("partition_key").eqNullSafe(F.col("_key"))).select("seq", "_code", "watermark_ns")
    packed = slim.repartitionByRange("seq").sortWithinPartitions("seq").mapInArrow(_pack, "low long, high long, n long, data binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        closes, push, pop = strategy.closes, heapq.heappush, heapq.heappop
        # By code: records in the key's last window, its first time, and the number of its last record, 0 once it is closed.
        counts, firsts, stamps = array("q"), array("q"), array("q")
        queue: list[int] = []  # last time, stamp and code as one number; entries of another stamp are stale
        stamp, most = 0, QUEUE
        for b in batches:
            for size, data in zip(b.column("n").to_pylist(), b.column("data")):
                seqs, codes, times = _unpack(size, data.as_py())
                if (more := int(codes.max()) + 1 - len(counts)) > 0:
                    for a in (counts, firsts, stamps):
                        a.frombytes(bytes(8 * more))
                opens_code, opens_at = [], []
                for i, (code, now) in enumerate(zip(codes.tolist(), times.tolist())):
                    n = counts[code]
                    if n == 0 or closes(n, firsts[code], now):
                        counts[code], firsts[code] = 1, now
                    elif stamps[code] == 0:
                        counts[code], firsts[code] = 1, now
                        opens_code.append(code)
                        opens_at.append(i)
                    else:
                        counts[code] = n + 1
                    stamp += 1
                    stamps[code] = stamp
                    push(queue, now << 76 | stamp << 32 | code)
                    while queue:
                        head = queue[0]
                        k = head & 0xFFFFFFFF
                        if stamps[k] == head >> 32 & 0xFFFFFFFFFFF:
                            if not closes(counts[k], firsts[k], now):
                                break
                            stamps[k] = 0
                        pop(queue)
                    if len(queue) > most:
                        queue = [e for e in queue if stamps[e & 0xFFFFFFFF] == e >> 32 & 0xFFFFFFFFFFF]
                        heapq.heapify(queue)
                        most = max(QUEUE, 2 * len(queue))
                if opens_at:
                    yield pa.RecordBatch.from_arrays([pa.array(opens_code, pa.int64()), pa.array(seqs[opens_at])], ["_code", "seq"])

    opens = packed.repartition(1).sortWithinPartitions("low", "high").mapInArrow(run, "_code long, seq long").join(keys, "_code")
    marks = opens.select(F.col("_key").alias("partition_key"), "seq", F.lit(0).alias("n"), F.lit(0).alias("first_ns"), F.lit(None).alias("window_id"))
    return _local(df, strategy, marks)
