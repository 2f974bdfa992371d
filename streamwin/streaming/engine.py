"""The streaming engine: records in, windows out, handlers run once a window is closed.

A batch's records get their windows as a table's do, going on from their keys' state
(count, first arriving time, window number), and go to a Parquet sink at once, a folder
a batch; the state after each batch goes to another folder. Nothing is held back: windows are put together from the sink, closed ones
while the stream runs, the open rest when it is flushed. State, sink and
checkpoint are one folder; a restart with the same folder goes on where the last run stopped.
A flush closes windows for good: each key's next record opens a new one. A purge
takes the rows of handled windows out of the sink.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from ..model import RECORD
from ..operators.assign import assign_windows, continue_windows
from ..operators.windows import apply_handler, window_info
from ..plans.strategy import Strategy

#: A key's last window after a batch, of which there have been as many flushes.
STATE = "partition_key string, n long, first_ns long, window_id long, flushes long"
#: Every so many batches the state of all keys is written, between them that of keys that had records.
WHOLE = 16

PURGE = "number long, through long, kept string"


class _Folder:
    """Files and folders of the store that a path names."""

    spark: SparkSession

    def _at(self, path: str) -> tuple:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def _names(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def _delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)


class _Batches(_Folder):
    """Writes batches with their windows, and their keys' state after each. A window
    that was open at a flush, of which there have been ``flushes``, is closed."""

    def __init__(self, spark: SparkSession, strategy: Strategy, folder: str, flushes: int = 0):
        self.spark, self.strategy, self.flushes = spark, strategy, flushes
        self.sink, self.states = f"{folder.rstrip('/')}/assigned", f"{folder.rstrip('/')}/states"

    def finished(self) -> list[int]:
        """Batches that have a state, less those that a later whole state made needless."""
        numbers = sorted(int(n[6:]) for n in self._names(self.states) if n.startswith("batch-"))
        return [n for n in numbers if self._exists(f"{self.states}/batch-{n}/_SUCCESS")]

    def write(self, batch: DataFrame, number: int) -> None:
        finished = self.finished()
        if finished and number <= finished[-1]:
            return  # run again after a failure
        if number and number - 1 not in finished:
            raise RuntimeError(f"no state of batch {number - 1}: the folder's stream was begun by another version, or has lost files")
        spark, folder = batch.sparkSession, f"{self.sink}/batch-{number}"
        before = self._state(spark, finished)
        if not self._exists(f"{folder}/_SUCCESS"):
            # The windows need the batch more than once; it is to be computed once.
            batch.persist(StorageLevel.DISK_ONLY)
            try:
                assigned = continue_windows(batch, self.strategy, before) if finished else assign_windows(batch, self.strategy)
                assigned.write.mode("overwrite").parquet(folder)
            finally:
                batch.unpersist()
        windows = spark.read.schema(_assigned_schema(batch.schema)).parquet(folder).groupBy("partition_key", "window_id").agg(F.count("*").alias("n"), F.first("window_first_ns").alias("first_ns"))
        last = windows.groupBy("partition_key").agg(F.max(F.struct("window_id", "n", "first_ns")).alias("last"))
        whole = number % WHOLE == 0
        both = last.join(before, "partition_key", "outer" if whole else "left")
        goes_on = F.col("last.window_id") == F.col("window_id")
        n = F.coalesce(F.col("last.n") + F.when(goes_on, F.col("n")).otherwise(0), "n")
        after = both.select("partition_key", n.alias("n"), F.coalesce("last.first_ns", "first_ns").alias("first_ns"), F.coalesce("last.window_id", "window_id").alias("window_id"), F.lit(self.flushes).cast("long").alias("flushes"))
        after.write.mode("overwrite").parquet(f"{self.states}/batch-{number}")
        if whole:
            for n in finished:
                self._delete(f"{self.states}/batch-{n}")

    def _state(self, spark: SparkSession, finished: list[int]) -> DataFrame:
        """Each key's window after the finished batches; n is 0 if it has been flushed."""
        if not finished:
            return spark.createDataFrame([], STATE).drop("flushes")
        begin = finished[-1] - finished[-1] % WHOLE
        rows = None
        for number in finished:
            if number >= begin:
                one = spark.read.schema(STATE).parquet(f"{self.states}/batch-{number}").withColumn("batch", F.lit(number))
                rows = one if rows is None else rows.unionAll(one)
        n = F.when(F.col("flushes") == self.flushes, F.col("n")).otherwise(0).cast("long")
        last = rows.groupBy("partition_key").agg(F.max(F.struct("batch", n.alias("n"), "first_ns", "window_id")).alias("s"))
        return last.select("partition_key", "s.n", "s.first_ns", "s.window_id")


def assign_stream(records: DataFrame, strategy: Strategy, folder: str, flushes: int = 0) -> DataStreamWriter:
    """A writer of a stream's records with window_id and window_first_ns to ``folder``/assigned,
    a folder a batch. Late records are never dropped: they join their key's open window
    or open its next one."""
    batches = _Batches(records.sparkSession, strategy, folder, flushes)
    return records.writeStream.foreachBatch(batches.write).outputMode("append").option("checkpointLocation", f"{folder.rstrip('/')}/checkpoint")


def _assigned_schema(records: T.StructType) -> T.StructType:
    return T.StructType([*records, T.StructField("window_id", T.LongType()), T.StructField("window_first_ns", T.LongType())])


class Engine(_Folder):
    """Cuts a stream into windows and hands finished ones to a handler.

    folder: a shared folder for sink, checkpoint and the log of handled windows.
    poll_seconds: between looks for new records and for closed windows.
    max_windows: most windows that one pass hands to the handler; None for all.
    delete_handled: purge after each call that has handled windows.
    Windows of a pass are handled in parallel, as many at a time as there are cores.
    """

    def __init__(self, spark: SparkSession, strategy: Strategy, folder: str, poll_seconds: float = 5.0, handler: Callable | None = None, handler_schema: str | None = None, max_windows: int | None = None, delete_handled: bool = False):
        if strategy is None:
            raise ValueError("partition strategy is required")
        if poll_seconds <= 0 or max_windows is not None and max_windows <= 0:
            raise ValueError("poll_seconds and max_windows must be greater than 0")
        self.spark, self.strategy, self.poll_seconds, self.max_windows = spark, strategy, poll_seconds, max_windows
        self.sink, self.checkpoint, self.done, self.results, self.flushed, self.purged = (f"{folder.rstrip('/')}/{x}" for x in ("assigned", "checkpoint", "handled", "results", "flushes", "purges"))
        self.folder, self.delete_handled = folder, delete_handled
        self._writer = _Batches(spark, strategy, folder)
        self.handler, self.handler_schema = handler, handler_schema
        self.schema = _assigned_schema(RECORD)
        self.query: StreamingQuery | None = None
        self.failures: list[Exception] = []
        self._passes, self._stopped, self._poller = threading.Lock(), threading.Event(), None

    def ingest(self, records: DataFrame, available_now: bool = False) -> StreamingQuery:
        """Start, or go on after a stop or failure: what was taken in before isn't taken in again."""
        self.schema = _assigned_schema(records.schema)
        self._writer = _Batches(self.spark, self.strategy, self.folder, self._flushes())
        writer = records.writeStream.foreachBatch(self._write).outputMode("append").option("checkpointLocation", self.checkpoint)
        writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=f"{self.poll_seconds} seconds")
        self.query = writer.start()
        return self.query

    def _write(self, batch: DataFrame, number: int) -> None:
        if number > self._purge_record()[1]:
            self._writer.write(batch, number)

    def start(self, records: DataFrame) -> StreamingQuery:
        """Take records in and run the handler on closed windows, at once and then
        every ``poll_seconds``, until ``stop``. A pass that fails at once is raised;
        a later failure is kept in ``failures``, and its windows are tried again."""
        self.process()
        query = self.ingest(records)
        self._stopped.clear()
        self._poller = threading.Thread(target=self._poll, daemon=True)
        self._poller.start()
        return query

    def _poll(self) -> None:
        while not self._stopped.wait(self.poll_seconds):
            try:
                self.process()
            except Exception as e:
                self.failures.append(e)

    def assigned(self) -> DataFrame:
        """All records so far with their windows, less those that were purged."""
        folders = self._folders()
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*folders)

    def windows(self) -> DataFrame:
        """All windows that are in the sink; the last one of each key is still open."""
        return window_info(self.assigned())

    def process(self, flush: bool = False) -> DataFrame | None:
        """Run the handler on closed windows that it hasn't handled, with ``flush``
        on open ones as well, and give its rows.

        At least once: a window counts as handled when its rows are written; a
        failure before that leaves it for the next call. Results carry
        (partition_key, window_id), by which repeats can be told.
        """
        if self.handler is None:
            return None
        if flush and self.query is not None and self.query.isActive:
            raise RuntimeError("windows are flushed once the stream has stopped")
        with self._passes:  # a window is never in two passes at once
            if flush:
                # First: a window that is handled must not take in later records.
                self.spark.range(1).write.mode("append").parquet(self.flushed)
            handled = 0
            while n := self._pass(flush):
                handled += n
                if self.max_windows is None:
                    break
        if handled and self.delete_handled:
            self.purge()
        return self.spark.read.schema(self.handler_schema).parquet(self.results) if self._exists(self.results) else self.spark.createDataFrame([], self.handler_schema)

    def purge(self) -> None:
        """Delete the rows of handled windows and the log of those windows.

        The rest of the finished batches is written anew; a record of the last batch in
        it takes the place of the old folders, which go then. A purge that dies
        before the record has done nothing, and one that dies after it is made good by
        the next. Frames that were read before may no longer be read.
        """
        with self._passes:
            number, through, before = self._purge_record()
            folders, batches = self._folders(), self._batches()
            if not folders or not self._exists(self.done):
                return
            kept = f"kept-{uuid.uuid4().hex}"
            # A handled window is closed: all its rows are in finished batches.
            handled = self.spark.read.parquet(self.done).distinct()
            self.spark.read.schema(self.schema).parquet(*folders).join(handled, ["partition_key", "window_id"], "left_anti").write.parquet(f"{self.sink}/{kept}")
            record = (number + 1, max([through, *batches]), kept)
            self.spark.createDataFrame([record], PURGE).coalesce(1).write.mode("append").parquet(self.purged)
            for name in self._names(self.sink):
                if name != kept and (name.startswith("kept-") or name.startswith("batch-") and int(name[6:]) <= record[1]):
                    self._delete(f"{self.sink}/{name}")
            self._delete(self.done)

    def _purge_record(self) -> tuple[int, int, str | None]:
        """Number of the last purge, the last batch in it, and the folder of what it kept."""
        if not self._exists(self.purged):
            return 0, -1, None
        return tuple(self.spark.read.schema(PURGE).parquet(self.purged).orderBy(F.desc("number")).first())

    def _batches(self) -> list[int]:
        """Finished batches that no purge has taken."""
        through = self._purge_record()[1]
        numbers = sorted(int(n[6:]) for n in self._names(self.sink) if n.startswith("batch-"))
        return [n for n in numbers if through < n <= max(self._writer.finished(), default=-1)]

    def _folders(self) -> list[str]:
        kept = self._purge_record()[2]
        return [f"{self.sink}/{n}" for n in ([kept] if kept else []) + [f"batch-{n}" for n in self._batches()]]

    def _pass(self, flush: bool) -> int:
        """Handle what is closed, at most ``max_windows``; how many windows it was."""
        assigned = self.assigned()
        todo = window_info(assigned).where(F.lit(flush) | (F.col("close_reason") == "rotated")).select("partition_key", "window_id")
        if self._exists(self.done):
            todo = todo.join(self.spark.read.parquet(self.done), ["partition_key", "window_id"], "left_anti")
        if self.max_windows is not None:
            todo = todo.orderBy("window_id", "partition_key").limit(self.max_windows)
        todo = todo.persist()
        try:
            n = todo.count()
            if not n:
                return 0
            rows = apply_handler(assigned.join(todo, ["partition_key", "window_id"], "left_semi"), self.handler, self.handler_schema)
            rows.write.mode("append").parquet(self.results)
            todo.write.mode("append").parquet(self.done)
        finally:
            todo.unpersist()
        return n

    def stop(self, flush: bool = True) -> None:
        """Stop taking records in, wait for the pass that is under way, and handle what is left."""
        self._stopped.set()
        if self._poller is not None:
            self._poller.join()
            self._poller = None
        if self.query is not None:
            self.query.stop()
            self.query = None
        if flush:
            self.process(flush=True)

    def _flushes(self) -> int:
        return self.spark.read.parquet(self.flushed).count() if self._exists(self.flushed) else 0
