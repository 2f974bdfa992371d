"""Helpers that the corpus operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Output rows are sent back to the JVM once they hold about this many bytes.
FLUSH_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a
    temporary folder where that is unset, as in tests on one machine."""
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = tempfile.mkdtemp(prefix="streamwin-shared-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder. What is there when the driver ends goes with it."""
    path = f"{shared_dir(spark).rstrip('/')}/streamwin-{name}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


@contextmanager
def kept_aside(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """The session with other settings for a while."""
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: it is computed once,
    and a lost executor takes nothing of it along. Its shuffle files go at once."""
    spark = df.sparkSession
    path = scratch(spark, name)
    with kept_aside(spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete what ``stored`` has written for ``df``."""
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        remove(df.sparkSession, folder)


def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def remove(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: bool = False) -> DataFrame:
    """Only the id and the text (null: empty) of ``docs``, as ``doc_id`` and
    ``text``, whatever other columns there are; with ``key`` also ``row_key``,
    which tells rows of equal id and text apart."""
    out = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    return out.withColumn("row_key", F.monotonically_increasing_id()) if key else out


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds


def map_rows(df: DataFrame, make: Callable[[], Callable[..., Iterable[tuple]]], schema: str | T.StructType) -> DataFrame:
    """Rows of ``schema`` from rows of ``df``, in Arrow batches of bounded size.

    ``make`` runs once in each task and gives the function that is called with
    a row's values and yields output rows. If that function has an attribute
    ``finish``, its rows follow at the end of the task.
    """
    spark_schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow_schema = to_arrow_schema(spark_schema)
        wide = [i for i, f in enumerate(arrow_schema) if pa.types.is_string(f.type) or pa.types.is_binary(f.type) or pa.types.is_list(f.type)]
        each = make()
        held: list[tuple] = []
        size = 0

        def batch() -> pa.RecordBatch:
            columns = zip(*held) if held else [()] * len(arrow_schema)
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, arrow_schema)], schema=arrow_schema)

        for b in batches:
            # A slice at a time: Python copies of a whole batch of long texts would be large.
            for at in range(0, b.num_rows, 256):
                for row in zip(*(c.to_pylist() for c in b.slice(at, 256).columns)):
                    for out in each(*row):
                        held.append(out)
                        size += 40 + sum(len(out[i]) for i in wide if out[i] is not None)
                        if size >= FLUSH_BYTES:
                            yield batch()
                            held.clear()
                            size = 0
        if hasattr(each, "finish"):
            for out in each.finish():
                held.append(out)
                size += 40 + sum(len(out[i]) for i in wide if out[i] is not None)
                if size >= FLUSH_BYTES:
                    yield batch()
                    held.clear()
                    size = 0
        if held:
            yield batch()

    return df.mapInArrow(run, spark_schema)
