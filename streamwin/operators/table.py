"""Sorted tables: Parquet, range-partitioned and sorted by id, so that footers and
row-group statistics are the index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.record import record_size


class TableOrderError(ValueError):
    """Rows were not in ascending order of id."""


def order_violations(df: DataFrame, id: str = "id", seq: str = "seq", chunk: int = 1 << 20) -> DataFrame:
    """Rows whose id is less than that of the row before, in order of ``seq``.

    Neighbours are compared within chunks of ``seq``; a chunk's first row is
    compared with the last of the chunk before.
    """
    rows = df.select(F.col(seq).alias("seq"), F.col(id).alias("id"), F.floor(F.col(seq) / chunk).alias("chunk"))
    lasts = rows.groupBy("chunk").agg(F.max_by("id", "seq").alias("last_id"))
    # One row for each chunk.
    carried = lasts.select("chunk", F.lag("last_id").over(Window.orderBy("chunk")).alias("carried"))
    before = F.lag("id").over(Window.partitionBy("chunk").orderBy("seq"))
    near = rows.withColumn("before", before).join(carried, "chunk")
    return near.withColumn("before", F.coalesce("before", "carried")).where("id < before").select("seq", "id", "before")


def write_table(df: DataFrame, path: str, by: str = "id", strict: bool = False) -> None:
    """Write a table; ``strict`` demands that rows come in ascending order of ``by``."""
    if strict and not order_violations(df, by).isEmpty():
        raise TableOrderError(f"rows are not in ascending order of {by}")
    df.repartitionByRange(by).sortWithinPartitions(by).write.parquet(path)


def scan(spark: SparkSession, path: str, by: str = "id") -> DataFrame:
    return spark.read.parquet(path).orderBy(by)


def get(spark: SparkSession, path: str, key, by: str = "id") -> DataFrame:
    """The rows of one key; none if it is missing. The equality reaches the scan."""
    return spark.read.parquet(path).where(F.col(by) == F.lit(key))


def segments(df: DataFrame, most: int = 1000) -> DataFrame:
    """Log segments of at most ``most`` records: number, records, and bytes with header."""
    if most <= 0:
        raise ValueError("max records must be greater than 0")
    from .assign import numbered

    rows = numbered(df, name="n").withColumn("segment", F.floor(F.col("n") / most).cast("long"))
    return rows.groupBy("partition_key", "segment").agg(F.count("*").alias("records"), (F.sum(record_size()) + 8).cast("long").alias("bytes"))
