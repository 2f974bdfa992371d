"""What windows hold: summaries, sorted and de-duplicated rows, and handlers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

WINDOW = ("partition_key", "window_id")


def window_info(assigned: DataFrame) -> DataFrame:
    """A row for each window: first and last *arriving* times, writes, distinct
    (id, time) pairs, and whether a later window of its key has closed it."""
    rows = assigned.groupBy(*WINDOW, "id", "watermark_ns").agg(F.count("*").alias("n"), F.min("seq").alias("lo"), F.max("seq").alias("hi"))
    info = rows.groupBy(*WINDOW).agg(
        F.min_by("watermark_ns", "lo").alias("window_first_ns"),
        F.max_by("watermark_ns", "hi").alias("last_ns"),
        F.sum("n").cast("long").alias("record_count"),
        F.count("*").alias("distinct_count"),
    )
    later = F.lead("window_id").over(Window.partitionBy("partition_key").orderBy("window_id"))
    return info.withColumn("close_reason", F.when(later.isNull(), "open").otherwise("rotated"))


PLACE = (*WINDOW, "id", "watermark_ns")


def _last_arrivals(dealt: DataFrame) -> DataFrame:
    """Of equal (window, id, time) the last arrival, in record order. Rows must be
    dealt out already so that equal ones meet: then they are sorted once and not moved."""
    after = F.lead("seq").over(Window.partitionBy(*PLACE).orderBy("seq"))
    name = "_after"
    while name in dealt.columns:
        name += "_"
    return dealt.withColumn(name, after).where(F.col(name).isNull()).drop(name)


def window_rows(assigned: DataFrame) -> DataFrame:
    """Each window's rows as a handler sees them: of equal (key, id, time) the last arrival, in record order.

    Rows are dealt out by ranges of window, id and time, so a large window has many tasks.
    """
    return _last_arrivals(assigned.repartitionByRange(*PLACE))


def apply_handler(assigned: DataFrame, handler: Callable, schema: str | T.StructType) -> DataFrame:
    """Rows that ``handler(key, frame)`` returns for each window; key is (partition_key,
    window_id) and frame that window's rows as pandas, sorted and de-duplicated.

    A window must fit a task's memory: that is what its rule bounds.
    """

    def ordered(key, frame):
        return handler(key, frame.sort_values(["id", "watermark_ns"], kind="stable").reset_index(drop=True))

    return _last_arrivals(assigned.repartition(*WINDOW)).groupBy(*WINDOW).applyInPandas(ordered, schema)
