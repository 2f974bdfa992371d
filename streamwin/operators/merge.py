"""Merging of sorted inputs and keep-latest compaction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import ORDER, RECORD


def merge_sorted(*inputs: DataFrame, by: tuple[str, ...] = ORDER) -> DataFrame:
    """All rows of all inputs in order, duplicates kept; of equal rows those of later inputs come last.

    The result is range-partitioned: no task sees more than its range.
    """
    if not inputs:
        raise ValueError("nothing to merge")
    parts = [df.withColumn("_input", F.lit(i)) for i, df in enumerate(inputs)]
    rest = [c for c in ("seq",) if c in inputs[0].columns]
    return reduce(DataFrame.unionByName, parts).orderBy(*by, "_input", *rest).drop("_input")


def compact(*inputs: DataFrame, by: tuple[str, ...] = ("id",), spark: SparkSession | None = None) -> DataFrame:
    """For each value of ``by`` the row of the latest time; of equal times that of
    the later input, then of the greater ``seq``. No input at all gives no rows.

    Latest rows are chosen before the shuffle as well as after it, so a value
    with many versions moves one row from each task.
    """
    if not inputs:
        spark = spark or SparkSession.active()
        return spark.createDataFrame([], RECORD)
    columns = inputs[0].columns
    rest = [c for c in columns if c not in by]
    every = reduce(DataFrame.unionByName, [df.withColumn("_input", F.lit(i)) for i, df in enumerate(inputs)])
    latest = F.max_by(F.struct(*rest), F.struct("watermark_ns", "_input", "seq")).alias("r")
    return every.groupBy(*by).agg(latest).select(*by, "r.*").select(*columns)
