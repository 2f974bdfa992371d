"""Records: their schema, order, and adapters from tables.

A record has an id, a partition key, an instant in nanoseconds with a zone name,
and an opaque payload; ``seq`` is its place in order of arrival.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RECORD = T.StructType([
    T.StructField("seq", T.LongType(), False),
    T.StructField("id", T.StringType(), False),
    T.StructField("partition_key", T.StringType(), False),
    T.StructField("watermark_ns", T.LongType(), False),
    T.StructField("watermark", T.TimestampType(), False),
    T.StructField("tz", T.StringType(), False),
    T.StructField("data", T.BinaryType(), False),
])

#: Records in order: by key, id, and time, bytes compared as they are.
ORDER = ("partition_key", "id", "watermark_ns")


def micros(ts: Column | str) -> Column:
    """Microseconds since 1970 of a timestamp, or of one without zone taken as UTC."""
    return F.unix_micros(F.col(ts).cast("timestamp") if isinstance(ts, str) else ts.cast("timestamp"))


def records(df: DataFrame, seq: Column, id: Column, key: Column, ts: Column, data: Column, tz: str = "UTC") -> DataFrame:
    """Rows of ``df`` as records; nulls become empty, and a null time 1970."""
    us = F.coalesce(micros(ts), F.lit(0).cast("long"))
    return df.select(
        seq.cast("long").alias("seq"),
        F.coalesce(id.cast("string"), F.lit("")).alias("id"),
        F.coalesce(key.cast("string"), F.lit("")).alias("partition_key"),
        (us * 1000).alias("watermark_ns"),
        F.timestamp_micros(us).alias("watermark"),
        F.lit(tz).alias("tz"),
        F.coalesce(data.cast("binary"), F.lit("").cast("binary")).alias("data"),
    )


def padded(column: str) -> Column:
    """A number as text that sorts like the number."""
    return F.lpad(F.col(column).cast("string"), 12, "0")


def with_watermark(df: DataFrame) -> DataFrame:
    """Decoded rows with the derived microsecond timestamp."""
    return df.withColumn("watermark", F.timestamp_micros(F.expr("watermark_ns div 1000")))
