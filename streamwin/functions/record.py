"""Expressions over records and windows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of a record besides its four variable fields.
FIXED_BYTES = 43
#: Bytes of a log segment's header.
SEGMENT_HEADER = 8


def record_size(id: Column | str = "id", key: Column | str = "partition_key", tz: Column | str = "tz", data: Column | str = "data") -> Column:
    """Bytes of a record's encoding, without encoding it."""
    return (F.lit(FIXED_BYTES) + F.octet_length(id) + F.octet_length(key) + F.octet_length(tz) + F.octet_length(data)).cast("long")


def window_filename(key: Column | str, first_us: Column | str) -> Column:
    """The name of a window's file: its key and the whole seconds of its first record."""
    us = F.col(first_us) if isinstance(first_us, str) else first_us
    return F.concat(key if isinstance(key, Column) else F.col(key), F.lit("_"), F.floor(us / 1_000_000).cast("string"), F.lit(".wal"))


_NAME = r"^([^_]*)_([+-]?[0-9]+)(?:\.wal)?$"


def parse_filename(name: Column | str) -> Column:
    """struct(partition_key, seconds) of a file name; null for names that don't have just one underscore before a number."""
    name = F.col(name) if isinstance(name, str) else name
    fields = F.struct(F.regexp_extract(name, _NAME, 1).alias("partition_key"), F.regexp_extract(name, _NAME, 2).try_cast("long").alias("seconds"))
    return F.when(name.rlike(_NAME), fields)
