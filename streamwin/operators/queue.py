"""A keyed priority queue as a table of changes.

Changes have a key, a value and ``seq``; setting a key again replaces its value,
a change with ``removed`` takes the key out. Equal values are ordered by key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def state(changes: DataFrame, removed: str | None = None) -> DataFrame:
    """key and value of what the queue holds after all changes."""
    gone = F.col(removed) if removed else F.lit(False)
    last = changes.groupBy("key").agg(F.max_by(F.struct("value", gone.alias("gone")), "seq").alias("s"))
    return last.where("not s.gone").select("key", F.col("s.value").alias("value"))


def remove(held: DataFrame, keys: DataFrame) -> DataFrame:
    """``held`` without the given keys; keys that aren't there don't matter."""
    return held.join(keys.select("key").distinct(), "key", "left_anti")


def get(held: DataFrame, key) -> DataFrame:
    return held.where(F.col("key") == F.lit(key))


def _best(held: DataFrame, greatest: bool) -> list:
    return [F.desc("value") if greatest else F.asc("value"), F.asc("key")]


def peek(held: DataFrame, greatest: bool = False) -> DataFrame:
    return pop_k(held, 1, greatest)


def pop_k(held: DataFrame, k: int, greatest: bool = False) -> DataFrame:
    """The first ``k`` to come out; only k rows of each task are sorted and moved."""
    return held.orderBy(*_best(held, greatest)).limit(k)


def drain(held: DataFrame, greatest: bool = False) -> DataFrame:
    return held.orderBy(*_best(held, greatest))
