"""Connected components of a link table, by alternating stars.

Each round hangs every node's larger neighbours, then its smaller ones, on the
smallest node it sees (large star and small star of Kiveris et al., 2014). A star
is one shuffle, so a round is two; a node's links are in one task, which spills
them if they are many. Each round is written to the shared folder, which cuts the
lineage. Rounds end when one leaves all links as they were: then each node hangs
on a root, once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import remove, scratch


def _round(links: DataFrame) -> DataFrame:
    """links: u > v, repeats allowed. Both stars in turn; each deals its links out by u once."""

    def seen(pairs: DataFrame) -> DataFrame:
        """Distinct u and v, and m, the smallest v of each u."""
        return pairs.repartition("u").distinct().withColumn("m", F.min("v").over(Window.partitionBy("u")))

    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    large = seen(both).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
    # The smallest neighbour's link stays, the other neighbours hang on it.
    return seen(large).select(F.when(F.col("v") > F.col("m"), F.col("v")).otherwise(F.col("u")).alias("u"), F.col("m").alias("v"))


def _state(links: DataFrame) -> tuple:
    # A sum: unlike a bit_xor it doesn't lose links that are there twice.
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """node and root, the smallest node of its component, for every node that is
    not itself a root. ``links`` has two columns of one orderable type; links of
    a node with itself or with null count for nothing."""
    a, b = links.columns
    links = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(f"`{a}` is not null and `{b}` is not null and u > v").distinct()
    spark = links.sparkSession

    def written(df: DataFrame) -> tuple[str, DataFrame]:
        path = scratch(spark, name)
        df.write.parquet(path)
        return path, spark.read.schema(df.schema).parquet(path)

    path, links = written(links)
    state = _state(links)
    while state[0]:
        last = path
        path, links = written(_round(links))
        remove(spark, last)
        if (now := _state(links)) == state:
            break
        state = now
    return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
