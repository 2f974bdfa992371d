"""Labelled rows to learn from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_of, texts

#: Labelled rows that a classifier is fitted on, at most: those of smallest id hash.
MOST_LABELLED = 16_384


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, most: int = MOST_LABELLED) -> DataFrame:
    """doc_id, text and label (0 or 1) of at most ``most`` labelled rows that the
    fold rule doesn't hold out. Ids of labels that repeat count once, with the
    smaller label; null ids and labels count for nothing."""
    chosen = (
        labels.select("doc_id", F.col(label).cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1))
        .where(fold_of(F.col("doc_id"), folds) != held_out)
        .groupBy("doc_id")
        .agg(F.min("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most)
    )
    return texts(docs).join(F.broadcast(chosen), "doc_id")  # at most ``most`` rows
