"""The corpus pipeline: stages that each take what the one before has kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; each result is
written to the shared folder and reread as the next stage's docs. All but the
last return the columns of ``documents``. Null texts count as empty throughout;
further columns pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamwin.llm import decontamination, pieces, quality, secrets, simhash
from streamwin.llm.common import stored

#: Jaccard similarity of five-word shingles from which texts are near copies.
SIMILARITY = 0.8


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score less than a half for quality go."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one of the smallest id.

    Near copies are op6's and texts whose five-word shingles have a Jaccard
    similarity of ``SIMILARITY``; groups are what such links connect.
    """
    return simhash.one_of_each(docs, similarity=SIMILARITY)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share a window with any benchmark item go."""
    return decontamination.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), least_items=1)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are masked; n_chars follows. Every document stays."""
    masked = secrets.mask(docs.withColumn("streamwin_text", F.col("text")))
    changed = ~F.col("text").eqNullSafe(F.col("streamwin_text"))
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return masked.select(*[f"`{c}`" for c in docs.columns])


def sentencepiece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_units, n_tokens, ids, size and checksum of the decoded text, and whether it equals the text."""
    import public_tokenizers

    return pieces.encoded_digests(docs, pieces.load(public_tokenizers.path("piece_bpe_32k.model")))


STAGES = [
    ("quality classifier", quality_stage),
    ("SimHash near-dedup", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("secret scans", secret_stage),
    ("SentencePiece encoding and decoding", sentencepiece_stage),
]

#: Learned scores, forests and merges can't be written in SQL; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
