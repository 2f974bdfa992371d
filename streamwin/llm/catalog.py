"""The queries of this subpackage and their SQL, as ``__spark_entry__`` lists them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, decontamination, language, oracles, pieces, quality, secrets, shards, simhash, token_counts, toxicity, transport


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The media column is written to the shared folder; all else is read from there."""
    return transport.media_digests(common.stored(transport.with_media(_table(spark, sf_dir, "documents")), "media"))


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.scores(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


def op4_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, as they are read from the store after they came in eight
    arrivals, each its own commit, with a look for full tiers after each."""
    docs = _table(spark, sf_dir, "documents")
    store = shards.ShardStore(spark, common.scratch(spark, "shards"))
    for i in range(8):
        store.append(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(8)) == i), f"arrival{i}")
        store.compact()
        store.vacuum()
    text = F.coalesce("text", F.lit(""))
    return store.read().select("doc_id", "lang", "source", "n_chars", F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("text_sha256"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.scores(docs, quality.fit(docs, _table(spark, sf_dir, "labels")))


def op6_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    # lower() is for the digits that hex() writes as capitals.
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoded_digests(_table(spark, sf_dir, "documents"), pieces.load(_tokenizer("piece_bpe_32k.model")))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.findings(_table(spark, sf_dir, "documents"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return language.predictions(docs, language.fit(docs))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_transport_stream,
        op2_token_counts,
        op3_toxicity,
        op4_compaction,
        op5_quality,
        op6_simhash_near_duplicates,
        op7_sentencepiece,
        op8_decontamination,
        op9_secrets,
        op10_language,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {"op4_compaction": oracles.COMPACTION, "op8_decontamination": oracles.DECONTAMINATION}
