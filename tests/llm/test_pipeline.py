"""Every stage on what the one before has kept."""

import corpus_pipeline
from streamwin.llm import decontamination, simhash


def test_stages(spark, sf_dir):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "SimHash near-dedup", "benchmark decontamination", "secret scans", "SentencePiece encoding and decoding"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir).persist()
        assert out.columns == columns, name
        assert n * 0.7 < out.count() <= docs.count(), name
        docs = out
    # One of each group is left, and no secret.
    found = simhash.near_duplicates(docs)
    assert found.select("component_id").distinct().count() == found.count()
    assert docs.where(docs.text.rlike('token = "[0-9a-f]{40}"')).isEmpty()
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert last.count() == docs.count()
    import zlib

    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.text_crc32 == zlib.crc32((texts[r.doc_id] or "").encode()) for r in last.collect())


def test_one_planted_item_is_enough(spark, sf_dir):
    item = next(r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").orderBy("item_id").collect() if len(r.text.split()) >= 12)
    texts = [(1, f"some words before it {item} and some after"), (2, item), (3, "nothing of the kind " * 5), (4, None), (5, " ".join(item.split()[:5]))]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    kept = corpus_pipeline.decontamination_stage(spark, docs, sf_dir)
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 5]
    flagged = decontamination.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    assert flagged.where("contaminated").isEmpty() and flagged.where("n_items = 1").count() == 2


def test_stages_take_odd_and_empty_tables(spark, sf_dir, odd_docs):
    """Null, empty and repeated texts, and columns that the operators have names for themselves."""
    for docs in (odd_docs, odd_docs.limit(0)):
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES[:-1]:
            before = docs
            docs = stage(spark, docs, sf_dir)
            assert docs.columns == columns, name
            assert docs.exceptAll(before).isEmpty(), name  # no secrets there: rows stay as they are or go
        last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
        assert last.count() == docs.count()
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        kept = [r.doc_id for r in stage(spark, odd_docs, sf_dir).collect()]
        if name == "SimHash near-dedup":
            # Of the null, empty and blank texts one stays, and of the equal ones.
            assert sum(i in (1, 2, 3) for i in kept) == 1 and sum(i in (5, 6) for i in kept) == 1, kept
        else:
            assert len(kept) == odd_docs.count(), name
