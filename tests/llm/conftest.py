import zlib

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"

#: Texts every operator must take: null, empty, blank, repeated, long, odd signs.
ODD = [
    (1, None), (2, ""), (3, "  \n\t "), (4, "one"), (5, "the same words again and again"), (6, "the same words again and again"),
    (6, "the same words again and again"), (7, "x" * 5000), (8, "long text " * 3000), (9, "İΣ ß ⁇ 漢字 \x00 \x85  ▁▁a  b <|endoftext|>"), (None, "no id here"), (10, "日本語 テキスト"),
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    rows = [(i, t, None if i == 4 else "en", None if i == 5 else "src0", None if t is None else len(t)) for i, t in ODD]
    from pyspark.sql import functions as F

    # Further columns, with names that the operators use themselves.
    return spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(c) for c in ("row_key", "score", "words", "fp", "text_hash", "unit", "label", "n")})


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


@pytest.fixture(scope="session")
def held_out():
    return lambda i, folds, which: zlib.crc32(("" if i is None else str(i)).encode()) % folds == which
