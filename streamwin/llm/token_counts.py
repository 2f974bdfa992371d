"""Token counts of whole texts, without making ids.

The pieces of a pre-token depend on it alone. Each distinct pre-token is counted
once, the counts are joined to the pre-token frequencies of each document by
blocks (``blocks.py``), and the products are summed.

A null or empty text has 0 tokens; repeated rows are counted each; further columns
are not looked at; an empty table gives no rows.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .blocks import MOST_UNITS, distinct_units, joined_values, make_blocks, plain, with_values
from .common import forget, stored, texts

#: How the vocabulary's file changes and splits texts.
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
RULE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

# Up to U+017F nothing composes and, but for U+0130, lower case is one to one:
# the pre-tokeniser's classes can be written out there.
_PLAIN = re.compile(r"[^\x00-įı-ſ]")
_SPACE, _LETTER, _NUMBER = r"\t-\r \x85\xa0", r"a-zA-ZªµºÀ-ÖØ-öø-ſ", r"0-9²³¹¼½¾"
_PRETOKEN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^{_SPACE}{_LETTER}{_NUMBER}]+")


def special_strings(path: str) -> tuple[str, ...]:
    """The file's special strings: each counts as one token wherever it stands. A
    file that splits text by another rule than ``_PRETOKEN`` is refused."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    changes = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
    rules = [p.get("pattern", {}).get("Regex") for p in (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])]
    if changes != NORMALIZERS or rules[:1] != [RULE]:
        raise ValueError(f"{path} splits text by a rule that isn't supported")
    return tuple(sorted((t["content"] for t in spec.get("added_tokens", [])), key=len, reverse=True))


def make_splitter(path: str) -> Callable[[], Callable[[str], list[str]]]:
    """A maker of the function from a text to its pre-tokens, special strings included."""
    strings = special_strings(path)

    def make() -> Callable[[str], list[str]]:
        odd, pretokens, special = _PLAIN.search, _PRETOKEN.findall, re.compile("|".join(map(re.escape, strings)) or "(?!)")
        tokenizer = None  # loaded for the first text that needs it

        def plain(text: str) -> list[str]:
            nonlocal tokenizer
            if not odd(text):
                return pretokens(text.lower())
            if tokenizer is None:
                from tokenizers import Tokenizer

                tokenizer = Tokenizer.from_file(path)
            text = tokenizer.normalizer.normalize_str(text)
            return [text[a:b] for _, (a, b) in tokenizer.pre_tokenizer.pre_tokenize_str(text)]

        def split(text: str) -> list[str]:
            if not special.search(text):
                return plain(text)
            out = special.findall(text)
            for part in special.split(text):
                out += plain(part)
            return out

        return split

    return make


def count_pieces(units: DataFrame, path: str) -> DataFrame:
    """key and value, the number of pieces, of each distinct unit of ``units`` (key, unit)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A task has one core.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        for b in batches:
            pieces: list[int] = []
            for at in range(0, b.num_rows, 1000):
                pieces += [len(e.ids) for e in tokenizer.encode_batch_fast(b.column("unit").slice(at, 1000).to_pylist(), add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(pieces, pa.int64())], ["key", "value"])

    return units.mapInArrow(run, "key string, value long")


def token_counts(docs: DataFrame, path: str, limit: int = 2048, most_units: int = MOST_UNITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than ``limit`` tokens) of each row of ``docs``."""
    units, documents = make_blocks(texts(docs, id_col, text_col), make_splitter(path), most_units, counted=True)
    counts = stored(count_pieces(distinct_units(units), path), "pieces")
    found = joined_values(units, counts)
    forget(counts)
    forget(units)

    def each(values: np.ndarray, head: pa.RecordBatch, numbers: np.ndarray, times: np.ndarray) -> list[pa.Array]:
        n_units = head.column("n_units").to_numpy()
        ends, sums = np.cumsum(n_units), np.concatenate([[0], np.cumsum(values[numbers] * times)])
        n_tokens = sums[ends] - sums[ends - n_units]
        return [head.column("doc_id"), head.column("n_bytes"), pa.array(n_tokens), pa.array(n_tokens > limit)]

    fields = [("doc_id", docs.schema[id_col].dataType), ("n_bytes", T.LongType()), ("n_tokens", T.LongType()), ("over_limit", T.BooleanType())]
    return with_values(documents, found, plain, each, T.StructType([T.StructField(*f) for f in fields]))
