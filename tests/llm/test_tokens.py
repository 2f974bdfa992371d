"""Token counts and SentencePiece, against the libraries."""

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from streamwin.llm import pieces, token_counts

WORD, PIECE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.mark.parametrize("most_units", [1, 300, 100_000])
def test_counts_equal_the_library(spark, documents, odd_docs, most_units):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORD)
    for docs in (documents, odd_docs):
        got = sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(docs, WORD, most_units=most_units).collect())
        rows = docs.select("doc_id", "text").collect()
        sizes = [len(e.ids) for e in tokenizer.encode_batch([r.text or "" for r in rows], add_special_tokens=False)]
        assert got == sorted((r.doc_id or 0, len((r.text or "").encode()), n, n > 2048) for r, n in zip(rows, sizes))
    assert token_counts.token_counts(odd_docs.limit(0), WORD).isEmpty()


def test_files_of_other_rules_are_refused():
    with pytest.raises(ValueError, match="isn't supported"):
        token_counts.make_splitter(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.mark.parametrize("most_units", [300, 100_000])
def test_encoding_equals_the_library(spark, documents, odd_docs, most_units):
    import sentencepiece

    library, vocabulary = sentencepiece.SentencePieceProcessor(model_file=PIECE), pieces.load(PIECE)
    for docs in (documents, odd_docs):
        rows = docs.select("doc_id", "text").collect()
        encoded = pieces.encode(docs, vocabulary, most_units).persist()
        got = sorted((r.doc_id or 0, r.ids) for r in encoded.collect())
        assert got == sorted((r.doc_id or 0, library.encode(r.text or "")) for r in rows)
        decoded = sorted((r.doc_id or 0, r.text) for r in pieces.decode(encoded, vocabulary).collect())
        # The vocabulary's sign for a space is a space when it is decoded.
        assert decoded == sorted((r.doc_id or 0, (r.text or "").replace(pieces.SPACE, " ")) for r in rows)
    assert pieces.encode(odd_docs.limit(0), vocabulary).isEmpty()


def test_units_of_random_signs(spark):
    import sentencepiece

    library, vocabulary = sentencepiece.SentencePieceProcessor(model_file=PIECE), pieces.load(PIECE)
    rng = random.Random(1)
    texts = ["".join(rng.choice(" aeinrst.,'-_()=/*#09Zé²½日\n") for _ in range(rng.randint(1, 60))) for _ in range(400)]
    # Long units: their borders take several longs. Long runs of spaces: pieces of equal scores.
    texts += ["".join(rng.choice("aeinrst") for _ in range(n)) for n in (61, 62, 63, 64, 95, 96, 97, 500, 3000)]
    texts += [c * n for c in "=- x日" for n in (7, 61, 62, 63, 64, 65, 1000)] + ["a" + " " * n + "b" for n in range(2, 70)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.ids for r in pieces.encode(docs, vocabulary).collect()}
    assert got == {i: library.encode(t) for i, t in enumerate(texts)}


def test_viterbi_finds_the_best_path(spark):
    scores = {"▁": -3.0, "a": -2.0, "b": -2.5, "ab": -3.0, "▁a": -4.0, "aba": -7.5, "ba": -3.5, "▁ab": -6.0}
    names = ["<unk>", *scores]
    vocabulary = pieces.Vocabulary("", "unigram", names, [0.0, *scores.values()], [False, *[True] * len(scores)], 0, -1, 3, False, True)

    def best(word):
        paths = {0: (0.0, [])}
        for end in range(1, len(word) + 1):
            options = []
            for start in range(max(0, end - 3), end):
                piece = word[start:end]
                if piece in scores:
                    options.append((paths[start][0] + scores[piece], [*paths[start][1], names.index(piece)]))
                elif end - start == 1:
                    options.append((paths[start][0] - 1e12, [*paths[start][1], 0]))
            # Of equal sums the one whose last piece scores best.
            paths[end] = max(options, key=lambda o: (o[0], -1e12 if o[1][-1] == 0 else scores[names[o[1][-1]]]))
        return paths[len(word)][1]

    words = ["▁", "▁ab", "▁aba", "abab", "▁abc", "bbbb", "▁aabba"]
    units = spark.createDataFrame([(w,) for w in words], "unit string")
    got = {r.unit: r.ids for r in pieces.encode_units(units, vocabulary).collect()}
    assert got == {w: best(w) for w in words}


def test_wrong_decoding_is_seen(spark, monkeypatch):
    """Of the right length, too: the size alone doesn't tell."""
    texts = [(1, "abc def"), (2, f"abc{pieces.SPACE}def"), (3, None), (4, ""), (5, "a plain line"), (5, "a plain line")]
    docs, vocabulary = spark.createDataFrame(texts, "doc_id long, text string"), pieces.load(PIECE)
    got = sorted((r.doc_id, r.decoded_equal) for r in pieces.encoded_digests(docs, vocabulary).collect())
    assert got == [(1, True), (2, False), (3, True), (4, True), (5, True), (5, True)]
    maker = pieces.make_decoder(vocabulary)

    def wrong():
        decode = maker()
        return lambda ids: decode(ids).replace(b"c", b"x")

    monkeypatch.setattr(pieces, "make_decoder", lambda _: wrong)
    rows = pieces.encoded_digests(docs, vocabulary).collect()
    assert {r.doc_id: (r.text_bytes == r.n_bytes, r.decoded_equal) for r in rows if r.doc_id in (1, 5)} == {1: (True, False), 5: (True, True)}
