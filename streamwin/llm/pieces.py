"""SentencePiece encoding and decoding over a relational lattice.

Text becomes units: words with their leading spaces, runs of signs, digits. No
piece of the vocabulary reaches over the border of two units (checked when it is
loaded), so each distinct unit is encoded once. Its lattice is relational: the
substrings of the lengths that pieces with the same first two characters have are
exploded, joined to the piece table on their text, and the edges grouped by unit
again. A fold with Spark's higher-order aggregate then picks the path:

- unigram models: Viterbi, the path of the greatest summed score, of equal ones
  that whose last piece scores best;
- byte-pair models, where a score is the rank of a merge and a sum of ranks
  means nothing: the merges themselves. The fold goes through the edges once,
  best rank first, then from left to right, and takes each that joins two neighbouring
  symbols. That is what the library does (``load`` checks that no merge can
  enable a better-ranked one), and Viterbi would give other ids.

Characters without a piece are written as bytes if the model has byte pieces, or
else as the unknown piece. A unit of more than 131,071 characters (one run of
letters or signs without a space or digit) is encoded by the library itself.

Ids go back to documents by blocks (``blocks.py``).

Null and empty texts have no ids; decoding gives the text back. Repeated rows are
encoded each, further columns are not looked at, an empty table gives no rows.
U+2581, the sign for a space in pieces, decodes to a space: texts that hold it
don't come back as they were.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import LONGEST_KEY, MOST_UNITS, Ragged, as_bytes, distinct_units, joined_values, make_blocks, ragged, with_values
from .common import forget, map_rows, stored, texts

#: The sign that stands for a space in pieces.
SPACE = "▁"
# An edge is a long: rank (20 bits), end (17), characters (5), id (20), so that
# edges sort by rank, then from left to right.
_CHARS, _END, _RANK = 20, 25, 42
#: Stands for an id where a character has no piece.
NO_PIECE = (1 << 20) - 1
#: Characters of the longest unit with a lattice, and of the longest piece.
MOST_CHARS, LONGEST_PIECE = (1 << 17) - 1, 31


@dataclass
class Vocabulary:
    path: str
    kind: str  # unigram or bpe
    pieces: list[str]
    scores: list[float]
    normal: list[bool]
    unknown: int
    bytes_at: int  # id of the piece for byte 0, or -1
    longest: int
    fine: bool  # whether units can be split at the borders of words and signs
    dummy_prefix: bool


def _unit_pattern(fine: bool) -> re.Pattern:
    if not fine:
        return re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
    # Letters as str.isalpha has them: re's classes would take other numbers along.
    word = re.compile(r"[^\W\d_]")
    odd = "".join(re.escape(c) for c in map(chr, range(0x110000)) if word.match(c) and not c.isalpha())
    letter, sign = rf"[^\W\d_{odd}]", rf"(?:[\W_{odd}](?<!{SPACE}))"
    return re.compile(rf"{SPACE}+(?:{letter}+|{sign}+)?|{letter}+|\d?{sign}+|\d")


# Up to U+017F the same units, from classes small enough to be tested quickly.
_PLAIN = re.compile(r"[^\x00-ſ]")
_WORD, _SIGN = "a-zA-ZªµºÀ-ÖØ-öø-ſ", f"[^a-zA-ZªµºÀ-ÖØ-öø-ſ0-9{SPACE}]"
_PLAIN_UNITS = re.compile(rf"{SPACE}+(?:[{_WORD}]+|{_SIGN}+)?|[{_WORD}]+|[0-9]?{_SIGN}+|[0-9]")


def load(path: str) -> Vocabulary:
    """The vocabulary of a .model file that changes nothing but spaces."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    spec = model.normalizer_spec
    if spec.precompiled_charsmap or spec.remove_extra_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
        raise ValueError("only models with the identity normaliser are supported")
    kinds = {1: "unigram", 2: "bpe"}
    if model.trainer_spec.model_type not in kinds:
        raise ValueError("only unigram and BPE models are supported")
    pieces = [p.piece for p in model.pieces]
    normal = [p.type in (1, 4) for p in model.pieces]
    if len(pieces) > NO_PIECE or max(len(p) for p, n in zip(pieces, normal) if n) > LONGEST_PIECE:
        raise ValueError(f"only models of less than {NO_PIECE} pieces of at most {LONGEST_PIECE} characters are supported")
    if kinds[model.trainer_spec.model_type] == "bpe":
        _check_merges({p.piece: -p.score for p, n in zip(model.pieces, normal) if n})
    found = _unit_pattern(True)
    return Vocabulary(
        path,
        kinds[model.trainer_spec.model_type],
        pieces,
        [p.score for p in model.pieces],
        normal,
        next(i for i, p in enumerate(model.pieces) if p.type == 2),
        pieces.index("<0x00>") if model.trainer_spec.byte_fallback else -1,
        max(len(p) for p, n in zip(pieces, normal) if n),
        all(found.findall(p) == [p] for p, n in zip(pieces, normal) if n),
        spec.add_dummy_prefix,
    )


def _check_merges(rank: dict[str, float]) -> None:
    """Whether one pass over edges, by rank and end, makes all merges in order.

    It does if no inner merge of a piece, of its text taken alone, is of worse rank
    than its own. Those of the same rank end where it does or before, and are shorter.
    """
    for piece, own in rank.items():
        symbols = list(piece)
        while len(symbols) > 2:
            best = min(((r, i) for i in range(len(symbols) - 1) if (r := rank.get(symbols[i] + symbols[i + 1])) is not None), default=None)
            if best is None:
                break
            if best[0] > own:
                raise ValueError(f"merges inside the piece {piece!r} are of worse rank than its own")
            symbols[best[1] : best[1] + 2] = [symbols[best[1]] + symbols[best[1] + 1]]


def make_splitter(vocabulary: Vocabulary) -> Callable[[], Callable[[str], list[str]]]:
    fine, prefix = vocabulary.fine, SPACE if vocabulary.dummy_prefix else ""

    def make() -> Callable[[str], list[str]]:
        units, plain, odd = _unit_pattern(fine).findall, _PLAIN_UNITS.findall, _PLAIN.search

        def split(text: str) -> list[str]:
            if not text:
                return []
            if fine and not odd(text):
                return plain(prefix + text.replace(" ", SPACE))
            return units(prefix + text.replace(" ", SPACE))

        return split

    return make


def piece_table(spark: SparkSession, vocabulary: Vocabulary) -> DataFrame:
    """piece, code (rank of the score, best first, equal scores alike; characters and id) and score."""
    ranks = {s: i for i, s in enumerate(sorted({s for s, n in zip(vocabulary.scores, vocabulary.normal) if n}, reverse=True))}
    rows = [(p, ranks[s] << _RANK | len(p) << _CHARS | i, float(s)) for i, (p, s, n) in enumerate(zip(vocabulary.pieces, vocabulary.scores, vocabulary.normal)) if n]
    return spark.createDataFrame(rows, "piece string, code long, score double")


def head_table(spark: SparkSession, vocabulary: Vocabulary) -> DataFrame:
    """head, the first two characters of pieces, and sizes, the numbers of characters of pieces that begin so."""
    sizes: dict[str, set[int]] = {}
    for p, n in zip(vocabulary.pieces, vocabulary.normal):
        if n and len(p) > 1:
            sizes.setdefault(p[:2], set()).add(len(p))
    return spark.createDataFrame([(h, sorted(x)) for h, x in sizes.items()], "head string, sizes array<int>")


def _lattice(units: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """key, unit and edges, in order, of ``units`` (key, unit) dealt by key. Every
    single character has an edge, of id NO_PIECE if there is no such piece; edges
    are longs, or for unigram models (start, end, id, score). A long unit is in
    one of its rows only, so that it isn't copied with each."""
    spark = units.sparkSession
    starts = units.withColumn("start", F.explode(F.expr("sequence(0, length(unit) - 1)")))
    starts = starts.withColumn("rest", F.expr(f"substring(unit, start + 1, {vocabulary.longest})"))
    # Both tables are those of one vocabulary file.
    heads = starts.withColumn("head", F.expr("substring(rest, 1, 2)")).join(F.broadcast(head_table(spark, vocabulary)), "head", "left")
    spans = heads.withColumn("chars", F.explode(F.expr("concat(array(1), coalesce(sizes, cast(array() as array<int>)))"))).where("chars <= length(rest)")
    spans = spans.withColumn("piece", F.expr("substring(rest, 1, chars)"))
    edges = spans.join(F.broadcast(piece_table(spark, vocabulary)), "piece", "left").where("code is not null or chars = 1")
    code = F.coalesce("code", F.lit(((1 << 20) - 1) << _RANK | 1 << _CHARS | NO_PIECE))
    if vocabulary.kind == "bpe":
        edge = code + F.shiftleft((F.col("start") + F.col("chars")).cast("long"), _END)
    else:
        id = code.bitwiseAND(F.lit(NO_PIECE)).cast("int").alias("id")
        edge = F.struct(F.shiftright(code, _RANK).alias("rank"), "start", (F.col("start") + F.col("chars")).alias("end"), id, F.coalesce("score", F.lit(-1e12)).alias("score"))
    once = F.when((F.col("start") == 0) & (F.col("chars") == 1), F.col("unit"))
    rows = edges.select("key", once.alias("unit"), edge.alias("edge"))
    return rows.groupBy("key").agg(F.first("unit", ignorenulls=True).alias("unit"), F.sort_array(F.collect_list("edge")).alias("edges"))


# The borders between a unit's symbols are bits, all set at first: of one long, or
# of longs of 32 bits each for units of more than LONGEST_KEY characters. `seen` is the bits from an edge's start
# to its end: an edge joins two neighbours if both its ends are borders and just
# one lies between, and is a symbol if none does.
_C = f"cast(shiftright(e, {_CHARS}) & 31L as int)"
_S = f"cast((shiftright(e, {_END}) & {MOST_CHARS}L) - (shiftright(e, {_CHARS}) & 31L) as int)"
_WIDE = f"filter(edges, e -> (e & {31 << _CHARS}L) > {1 << _CHARS}L)"
_WORD = f"cast({_S} div 32 as int)"
_SEEN = {
    "short": f"(shiftrightunsigned(m, {_S}) & (shiftleft(2L, {_C}) - 1L))",
    "long": f"(shiftrightunsigned(m[{_WORD}] | shiftleft(m[{_WORD} + 1], 32), {_S} % 32) & (shiftleft(2L, {_C}) - 1L))",
}
_FULL = {
    "short": "shiftleft(1L, length(unit) + 1) - 1L",
    "long": "transform(sequence(0, cast(length(unit) div 32 as int) + 1), i -> 4294967295L)",
}
_BIT = f"shiftleft({_SEEN['long']} & (shiftleft(1L, {_C}) - 2L), {_S} % 32)"
_JOINED = {
    "short": f"m & ~shiftleft(shiftleft(1L, {_C}) - 2L, {_S})",
    "long": f"concat(slice(m, 1, {_WORD}), array(m[{_WORD}] & ~({_BIT} & 4294967295L), m[{_WORD} + 1] & ~shiftrightunsigned({_BIT}, 32)), slice(m, {_WORD} + 3, size(m)))",
}


def _merge_path(size: str) -> str:
    """The edges of a byte-pair path, from left to right."""
    seen, ends = _SEEN[size], f"(1L | shiftleft(1L, {_C}))"
    fold = f"aggregate({_WIDE}, {_FULL[size]}, (m, e) -> if(bit_count({seen}) = 3 AND ({seen} & {ends}) = {ends}, {_JOINED[size]}, m))"
    # The fold's result is bound to a name, else it would be made for each edge.
    return f"transform(array({fold}), m -> sort_array(transform(filter(edges, e -> {seen} = {ends}), e -> e & {(1 << _RANK) - 1}L)))[0]"


_VITERBI_PATH = """aggregate(
    sequence(1, length(unit)),
    array(named_struct('score', 0D, 'path', cast(array() as array<struct<start:int,id:int>>))),
    (acc, t) -> concat(acc, array(aggregate(
        filter(edges, e -> e.end = t),
        named_struct('score', -1e300D, 'path', cast(array() as array<struct<start:int,id:int>>)),
        (best, e) -> if(acc[e.start].score + e.score > best.score,
            named_struct('score', acc[e.start].score + e.score, 'path', concat(acc[e.start].path, array(named_struct('start', e.start, 'id', e.id)))),
            best)))),
    acc -> acc[length(unit)].path)"""


def encode_units(units: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """key, unit and ids, the pieces, of each distinct unit of ``units`` (unit)."""
    long = F.length("unit") > MOST_CHARS
    lattice = _lattice(distinct_units(units.where(~long)), vocabulary)
    if vocabulary.kind == "bpe":
        path = lattice.withColumn("path", F.when(F.length("unit") <= LONGEST_KEY, F.expr(_merge_path("short"))).otherwise(F.expr(_merge_path("long"))))
        start, id = f"cast(shiftright(e, {_END}) - 1 as int)", f"cast(e & {NO_PIECE}L as int)"  # read for single characters only
    else:
        path = lattice.withColumn("path", F.expr(_VITERBI_PATH))
        start, id = "e.start", "e.id"
    if vocabulary.bytes_at >= 0:
        code = f"hex(encode(substring(unit, {start} + 1, 1), 'UTF-8'))"
        spelled = f"transform(array({code}), h -> transform(sequence(1, length(h), 2), i -> cast(conv(substring(h, i, 2), 16, 10) as int) + {vocabulary.bytes_at}))[0]"
    else:
        spelled = f"array({vocabulary.unknown})"
    plain = F.expr(f"transform(path, e -> {id})")
    ids = F.when(F.array_contains(plain, NO_PIECE), F.expr(f"flatten(transform(path, e -> if({id} = {NO_PIECE}, {spelled}, array({id}))))")).otherwise(plain)
    encoded = path.select("key", "unit", ids.alias("ids"))
    return encoded.unionByName(_by_library(distinct_units(units.where(long)), vocabulary)) if vocabulary.path else encoded


def _by_library(units: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    path = vocabulary.path

    def make() -> Callable[..., Iterable[tuple]]:
        library = None  # loaded for the first unit: most tasks have none

        def each(key, unit):
            nonlocal library
            if library is None:
                from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

                model = sentencepiece_model_pb2.ModelProto()
                with open(path, "rb") as f:
                    model.ParseFromString(f.read())
                model.normalizer_spec.add_dummy_prefix = False
                library = SentencePieceProcessor(model_proto=model.SerializeToString())
            yield key, unit, library.encode(unit)

        return each

    return map_rows(units, make, "key string, unit string, ids array<int>")


def _encoded(docs: DataFrame, vocabulary: Vocabulary, most_units: int, columns: Callable[..., list[pa.Array]], schema: T.StructType, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``schema`` by ``columns(head, ids)``, given groups of documents and their ids."""
    units, documents = make_blocks(texts(docs, id_col, text_col), make_splitter(vocabulary), most_units)
    width = 2 if len(vocabulary.pieces) <= 1 << 16 else 4
    known = stored(encode_units(units, vocabulary).select("key", as_bytes("ids", width).alias("value")), "units")
    found = joined_values(units, known)
    forget(known)
    forget(units)

    def each(values: Ragged, head: pa.RecordBatch, numbers: np.ndarray, times: np.ndarray) -> list[pa.Array]:
        ends = np.concatenate([[0], np.cumsum(values.sizes[numbers])])[np.cumsum(head.column("n_units").to_numpy())]
        return columns(head, pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(values.take(numbers), pa.int32())))

    return with_values(documents, found, partial(ragged, width=width), each, schema)


def _schema(docs: DataFrame, id_col: str, columns: str) -> T.StructType:
    return T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), *T._parse_datatype_string(columns)])


def encode(docs: DataFrame, vocabulary: Vocabulary, most_units: int = MOST_UNITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_units, ids and crc32 (of the text) of each row of ``docs``."""
    schema = _schema(docs, id_col, "n_bytes long, n_units long, ids array<int>, crc32 long")

    def columns(head: pa.RecordBatch, ids: pa.Array) -> list[pa.Array]:
        return [*head.columns[:3], ids, head.column("crc32")]

    return _encoded(docs, vocabulary, most_units, columns, schema, id_col, text_col)


def make_decoder(vocabulary: Vocabulary) -> Callable[[], Callable[[np.ndarray], bytes]]:
    """A maker of the function from ids to UTF-8. What bytes' pieces make of no character decodes to U+FFFD."""
    pieces, first, prefix = vocabulary.pieces, vocabulary.bytes_at, vocabulary.dummy_prefix
    normal, unknown = vocabulary.normal, vocabulary.unknown

    def make() -> Callable[[np.ndarray], bytes]:
        raw = [p.replace(SPACE, " ").encode() if n else b"" for p, n in zip(pieces, normal)]
        raw[unknown] = " ⁇ ".encode()
        if first >= 0:
            raw[first : first + 256] = [bytes([i]) for i in range(256)]
        table = Ragged(np.frombuffer(b"".join(raw), np.uint8), np.array([len(r) for r in raw], np.int64))

        def decode(ids: np.ndarray) -> bytes:
            text = table.take(ids.astype(np.int64)).tobytes() if len(ids) else b""
            text = text[1:] if prefix and text.startswith(b" ") else text
            return text.decode("utf-8", "replace").encode()

        return decode

    return make


def decode(encoded: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text of each row of ids; null ids count as none."""
    maker = make_decoder(vocabulary)

    def make() -> Callable[..., Iterable[tuple]]:
        text = maker()
        return lambda doc_id, ids: [(doc_id, text(np.array(ids or [], np.int64)).decode())]

    kind = encoded.schema[id_col].dataType.simpleString()
    return map_rows(encoded.select(id_col, ids_col), make, f"doc_id {kind}, text string")


def encoded_digests(docs: DataFrame, vocabulary: Vocabulary, most_units: int = MOST_UNITS) -> DataFrame:
    """doc_id, n_bytes, n_units, n_tokens, ids, and of the decoded ids: text_bytes
    and text_crc32, and decoded_equal, whether they are those of the text that was encoded."""
    maker = make_decoder(vocabulary)
    decoders: list[Callable[[np.ndarray], bytes]] = []

    def columns(head: pa.RecordBatch, ids: pa.Array) -> list[pa.Array]:
        import zlib

        import pyarrow.compute as pc

        if not decoders:
            decoders.append(maker())
        values, cuts = ids.values.to_numpy(), ids.offsets.to_numpy()
        decoded = [decoders[0](values[lo:hi]) for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
        sizes, checks = (pa.array([f(x) for x in decoded], pa.int64()) for f in (len, zlib.crc32))
        equal = pc.and_(pc.equal(sizes, head.column("n_bytes")), pc.equal(checks, head.column("crc32")))
        return [*head.columns[:3], pa.array(np.diff(cuts), pa.int64()), ids, sizes, checks, equal]

    schema = _schema(docs, "doc_id", "n_bytes long, n_units long, n_tokens long, ids array<int>, text_bytes long, text_crc32 long, decoded_equal boolean")
    return _encoded(docs, vocabulary, most_units, columns, schema)
