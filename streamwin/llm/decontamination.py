"""Benchmark decontamination by winnowing, with DataFrame functions only.

A window is ``WINDOW`` consecutive words. Of the hashes of the k-grams in each
window the smallest is kept, the rightmost of equal ones (Schleimer et al.,
2003): what is kept depends on the window's words alone, so equal windows of a
document and an item keep the same k-gram at the same place, and an equi-join on
kept hashes meets every shared window. Each meeting is then extended word by
word to the windows around it, which drops chance meetings of hashes.

An item of fewer words than a window is one window of its own length; for each
such length (at most WINDOW - 1 of them) documents bring all their runs of that
many words, and the same join is exact.

Null texts have no words; items without words or id match nothing. Items of
equal words are joined as one. Rows of equal id and text stay separate rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import texts

#: Words of a window and of a k-gram. WINDOW - GRAM + 1 hashes are winnowed to one.
WINDOW, GRAM = 8, 5
#: Benchmark fingerprints that are broadcast, at most; beyond it the join is shuffled.
MOST_BROADCAST = 200_000

_SPAN = WINDOW - GRAM + 1
_LOW = (1 << 31) - 1

# Words are runs of digits, a-z and whatever isn't ASCII, A-Z lowered: one
# translation makes all other ASCII signs spaces.
_UPPER = "".join(map(chr, range(65, 91)))
_OTHER = "".join(chr(i) for i in range(128) if not chr(i).isalnum())


def words(text: Column) -> Column:
    spaced = F.trim(F.translate(F.coalesce(text, F.lit("")), _UPPER + _OTHER, _UPPER.lower() + " " * len(_OTHER)))
    return F.when(spaced == "", F.array().cast("array<string>")).otherwise(F.split(spaced, " +"))


def _fingerprints(lengths: list[int]) -> Column:
    """SQL over ``words``: [(chars, hash, place, before, around)], the kept k-grams
    and, for each of ``lengths``, every run of so many words.

    A kept k-gram is its hash's upper bits, above the place counted from the
    right: the smallest number is the smallest hash, of equal ones the rightmost.
    around: the words of all windows that can hold the k-gram; before: how many
    of them stand before it.
    """
    grams = f"transform(sequence(0, n_words - {GRAM}), i -> (xxhash64(slice(words, i + 1, {GRAM})) & ~{_LOW}L) | ({_LOW}L - i))"
    kept = f"""if(n_words >= {WINDOW},
        transform(array({grams}), g -> array_distinct(transform(sequence(1, n_words - {WINDOW - 1}), i -> array_min(slice(g, i, {_SPAN})))))[0],
        cast(array() as array<bigint>))"""
    place = f"cast({_LOW}L - (v & {_LOW}L) as int)"
    entry = f"""transform({kept}, v -> named_struct(
        'size', {WINDOW}, 'hash', shiftright(v, 31), 'place', {place}, 'before', least({place}, {_SPAN - 1}),
        'around', slice(words, greatest({place} - {_SPAN - 1}, 0) + 1, least({place}, {_SPAN - 1}) + {GRAM + _SPAN - 1})))"""
    runs = [
        f"""if(n_words >= {k}, transform(sequence(0, n_words - {k}), i -> named_struct(
        'size', {k}, 'hash', xxhash64(slice(words, i + 1, {k})), 'place', i, 'before', 0, 'around', slice(words, i + 1, {k}))), null)"""
        for k in lengths
    ]
    empty = "cast(array() as array<struct<size:int,hash:bigint,place:int,before:int,around:array<string>>>)"
    return F.expr(f"concat({', '.join([entry, *(f'coalesce({r}, {empty})' for r in runs)])})")


def benchmark_fingerprints(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> tuple[DataFrame, list[int]]:
    """i_size, i_hash, i_before, i_around and i_ids of the items' fingerprints, and the lengths of items shorter than a window."""
    items = benchmark.select(F.col(f"`{id_col}`").cast("string").alias("id"), words(F.col(f"`{text_col}`")).alias("words")).where(F.col("id").isNotNull() & (F.size("words") > 0))
    items = items.groupBy("words").agg(F.array_sort(F.collect_set("id")).alias("i_ids")).withColumn("n_words", F.size("words"))
    lengths = sorted(r[0] for r in items.where(F.col("n_words") < WINDOW).select("n_words").distinct().collect())
    whole = items.where(F.col("n_words") >= WINDOW).withColumn("f", F.explode(_fingerprints([])))
    short = items.where(F.col("n_words") < WINDOW).select(
        "i_ids",
        F.struct(F.col("n_words").alias("size"), F.expr("xxhash64(slice(words, 1, n_words))").alias("hash"), F.lit(0).alias("place"), F.lit(0).alias("before"), F.col("words").alias("around")).alias("f"),
    )
    both = whole.select("i_ids", "f").unionByName(short)
    return both.select(F.col("f.size").alias("i_size"), F.col("f.hash").alias("i_hash"), F.col("f.before").alias("i_before"), F.col("f.around").alias("i_around"), "i_ids").distinct(), lengths


def contamination(docs: DataFrame, benchmark: DataFrame, least_items: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, n_words, n_hit (words inside shared windows), items (their
    ids, sorted), n_items and contaminated (at least ``least_items`` items) of each row."""
    known, lengths = benchmark_fingerprints(benchmark)
    if known.select("i_hash").limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:
        known = F.broadcast(known)
    rows = texts(docs, id_col, text_col, key=True).select("row_key", "doc_id", F.xxhash64("text").alias("text_hash"), words(F.col("text")).alias("words"))
    rows = rows.withColumn("n_words", F.size("words"))
    # Every row also brings an entry that meets nothing, so that none is lost.
    nothing = F.expr("array(named_struct('size', 0, 'hash', 0L, 'place', -1, 'before', 0, 'around', cast(null as array<string>)))")
    entries = rows.select("row_key", "doc_id", "text_hash", "n_words", F.explode(F.concat(nothing, _fingerprints(lengths))).alias("f"))
    entries = entries.select("row_key", "doc_id", "text_hash", "n_words", "f.*")
    met = entries.join(known, (F.col("size") == F.col("i_size")) & (F.col("hash") == F.col("i_hash")), "left").where("i_hash is not null or place = -1")
    # Windows that begin j words before the meeting and have equal words.
    shared = F.expr(f"""filter(sequence(0, if(size = {WINDOW}, {_SPAN - 1}, 0)), j ->
        before >= j AND i_before >= j AND before - j + size <= size(around) AND i_before - j + size <= size(i_around)
        AND slice(around, before - j + 1, size) = slice(i_around, i_before - j + 1, size))""")
    met = met.withColumn("windows", F.when(F.col("place") >= 0, F.transform(shared, lambda j: F.struct((F.col("place") - j).alias("start"), F.col("size").alias("size")))))
    met = met.where("place = -1 or size(windows) > 0")
    found = met.groupBy("row_key").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("text_hash").alias("text_hash"),
        F.first("n_words").cast("long").alias("n_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("windows")))).alias("windows"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("i_ids")))).alias("items"),
    )
    covered = F.expr("""aggregate(windows, named_struct('end', 0, 'n', 0L),
        (a, w) -> named_struct('end', greatest(a.end, w.start + w.size), 'n', a.n + greatest(0, w.start + w.size - greatest(a.end, w.start))),
        a -> a.n)""")
    n_items = F.size("items").cast("long")
    return found.select("doc_id", "text_hash", "n_words", covered.alias("n_hit"), "items", n_items.alias("n_items"), (n_items >= least_items).alias("contaminated"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, least_items: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that aren't contaminated."""
    bad = contamination(docs, benchmark, least_items, id_col, text_col).where("contaminated").select(F.col("doc_id").alias("bad_id"), F.col("text_hash").alias("bad_hash")).distinct()
    text_hash = F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    return docs.join(bad, docs[f"`{id_col}`"].eqNullSafe(bad["bad_id"]) & (text_hash == bad["bad_hash"]), "left_anti")
