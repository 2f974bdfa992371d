"""Links of texts by the exact Jaccard similarity of their word shingles.

Texts meet as candidates if they agree in all ``ROWS`` min-hashes of at least one
of ``BANDS`` bands: of texts of similarity 0.8 a pair is missed with probability
(1 - 0.8^4)^30, 1.4e-7, of more similar ones less often. Candidates hang on the
smallest text of their bin, so that bins make rows, not pairs. What hangs together
is compared in blocks by whole shingle sets, each shipped once a block pair, and
leaves one row for each text that is linked.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, stored, texts
from .components import components

SHINGLE = 5
SEED = 42
ROWS, BANDS = 4, 30
#: Texts that hang together and are compared with each other in one task; more are dealt out by pairs of blocks.
BLOCK = 1024
#: Shingles that are min-hashed at a time.
_HASHES = 1 << 12
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(32)


def make_shingles(size: int = SHINGLE) -> Callable[[str], np.ndarray]:
    """The function from a text to the distinct hashes of its word shingles,
    ascending; a text of fewer words is one shingle, one without words none."""
    from xxhash import xxh64_intdigest

    from .simhash import _WORD

    powers = [np.uint64(pow(0xD6E8FEB86659FD93, i, 1 << 64)) for i in range(1, size + 1)]

    def shingles(text: str) -> np.ndarray:
        words = _WORD.findall(text.encode().lower())
        hashes = np.fromiter((xxh64_intdigest(w, SEED) for w in words), np.uint64, len(words))
        k = min(size, len(words))
        if not k:
            return hashes
        out = np.full(len(words) - k + 1, k, np.uint64)
        for i in range(k):
            out += hashes[i : i + len(out)] * powers[i]
        return np.unique((out ^ (out >> _SHIFT)) * _MIX)

    return shingles


def make_sketch() -> Callable[[np.ndarray], np.ndarray]:
    """The function from shingles to the keys of their bands; none without shingles."""
    rng = np.random.default_rng(SEED)
    flips, factors = rng.integers(0, 1 << 64, (2, ROWS * BANDS, 1), np.uint64)
    factors |= np.uint64(1)
    weights = rng.integers(0, 1 << 64, (BANDS, ROWS), np.uint64) | np.uint64(1)

    def sketch(shingles: np.ndarray) -> np.ndarray:
        if not len(shingles):
            return np.zeros(0, np.int64)
        parts = [((shingles[at : at + _HASHES] ^ flips) * factors).min(axis=1) for at in range(0, len(shingles), _HASHES)]
        least = np.min(parts, axis=0).reshape(BANDS, ROWS)
        least = (least ^ (least >> _SHIFT)) * weights
        return least.sum(axis=1, dtype=np.uint64).view(np.int64)

    return sketch


def connect(fps: np.ndarray, sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Texts whose links of at least ``similarity`` connect them with one of another fp, and that fp."""
    lengths = np.array([len(s) for s in sets], np.int64)
    starts = np.cumsum(lengths) - lengths
    _, shingles = np.unique(np.concatenate(sets), return_inverse=True)
    marked = np.zeros(len(shingles), bool)
    left = np.arange(len(sets))
    a, b = [], []
    while len(left) > 1:
        start, left = left[0], left[1:]
        front = [start]
        while front and len(left):
            x = front.pop()
            mine = shingles[starts[x] : starts[x] + lengths[x]]
            fits = np.minimum(lengths[left], lengths[x]) >= similarity * np.maximum(lengths[left], lengths[x]) - 1e-9
            others = left[fits]
            if not len(others):
                continue
            n = lengths[others]
            ends = np.cumsum(n)
            marked[mine] = True
            shared = np.add.reduceat(marked[shingles[np.repeat(starts[others] - ends + n, n) + np.arange(ends[-1])]], ends - n, dtype=np.int64)
            marked[mine] = False
            near = others[shared >= similarity * (n + lengths[x] - shared) - 1e-9]
            if len(near):
                front += near.tolist()
                a.append(fps[near])
                b.append(np.full(len(near), fps[start]))
                left = np.setdiff1d(left, near, assume_unique=True)
    if not a:
        return fps[:0], fps[:0]
    x, y = np.concatenate(a), np.concatenate(b)
    return x[x != y], y[x != y]


def _candidates(rows: DataFrame) -> DataFrame:
    """node, root: texts, by their hashes, that hang together by bins, and the smallest of them."""

    def make() -> Callable[..., Iterable[tuple]]:
        shingles, sketch = make_shingles(), make_sketch()
        return lambda text_hash, text: [(text_hash, sketch(shingles(text)).tolist())]

    sketches = stored(map_rows(rows, make, "text_hash long, keys array<long>").dropDuplicates(["text_hash"]), "sketches")
    bins = sketches.select("text_hash", F.explode("keys").alias("key"))
    shared = bins.groupBy("key").agg(F.min("text_hash").alias("least"), F.max("text_hash").alias("most")).where("least < most").select("key", "least")
    roots = components(bins.join(shared, "key").where("text_hash > least").select("text_hash", "least"), "candidates")
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def _dealt(rows: DataFrame) -> DataFrame:
    """root, b1, b2, fp and shingles (their bytes) of each candidate in each pair of blocks that it is compared in."""
    members = _candidates(rows)
    large = members.groupBy("root").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).where("blocks > 1")
    members = members.join(large, "root", "left").select("node", "root", F.coalesce("blocks", F.lit(1)).alias("blocks"))
    once = rows.groupBy("text_hash").agg(F.first("text").alias("text"))
    wanted = once.join(members, F.col("text_hash") == F.col("node")).select("root", F.pmod(F.xxhash64(F.lit(7), "node"), "blocks").cast("int").alias("own"), "blocks", "text")

    def make() -> Callable[..., Iterable[tuple]]:
        from .simhash import make_fingerprint

        shingles, fingerprint = make_shingles(), make_fingerprint()

        def each(root, own, blocks, text):
            fp = fingerprint(text)
            yield root, own, blocks, fp - (1 << 64) if fp >> 63 else fp, shingles(text).tobytes()

        return each

    sets = map_rows(wanted, make, "root long, own int, blocks int, fp long, shingles binary")
    both = sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return both.select("root", F.least("own", "other").alias("b1"), F.greatest("own", "other").alias("b2"), "fp", "shingles")


def links(docs: DataFrame, similarity: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """a and b: SimHash fingerprints, such that following them reaches what following
    all candidate pairs of at least ``similarity`` reaches."""
    rows = texts(docs, id_col, text_col).select(F.xxhash64("text").alias("text_hash"), "text")
    ordered = _dealt(rows).repartition("root", "b1", "b2").sortWithinPartitions("root", "b1", "b2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: tuple | None = None
        fps: list[int] = []
        sets: list[np.ndarray] = []
        a: list[np.ndarray] = []
        b: list[np.ndarray] = []

        def close() -> None:
            if len(sets) > 1:
                x, y = connect(np.array(fps, np.int64), sets, similarity)
                a.append(x)
                b.append(y)

        for batch in batches:
            for root, b1, b2, fp, shingles in zip(*(c.to_pylist() for c in batch.columns)):
                if (root, b1, b2) != key:
                    close()
                    key, fps, sets = (root, b1, b2), [], []
                fps.append(fp)
                sets.append(np.frombuffer(shingles, np.uint64))
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])
                a.clear()
                b.clear()
        close()
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    return ordered.mapInArrow(run, "a long, b long").distinct()
