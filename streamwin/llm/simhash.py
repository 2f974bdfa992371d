"""Near-duplicates by SimHash and generalised pigeonhole.

The 64 bits are grouped into partitions, correlated bits together. If the
partitions' thresholds add up to tau - m + 1 (-1: a partition is not used), two
fingerprints within tau bits are within its threshold in at least one of the m
partitions (Qin et al., 2018). Partitions and their unequal thresholds are
chosen by dynamic programming on candidate counts that a bounded sample of
fingerprints estimates; any choice finds every pair, the sample decides on
speed only. Every distinct fingerprint is indexed under its value in each used
partition, and probes all values within that partition's threshold.

Members and probes that meet in a bin are compared there, in blocks, and leave
one row for each member that has a link: the smallest member it is connected
with inside the block. Pairs are never rows, so a large group of near copies
costs comparisons but no rows. A bin of more than ``BLOCK`` members is dealt
out by pairs of blocks.

Equal texts have equal fingerprints and are one node. Null and empty texts and
texts of white space have fingerprint 0. Rows with a null id take part, but no
component is named after them unless it has no other id.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import similar
from .common import map_rows, stored, texts
from .components import components

#: Words are runs of other bytes than ASCII white space.
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SEED = 42
SHINGLE = 4
TAU = 4
#: Shingles whose bits are counted at a time.
_HASHES = 1 << 15
#: Members of a bin that are compared with each other in one task.
BLOCK = 2048
#: Fingerprints from which candidate counts are estimated.
SAMPLE = 2048
#: Estimated cost of a probe's row, in comparisons.
PROBE_COST = 300.0


def make_fingerprint(shingle: int = SHINGLE, seed: int = SEED) -> Callable[[str], int]:
    from xxhash import xxh64_intdigest

    def fingerprint(text: str) -> int:
        """64 bits, each set if set in over half of the shingles' hashes; 0 without words."""
        words = _WORD.findall(text.encode().lower())
        if not words:
            return 0
        line = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        k = min(shingle, len(words))
        cuts = zip(np.concatenate([[0], ends[: len(ends) - k]]).tolist(), (ends[k - 1 :] - 1).tolist())
        hashes = np.fromiter((xxh64_intdigest(line[a:b], seed) for a, b in cuts), np.uint64, len(words) - k + 1)
        counts = np.zeros(64, np.int64)
        for at in range(0, len(hashes), _HASHES):
            counts += np.unpackbits(hashes[at : at + _HASHES].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])

    return fingerprint


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) and text_hash of each row."""

    def make() -> Callable[..., Iterable[tuple]]:
        fingerprint = make_fingerprint()

        def each(doc_id, text, text_hash):
            fp = fingerprint(text)
            yield doc_id, fp - (1 << 64) if fp >> 63 else fp, text_hash

        return each

    rows = texts(docs, id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(rows.select("doc_id", "text", F.xxhash64("text").alias("h")), make, f"doc_id {kind}, fp long, text_hash long")


def _correlations(nodes: DataFrame) -> np.ndarray:
    """Absolute correlations of the bits over all fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((65, 65), np.int64)
        for b in batches:
            fps = b.column(0).to_numpy().astype("<i8")
            bits = np.ones((len(fps), 65), np.float64)
            bits[:, :64] = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            total += (bits.T @ bits).astype(np.int64)
        i, j = np.divmod(np.arange(65 * 65), 65)
        yield pa.RecordBatch.from_arrays([pa.array(i * 65 + j, pa.int64()), pa.array(total.ravel(), pa.int64())], ["cell", "n"])

    sums = np.zeros(65 * 65)
    for cell, n in nodes.select("fp").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n")).collect():  # 65 x 65 cells
        sums[cell] = n
    sums = sums.reshape(65, 65)
    n = max(sums[64, 64], 1.0)
    mean = sums[64, :64] / n
    spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-12))
    return np.abs(sums[:64, :64] / n - np.outer(mean, mean)) / np.outer(spread, spread)


def group_bits(correlation: np.ndarray, m: int) -> list[list[int]]:
    """The bits in m groups of nearly equal size, each grown by the bit that correlates most with it."""
    free = set(range(64))
    groups = []
    for i in range(m):
        size = (64 - sum(map(len, groups))) // (m - i)
        seed = max(free, key=lambda b: (sum(correlation[b, c] for c in free if c != b), -b))
        group = [seed]
        free.remove(seed)
        while len(group) < size:
            b = max(free, key=lambda b: (sum(correlation[b, c] for c in group), -b))
            group.append(b)
            free.remove(b)
        groups.append(sorted(group))
    return groups


def allocate(groups: list[list[int]], sample: np.ndarray, n: int, tau: int = TAU) -> tuple[float, list[int]]:
    """The least estimated cost of a fingerprint, and the thresholds that give it."""
    options = []
    for group in groups:
        mask = np.uint64(sum(1 << b for b in group))
        part = sample & mask
        near = np.zeros(tau + 2)
        for at in range(0, len(part), 256):
            near += np.bincount(np.minimum(np.bitwise_count(part[at : at + 256, None] ^ part[None, :]), tau + 1).ravel(), minlength=tau + 2)
        near[0] -= len(part)
        share = np.cumsum(near) / max(1, len(part) * (len(part) - 1))
        cost = {-1: 0.0}
        probes = 0
        for t in range(tau + 1):
            probes += math.comb(len(group), t)
            cost[t] = PROBE_COST * probes + n * max(share[t], probes / 2.0 ** len(group))
        options.append(cost)
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in options:
        after: dict[int, tuple[float, list[int]]] = {}
        for total, (c, chosen) in best.items():
            for t, more in cost.items():
                if (old := after.get(total + t)) is None or c + more < old[0]:
                    after[total + t] = (c + more, [*chosen, t])
        best = after
    return best[tau - len(groups) + 1]


def plan(nodes: DataFrame, n: int, tau: int = TAU) -> list[tuple[list[int], int]]:
    """The used partitions (bits, threshold) of the cheapest choice."""
    correlation = _correlations(nodes)
    rows = nodes.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).select("fp").collect()
    sample = np.array([r[0] for r in rows], np.int64).view(np.uint64)
    choices = []
    for m in range(1, tau + 2):
        groups = group_bits(correlation, m)
        cost, thresholds = allocate(groups, sample, n, tau)
        choices.append((cost, [(g, t) for g, t in zip(groups, thresholds) if t >= 0]))
    return min(choices, key=lambda c: c[0])[1]


def _keys(nodes: DataFrame, parts: list[tuple[list[int], int]]) -> DataFrame:
    """A row for each fingerprint and bin: part, key, fp and whether it is there as a probe only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = []
        for number, (bits, t) in enumerate(parts):
            flips = [sum(1 << b for b in c) for k in range(t + 1) for c in combinations(bits, k)]
            tables.append((number, np.uint64(sum(1 << b for b in bits)), np.array(flips, np.uint64)))
        for b in batches:
            fps = b.column(0).to_numpy().view(np.uint64)
            for number, mask, flips in tables:
                step = max(1, 65536 // len(flips))
                for at in range(0, len(fps), step):
                    some = fps[at : at + step]
                    keys = ((some & mask)[:, None] ^ flips[None, :]).ravel()
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(keys), number, np.int32)),
                            pa.array(keys.view(np.int64)),
                            pa.array(np.repeat(some, len(flips)).view(np.int64)),
                            pa.array(np.tile(np.arange(len(flips)) > 0, len(some))),
                        ],
                        ["part", "key", "fp", "probe"],
                    )

    return nodes.select("fp").mapInArrow(run, "part int, key long, fp long, probe boolean")


def _dealt(keys: DataFrame) -> DataFrame:
    """``keys`` with the pair of blocks (b1 <= b2) in which rows are compared: 0, 0 but in bins over ``BLOCK``."""
    large = keys.groupBy("part", "key").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK)
    large = large.select("part", "key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64(F.lit(7), "fp"), F.coalesce("blocks", F.lit(1))).cast("int")
    others = F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)
    return (
        keys.join(large, ["part", "key"], "left")
        .withColumn("own", block)
        .withColumn("other", F.explode(others))
        .select("part", "key", F.least("own", "other").alias("b1"), F.greatest("own", "other").alias("b2"), "fp", "probe")
    )


def _connect(fps: np.ndarray, probe: np.ndarray, tau: int) -> tuple[np.ndarray, np.ndarray]:
    """Members of one block that are linked, and the smallest member each is connected with."""
    # A fingerprint can be there as a member and as a probe: probes needn't be compared with each other.
    members = np.unique(fps[~probe])
    values = np.concatenate([members, np.setdiff1d(fps[probe], members)])
    if not len(members) or len(values) < 2:
        return fps[:0], fps[:0]
    raw = values.view(np.uint64)
    near = np.zeros((len(members), len(values)), bool)
    for at in range(0, len(members), 512):
        near[at : at + 512] = np.bitwise_count(raw[at : min(at + 512, len(members)), None] ^ raw[None, :]) <= tau
    left = np.flatnonzero(near.sum(axis=1) > 1)
    seen = np.zeros(len(values), bool)
    nodes, roots = [], []
    for start in left.tolist():
        if seen[start]:
            continue
        group = np.zeros(len(values), bool)
        front = np.array([start])
        while len(front):
            reach = near[front[front < len(members)]].any(axis=0)
            outside = front[front >= len(members)]
            if len(outside):
                reach[: len(members)] |= near[:, outside].any(axis=1)
            reach &= ~group
            group |= reach
            front = np.flatnonzero(reach)
        seen |= group
        found = values[group]
        nodes.append(found)
        roots.append(np.full(len(found), found.min()))
    if not nodes:
        return fps[:0], fps[:0]
    a, b = np.concatenate(nodes), np.concatenate(roots)
    return a[a != b], b[a != b]


def _block_links(dealt: DataFrame, tau: int) -> DataFrame:
    """a and b: rows that connect what is linked, bin by bin."""
    ordered = dealt.repartition("part", "key", "b1", "b2").sortWithinPartitions("part", "key", "b1", "b2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def compare(rows: np.ndarray) -> pa.RecordBatch | None:
            """rows: whole groups, in order."""
            cuts = np.flatnonzero((rows[1:, :4] != rows[:-1, :4]).any(axis=1)) + 1
            a, b = [], []
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(rows)]):
                if hi - lo > 1:
                    x, y = _connect(rows[lo:hi, 4], rows[lo:hi, 5] == 1, tau)
                    if len(x):
                        a.append(x)
                        b.append(y)
            if a:
                return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])
            return None

        for batch in batches:
            rows = np.stack([batch.column(c).cast(pa.int64()).to_numpy(zero_copy_only=False) for c in ("part", "key", "b1", "b2", "fp", "probe")], axis=1)
            if not len(rows):
                continue
            # Groups that end in this batch; the last one may go on in the next.
            last = np.flatnonzero((rows[:, :4] != rows[-1, :4]).any(axis=1))
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut == 0 and held and (held[-1][-1, :4] == rows[-1, :4]).all():
                held.append(rows)
                continue
            if (out := compare(np.concatenate([*held, rows[:cut]]))) is not None:
                yield out
            held = [rows[cut:]]
        if held and (out := compare(np.concatenate(held))) is not None:
            yield out

    return ordered.select("part", "key", "b1", "b2", "fp", F.col("probe").cast("int").alias("probe")).mapInArrow(run, "a long, b long").distinct()


def links(nodes: DataFrame, tau: int = TAU) -> DataFrame:
    """a and b: pairs of connected fingerprints of ``nodes`` (fp, distinct), such
    that following them reaches exactly what following all pairs within ``tau``
    bits reaches."""
    n = nodes.count()
    return _block_links(_dealt(_keys(nodes, plan(nodes, n, tau))), tau)


def near_duplicates(docs: DataFrame, tau: int = TAU, id_col: str = "doc_id", text_col: str = "text", similarity: float | None = None) -> DataFrame:
    """doc_id, fp, text_hash, root (the component's smallest fingerprint) and
    component_id (the smallest id reachable) of each row. With ``similarity``,
    texts whose five-word shingles are so similar (Jaccard) are linked as well."""
    rows = stored(fingerprints(docs, id_col, text_col), "fingerprints")
    nodes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    found = links(nodes, tau)
    if similarity is not None:
        found = found.unionByName(similar.links(docs, similarity, id_col, text_col))
    roots = components(found, "links")
    rooted = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    names = rooted.join(named, "root").select("fp", "root", "component_id")
    return rows.join(names, "fp").select("doc_id", "fp", "text_hash", "root", "component_id")


def one_of_each(docs: DataFrame, tau: int = TAU, id_col: str = "doc_id", text_col: str = "text", similarity: float | None = None) -> DataFrame:
    """The rows of ``docs``, all columns, less all but one of each component.

    The row of the smallest id stays; of rows with one id that with the smallest
    hash of its text, and any one of rows with equal id and text (null: empty).
    """
    found = stored(near_duplicates(docs, tau, id_col, text_col, similarity), "found")  # it is read twice
    rank = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "text_hash")
    kept = stored(found.groupBy("root").agg(F.min(rank).alias("k")).select("k.doc_id", "k.text_hash"), "kept")
    text_hash = F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    same = docs[f"`{id_col}`"].eqNullSafe(kept["doc_id"]) & (text_hash == kept["text_hash"])
    out = docs.join(kept, same, "left_semi")
    again = found.join(kept, (found["doc_id"].eqNullSafe(kept["doc_id"])) & (found["text_hash"] == kept["text_hash"]), "left_semi")
    if again.groupBy("doc_id", "text_hash").count().where("count > 1").isEmpty():
        return out
    name = "text_hash"
    while name in out.columns:
        name += "_"
    return out.withColumn(name, text_hash).dropDuplicates([id_col, name]).drop(name)
