"""Language identification by interpolated Kneser-Ney character models.

Each language has a model of four-character sequences of its lower-cased
letters, with runs of other signs as one space. Every order's sequences lie in
one sorted array of hashes, with a column of log probabilities for each
language, interpolated already; a sequence that no language has seen backs off
through the weights of its context. The language of the lowest cross-entropy a
character is the prediction. Documents kept out of the counting calibrate the
score, and the cross-entropy above which a prediction is rejected.

A text that is null or has no letter is ``und`` with a score of 0, and so is any text
if there was no language to learn. Of languages that tie, the first by name is
predicted. Repeated rows are predicted each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fold_of, map_rows, texts

FOLDS, HELD_OUT = 4, 2
ORDER = 4
#: Documents of each language that a model is fitted on, at most, and of all languages.
MOST_DOCS, MOST_DOCS_IN_ALL = 600, 60_000
#: Up to so many languages their sizes are broadcast, so that documents are thinned
#: out before they are dealt out by language; beyond it they are joined by shuffle.
MOST_LANGUAGES = 10_000
#: One sampled document in so many calibrates.
CALIBRATE_EVERY = 6
#: Characters of the pieces of calibrating documents that calibrate the score as well.
PIECES = (4, 8, 16, 32)
#: Share of calibrating documents whose cross-entropy is accepted.
ACCEPTED = 0.995
#: Characters that are looked up at a time.
CHARS = 1 << 18
UNKNOWN = "und"
SPACE = 32
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _letters() -> np.ndarray:
    """Which code points of the first plane are letters."""
    return np.array([chr(i).isalpha() for i in range(0x10000)])


def characters(text: str, letters: np.ndarray) -> np.ndarray:
    """Code points of the letters in lower case, runs of other signs as one space, a space at both ends."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    is_letter = letters[np.minimum(points, 0xFFFF)]
    for p in np.unique(points[points > 0xFFFF]).tolist():
        is_letter[points == p] = chr(p).isalpha()
    out = np.full(len(points) + 2, SPACE, np.uint32)
    out[1:-1] = np.where(is_letter, points, SPACE)
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != SPACE) | (out[:-1] != SPACE)
    return out[keep]


def hashes(points: np.ndarray, order: int) -> np.ndarray:
    """A hash of every ``order`` consecutive points (last axis)."""
    n = points.shape[-1] - order + 1
    h = np.zeros((*points.shape[:-1], n), np.uint64)
    for i in range(order):
        h = h * _MIX + points[..., i : i + n].astype(np.uint64) + np.uint64(1)
        h ^= h >> np.uint64(29)
    return h


def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places in the sorted ``keys``; -1 where missing."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return np.where(keys[at] == wanted, at, -1)


@dataclass
class Model:
    languages: list[str]
    keys: list[np.ndarray] = field(default_factory=list)  # by order, from 1
    logs: list[np.ndarray] = field(default_factory=list)  # [sequence, language]
    contexts: list[np.ndarray] = field(default_factory=list)  # by length, from 1
    backoffs: list[np.ndarray] = field(default_factory=list)
    floor: np.ndarray = field(default_factory=lambda: np.zeros(0))
    slope: float = 1.0
    offset: float = 0.0
    limits: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def log_probabilities(self, points: np.ndarray) -> np.ndarray:
        """Of each point after the first ORDER - 1, given those before it, by language."""
        n = len(points) - ORDER + 1
        out = np.zeros((n, len(self.languages)), np.float64)
        left = np.arange(n)
        for order in range(ORDER, 0, -1):
            wanted = hashes(points[ORDER - order :], order)
            at = _find(self.keys[order - 1], wanted[left])
            hit = at >= 0
            out[left[hit]] += self.logs[order - 1][at[hit]]
            left = left[~hit]
            if not len(left):
                return out
            if order > 1:  # the context is all but the last point
                context = hashes(points[ORDER - order : -1], order - 1)
                at = _find(self.contexts[order - 2], context[left])
                hit = at >= 0
                out[left[hit]] += self.backoffs[order - 2][at[hit]]
        out[left] += self.floor
        return out

    def total(self, points: np.ndarray) -> tuple[np.ndarray, int]:
        """Summed log probabilities by language, and the number of characters."""
        padded = np.concatenate([np.full(ORDER - 1, SPACE, points.dtype), points])
        sums = np.zeros(len(self.languages))
        for at in range(0, len(points), CHARS):
            sums += self.log_probabilities(padded[at : at + CHARS + ORDER - 1]).sum(axis=0)
        return sums, len(points)

    def decide(self, sums: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Best language, its cross-entropy in bits a character, score, and whether it is rejected; a row of sums a text."""
        entropy = -sums / n[:, None] / np.log(2)
        best = entropy.argmin(axis=1)
        ordered = np.sort(entropy, axis=1)
        score = 1 / (1 + np.exp(-np.clip(self.slope * margin(ordered, n) + self.offset, -30, 30)))
        return best, ordered[:, 0], score, (score < 0.5) | (ordered[:, 0] > self.limits[best])


def margin(ordered: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The lead of the best language, which counts for more in longer texts."""
    lead = ordered[:, 1] - ordered[:, 0] if ordered.shape[1] > 1 else np.ones(len(ordered))
    return np.sqrt(np.minimum(n, 400)) * lead


def _kneser_ney(sequences: np.ndarray, counts: np.ndarray, owner: np.ndarray, languages: list[str]) -> Model:
    """sequences: [n, ORDER] code points; owner: the language of each row."""
    model = Model(languages)
    k = len(languages)
    alphabet = len(np.unique(sequences)) + 1
    model.floor = np.full(k, -np.log(alphabet))
    lower_keys, lower = np.zeros(0, np.uint64), np.zeros((0, k))
    for order in range(1, ORDER + 1):
        rows, n = sequences[:, ORDER - order :], counts.astype(np.float64)
        if order < ORDER:  # how many different points come before: continuation counts
            longer = sequences[:, ORDER - order - 1 :]
            pairs = np.unique(np.column_stack([owner.astype(np.uint64), hashes(longer, order + 1)[:, 0]]), axis=0, return_index=True)[1]
            rows, n, mine = rows[pairs], np.ones(len(pairs)), owner[pairs]
        else:
            mine = owner
        h = hashes(rows, order)[:, 0]
        keys, first, at = np.unique(h, return_index=True, return_inverse=True)
        table = np.zeros((len(keys), k))
        np.add.at(table, (at, mine), n)
        ones, twos = (table == 1).sum(axis=0), (table == 2).sum(axis=0)
        discount = np.clip(ones / np.maximum(ones + 2 * twos, 1), 0.1, 0.95)
        points = rows[first]
        if order == 1:
            base = np.full((len(keys), k), 1.0 / alphabet)
            total = table.sum(axis=0, keepdims=True)
            kinds = (table > 0).sum(axis=0, keepdims=True)
            context_of = np.zeros(len(keys), np.int64)
        else:
            base = np.exp(lower[_find(lower_keys, hashes(points[:, 1:], order - 1)[:, 0])])
            context = hashes(points[:, :-1], order - 1)[:, 0]
            contexts, context_of = np.unique(context, return_inverse=True)
            total, kinds = np.zeros((len(contexts), k)), np.zeros((len(contexts), k))
            np.add.at(total, context_of, table)
            np.add.at(kinds, context_of, table > 0)
        weight = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
        logs = np.log(np.maximum(table - discount, 0) / np.maximum(total, 1)[context_of] + weight[context_of] * base)
        model.keys.append(keys)
        model.logs.append(logs)
        if order > 1:
            model.contexts.append(contexts)
            model.backoffs.append(np.log(weight))
        else:
            model.floor = np.log(weight[0] / alphabet)
        lower_keys, lower = keys, logs
    return model


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """A model from at most ``MOST_DOCS`` documents of each language that the
    fold rule doesn't hold out; None without any."""
    named = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"), F.col(f"`{lang_col}`").alias("lang"))
    named = named.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (fold_of(F.col("doc_id"), FOLDS) != HELD_OUT))
    # About twice as many as needed, by hash: no task ranks all documents of a language.
    sizes = named.groupBy("lang").agg(F.count("*").alias("size"))
    few = sizes.limit(MOST_LANGUAGES + 1).count() <= MOST_LANGUAGES
    near = named.select("doc_id", "lang").join(F.broadcast(sizes) if few else sizes, "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) * F.col("size") < F.lit(2 * MOST_DOCS * (1 << 30)))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = near.select("doc_id", "lang").withColumn("place", F.row_number().over(order)).where(F.col("place") <= MOST_DOCS)
    chosen = chosen.select("doc_id", "lang").distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "lang").limit(MOST_DOCS_IN_ALL)
    rows = named.join(F.broadcast(chosen), ["doc_id", "lang"])  # at most MOST_DOCS_IN_ALL rows
    rows = rows.select("lang", "text", (F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(CALIBRATE_EVERY)) == 0).alias("calibrates"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = _letters()
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                points = characters(text, letters)
                padded = np.concatenate([np.full(ORDER - 1, SPACE, points.dtype), points])
                for at in range(0, len(points), CHARS):
                    piece = padded[at : at + CHARS + ORDER - 1]
                    _, first, n = np.unique(hashes(piece, ORDER), return_index=True, return_counts=True)
                    found = [piece[i : i + ORDER].tobytes() for i in first.tolist()]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found, pa.binary()), pa.array(n, pa.int64())], ["lang", "sequence", "n"])

    counting = rows.where("not calibrates").select("lang", "text").mapInArrow(count, "lang string, sequence binary, n long")
    got = counting.groupBy("lang", "sequence").agg(F.sum("n").alias("n")).orderBy("sequence", "lang").collect()  # bounded by the sampled documents
    if not got:
        return None
    languages = sorted({r[0] for r in got})
    place = {x: i for i, x in enumerate(languages)}
    sequences = np.frombuffer(b"".join(bytes(r[1]) for r in got), "<u4").reshape(-1, ORDER)
    model = _kneser_ney(sequences, np.array([r[2] for r in got]), np.array([place[r[0]] for r in got]), languages)
    model.limits = np.full(len(languages), np.inf)

    def measure() -> Callable:
        letters = _letters()

        def each(lang, text):
            points = characters(text, letters)
            if len(points) > 1 and lang in place:
                # Pieces, too: whole documents are hardly ever mistaken, short texts are.
                for piece in (points, *(points[-k:] for k in PIECES if k < len(points))):
                    sums, n = model.total(piece)
                    yield place[lang], n, sums.tolist(), piece is points

        return each

    known = map_rows(rows.where("calibrates").select("lang", "text"), measure, "lang int, n long, sums array<double>, whole boolean").collect()
    if known:
        n, sums, truth, whole = (np.array([r[i] for r in known]) for i in (1, 2, 0, 3))
        ordered = np.sort(-sums / n[:, None] / np.log(2), axis=1)
        best = sums.argmax(axis=1)
        model.slope, model.offset = _platt(margin(ordered, n), best == truth)
        for i in range(len(languages)):
            if (mine := ordered[whole & (best == i) & (truth == i), 0]).size >= 20:
                model.limits[i] = np.quantile(mine, ACCEPTED) * 1.02
    return model


def _platt(x: np.ndarray, right: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve for the share of right predictions,
    with Platt's softened targets and a weak pull of the slope to 1."""
    a, b = right.sum(), (~right).sum()
    target = np.where(right, (a + 1) / (a + 2), 1 / (b + 2))
    w = np.array([1.0, 0.0])
    design = np.column_stack([x, np.ones(len(x))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        grad = design.T @ (p - target) + 0.1 * (w - [1.0, 0.0])
        hess = (design * (p * (1 - p))[:, None]).T @ design + 0.1 * np.eye(2)
        w = w - np.linalg.solve(hess, grad)
    return float(max(w[0], 1e-3)), float(w[1])


def predictions(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score, cross_entropy (bits a character) and rejected.

    Texts that are null or have no letter are ``und``, rejected with score 0; so
    is every text if there is no model.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, letters = shared.value, _letters()
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                langs, score, entropy, rejected = [UNKNOWN] * part.num_rows, np.zeros(part.num_rows), np.full(part.num_rows, np.nan), np.ones(part.num_rows, bool)
                rows, sums, sizes = [], [], []
                if model is not None:
                    held: list[np.ndarray] = []

                    def flush() -> None:
                        if held:
                            points = np.concatenate([np.concatenate([np.full(ORDER - 1, SPACE, np.uint32), p]) for p in held])
                            logs = model.log_probabilities(points)
                            ends = np.cumsum([len(p) + ORDER - 1 for p in held])
                            for end, p in zip(ends.tolist(), held):
                                sums.append(logs[end - (ORDER - 1) - len(p) : end - (ORDER - 1)].sum(axis=0))
                                sizes.append(len(p))
                            held.clear()

                    size = 0
                    for i, text in enumerate(part.column(1).to_pylist()):
                        points = characters(text, letters)
                        if len(points) < 2:
                            continue
                        rows.append(i)
                        if len(points) > CHARS:
                            flush()
                            total, n = model.total(points)
                            sums.append(total)
                            sizes.append(n)
                            size = 0
                            continue
                        held.append(points)
                        size += len(points)
                        if size >= CHARS:
                            flush()
                            size = 0
                    flush()
                if rows:
                    best, e, s, r = model.decide(np.array(sums), np.array(sizes))
                    for i, x in zip(rows, best.tolist()):
                        langs[i] = model.languages[x]
                    score[rows], entropy[rows], rejected[rows] = s, e, r
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(langs, pa.string()), pa.array(score), pa.array(entropy, mask=np.isnan(entropy)), pa.array(rejected)],
                    ["doc_id", "lang_pred", "score", "cross_entropy", "rejected"],
                )

    rows = texts(docs, id_col, text_col)
    schema = rows.select("doc_id").schema.add("lang_pred", "string").add("score", "double").add("cross_entropy", "double").add("rejected", "boolean")
    return rows.mapInArrow(run, schema).withColumn("held_out", fold_of(F.col("doc_id"), FOLDS) == HELD_OUT).select("doc_id", "held_out", "lang_pred", "score", "cross_entropy", "rejected")
