"""Toxicity scores by a factorization machine over hashed terms.

A text's terms are its distinct words and their stems, hashed. Two kinds of terms
enter a second-order factorization machine (Rendle, 2010): those that go with the
label significantly, either way, and those that do so among the texts that hold one
of the first kind, such as a group's name that matters only beside an insult. Besides a weight, each has a vector, and the product of two terms'
vectors is the weight of their meeting in one text, such as an insult and the
mention of a group. Long texts count like short ones: a term is there or not.
A null or empty text has no terms and gets the score of the machine's bias.
Repeated rows are learned from and scored each; ties of terms go by their hash.
Only the id and the text are read, whatever other columns are called. Without labelled
rows every score is a half.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold_of, map_rows, texts
from .labelled import MOST_LABELLED, labelled_texts

FOLDS, HELD_OUT = 3, 1
#: Buckets of the hash.
BUCKETS = 1 << 22
#: Terms of each kind that enter the machine, at most, and what they need: documents and |z|.
MOST_TERMS, LEAST_DOCS, LEAST_Z = 4096, 5, 4.0
RANK = 8
EPOCHS = 60
#: A positive row counts as so many: few rows are, and one term must do to tell.
POSITIVE_WEIGHT = 4.0
SEED = 3

_TERM = re.compile(r"[^\W\d_]+")
#: Words that a task remembers.
_REMEMBERED = 100_000
#: Beginnings of words that are terms, too: inflected words share them.
STEMS = (4, 5, 6, 7)


def make_terms() -> Callable[[str], np.ndarray]:
    """The function from a text to its distinct hashed terms, ascending: words,
    their stems, and once more the stems that several distinct words share."""
    from xxhash import xxh64_intdigest

    known: dict[str, list[int]] = {}

    def hashed(word: str) -> list[int]:
        stems = [word[:k] for k in STEMS if len(word) >= k]
        return [xxh64_intdigest(x.encode(), SEED) % (BUCKETS // 2) for x in (f"={word}", *stems)]

    def terms(text: str) -> np.ndarray:
        if len(known) > _REMEMBERED:
            known.clear()
        found: list[int] = []
        for w in set(_TERM.findall(text.lower())):
            h = known.get(w)
            if h is None:
                h = known[w] = hashed(w)
            found += h
        once, times = np.unique(np.array(found, np.int64), return_counts=True)
        return np.concatenate([once, once[times > 1] + BUCKETS // 2])

    return terms


@dataclass
class Model:
    terms: np.ndarray
    bias: float
    weights: np.ndarray
    vectors: np.ndarray

    def logits(self, rows: np.ndarray, places: np.ndarray, n: int) -> np.ndarray:
        """Of n texts; text rows[i] has the model's term places[i]."""
        linear = np.bincount(rows, self.weights[places], n)
        sums = np.zeros((n, self.vectors.shape[1]))
        np.add.at(sums, rows, self.vectors[places])
        squares = np.bincount(rows, (self.vectors[places] ** 2).sum(axis=1), n)
        return self.bias + linear + 0.5 * ((sums**2).sum(axis=1) - squares)

    def score(self, terms: np.ndarray) -> float:
        places = np.searchsorted(self.terms, terms)
        places = places[np.take(self.terms, places, mode="clip") == terms] if len(self.terms) else places[:0]
        logit = self.logits(np.zeros(len(places), np.int64), places, 1)[0]
        return float(1 / (1 + np.exp(-np.clip(logit, -30, 30))))


def train(rows: np.ndarray, places: np.ndarray, y: np.ndarray, terms: np.ndarray, epochs: int = EPOCHS) -> Model:
    """Logistic loss, Adam, and shrinking weights; rows ascending."""
    rng = np.random.default_rng(SEED)
    n, m = len(y), len(terms)
    rate = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if n else 0.5
    model = Model(terms, float(np.log(rate / (1 - rate))), np.zeros(m), rng.normal(0, 0.01, (m, RANK)))
    if not n or not m:
        return model
    starts = np.searchsorted(rows, np.arange(n + 1))
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (np.zeros(1), model.weights, model.vectors)]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(n)
        for at in range(0, n, 256):
            batch = order[at : at + 256]
            lengths = starts[batch + 1] - starts[batch]
            mine = np.repeat(np.arange(len(batch)), lengths)
            which = np.repeat(starts[batch], lengths) + np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            at_places = places[which]
            error = 1 / (1 + np.exp(-np.clip(model.logits(mine, at_places, len(batch)), -30, 30))) - y[batch]
            error *= np.where(y[batch] == 1, POSITIVE_WEIGHT, 1.0)
            sums = np.zeros((len(batch), RANK))
            np.add.at(sums, mine, model.vectors[at_places])
            touched, back = np.unique(at_places, return_inverse=True)
            gw = np.bincount(back, error[mine], len(touched)) / len(batch)
            gv = np.zeros((len(touched), RANK))
            np.add.at(gv, back, error[mine, None] * (sums[mine] - model.vectors[at_places]))
            gv /= len(batch)
            step += 1
            fix1, fix2 = 1 - 0.9**step, 1 - 0.999**step
            for value, grad, (m1, m2), shrink in (
                (np.array([model.bias]), np.array([error.mean()]), state[0], 0.0),
                (model.weights, gw, state[1], 1e-4),
                (model.vectors, gv, state[2], 1e-3),
            ):
                index = slice(None) if len(value) == 1 and value is not model.weights else touched
                grad = grad + shrink * value[index]
                m1[index] = 0.9 * m1[index] + 0.1 * grad
                m2[index] = 0.999 * m2[index] + 0.001 * grad**2
                value[index] -= 0.02 * (m1[index] / fix1) / (np.sqrt(m2[index] / fix2) + 1e-8)
                if value is not model.weights and value is not model.vectors:
                    model.bias = float(value[0])
    return model


def _array(terms: np.ndarray) -> Column:
    return F.array(*[F.lit(int(t)) for t in terms]) if len(terms) else F.array().cast("array<int>")


def _significant(rows: DataFrame, most: int) -> np.ndarray:
    """The terms, at most ``most``, whose share of texts differs most surely between the labels."""
    n, positive = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    negative = n - positive
    counts = rows.select("label", F.explode("terms").alias("term")).groupBy("term").agg(F.sum("label").alias("a"), F.count("*").alias("df"))
    p = F.col("df") / F.lit(float(max(n, 1)))
    gap = F.col("a") / F.lit(float(max(positive, 1))) - (F.col("df") - F.col("a")) / F.lit(float(max(negative, 1)))
    z = F.abs(gap) / F.sqrt(p * (1 - p) * F.lit(1 / max(positive, 1) + 1 / max(negative, 1)) + F.lit(1e-12))
    chosen = counts.where(F.col("df") >= LEAST_DOCS).withColumn("z", z).where(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "term").limit(most)
    return np.array(sorted(r[0] for r in chosen.select("term").collect()), np.int64)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = MOST_LABELLED) -> Model:
    """A model from labelled rows, at most ``most`` of them. Without any, every score is a half."""

    def hashed() -> Callable[..., Iterable[tuple]]:
        terms = make_terms()
        return lambda doc_id, text, y: [(doc_id, y, terms(text).tolist())]

    rows = labelled_texts(docs, labels, label, FOLDS, HELD_OUT, most)
    kind = rows.schema["doc_id"].dataType.simpleString()
    rows = map_rows(rows.select("doc_id", "text", "label"), hashed, f"doc_id {kind}, label int, terms array<int>").cache()
    try:
        alone = _significant(rows, MOST_TERMS)
        held = rows.where(F.arrays_overlap("terms", _array(alone)))
        beside = _significant(held, MOST_TERMS)
        terms = np.union1d(alone, beside)
        wanted = _array(terms)
        # Of each text only the chosen terms: the driver gets a bounded table.
        got = rows.select("doc_id", "label", F.array_intersect("terms", wanted).alias("terms")).orderBy("doc_id", "label").collect()
    finally:
        rows.unpersist()
    lengths = [len(r[2]) for r in got]
    places = np.searchsorted(terms, np.array([t for r in got for t in r[2]], np.int64))
    return train(np.repeat(np.arange(len(got)), lengths), places, np.array([float(r[1]) for r in got]), terms)


def scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted (score of at least 0.7) of each row."""

    def make() -> Callable[..., Iterable[tuple]]:
        terms = make_terms()
        return lambda doc_id, text: [(doc_id, model.score(terms(text)))]

    kind = docs.schema[id_col].dataType.simpleString()
    out = map_rows(texts(docs, id_col, text_col), make, f"doc_id {kind}, score double")
    return out.select("doc_id", (fold_of(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
