"""Quality scores by random Fourier features of document statistics.

Cosines of random projections of a text's standardised statistics approximate a
Gaussian kernel. Each task adds up its part of the normal equations, the sums are
added and solved for ridge weights, and isotonic regression on further labelled
rows turns scores into probabilities. Statistics are of whole texts; a null or
empty text has those of no words and is scored like any other. Repeated rows are
scored each. Only the id and the text are read, whatever other columns are called.
Without labelled rows every score is a half.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fold_of, map_rows, texts
from .labelled import MOST_LABELLED, labelled_texts

FOLDS, HELD_OUT = 3, 1
FEATURES = 256
RIDGE = 1e-2
SEED = 5
#: One labelled row in so many is kept for the isotonic step.
CALIBRATE_EVERY = 4

_LINE = re.compile(r"[^\n]+")


def statistics(text: str) -> list[float]:
    """What the score sees of a text."""
    words = text.split()
    n, size = len(words), len(text)
    data = np.frombuffer(text.encode(), np.uint8)
    seen = np.bincount(data, minlength=256)
    upper, lower, digits = int(seen[65:91].sum()), int(seen[97:123].sum()), int(seen[48:58].sum())
    stops, marks = int(seen[46] + seen[44]), int(seen[33] + seen[63])
    odd = int(seen[33:48].sum() + seen[58:65].sum() + seen[91:97].sum() + seen[123:127].sum()) - stops
    letters = max(1, int(upper + lower + seen[128:].sum()))
    distinct = len(set(words))
    lines = _LINE.findall(text)
    repeats = sum(a == b for a, b in zip(words, words[1:]))
    w, s = max(1, n), max(1, size)
    longest = max(map(len, words), default=0)
    return [
        math.log1p(size),
        math.log1p(n),
        math.log1p(len(lines)),
        (size - n) / w,
        math.log1p(longest),
        distinct / w,
        math.log1p(distinct),
        repeats / w,
        len(set(lines)) / max(1, len(lines)),
        upper / letters,
        digits / s,
        stops / w,
        marks / w,
        int(seen[124]) / w,
        odd / w,
        int(seen[128:].sum()) / s,
        sum(x.isupper() for x in words) / w,
        sum(x[:1].isupper() for x in words) / w,
        int(seen[10]) / w,
    ]


STATISTICS = len(statistics(""))


@dataclass
class Model:
    mean: np.ndarray
    spread: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    heights: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.spread, -6, 6)
        wave = np.sqrt(2.0 / self.directions.shape[1]) * np.cos(z @ self.directions + self.phases)
        return np.hstack([wave, np.ones((len(stats), 1))])

    def ridge(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.interp(self.ridge(stats), self.knots, self.heights)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots and heights of the non-decreasing fit of y to x, by pooling adjacent violators.

    Between pools the fit is interpolated. A slight slope within each pool keeps
    the order of scores.
    """
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []  # sum, count, sum of x
    for a, b in zip(x[order].tolist(), y[order].tolist()):
        pools.append([b, 1, a])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last)]
    # One observation of either label in each pool: none is certain.
    knots = np.array([p[2] / p[1] for p in pools])
    heights = np.maximum.accumulate([(p[0] + 0.5) / (p[1] + 1) for p in pools])
    low, high = min(knots[0], x.min()) - 1, max(knots[-1], x.max()) + 1
    knots = np.concatenate([[low], knots, [high]])
    heights = np.concatenate([[heights[0] * 0.5], heights, [1 - (1 - heights[-1]) * 0.5]])
    rise = 1e-6 * np.arange(len(knots)) / len(knots)
    return knots, np.clip(heights * (1 - 1e-6) + rise, 0, 1)


def _solve(parts: Iterable[np.ndarray], size: int) -> np.ndarray:
    """Ridge weights from normal equations, the last row and column of which hold the labels."""
    total = np.zeros((size + 1, size + 1))
    for p in parts:
        total += p
    gram = total[:size, :size] + RIDGE * np.eye(size)
    return np.linalg.solve(gram, total[:size, size])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = MOST_LABELLED) -> Model:
    """A model from labelled rows, at most ``most`` of them. Without any, every score is a half."""

    def measure() -> Callable[..., Iterable[tuple]]:
        return lambda doc_id, text, y: [(doc_id, y, statistics(text))]

    rows = labelled_texts(docs, labels, label, FOLDS, HELD_OUT, most)
    kind = rows.schema["doc_id"].dataType.simpleString()
    rows = map_rows(rows.select("doc_id", "text", "label"), measure, f"doc_id {kind}, label int, stats array<double>")
    rows = rows.withColumn("calibrates", F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(CALIBRATE_EVERY)) == 0).cache()
    try:
        cells = [F.element_at("stats", i + 1) for i in range(STATISTICS)]
        moments = rows.select(F.array(*map(F.avg, cells)), F.array(*map(F.stddev_pop, cells)), F.count("*")).first()
        rng = np.random.default_rng(SEED)
        directions = rng.standard_normal((STATISTICS, FEATURES)) / math.sqrt(STATISTICS)
        phases = rng.uniform(0, 2 * math.pi, FEATURES)
        if not moments[2]:
            return Model(np.zeros(STATISTICS), np.ones(STATISTICS), directions, phases, np.zeros(FEATURES + 1), np.array([0.0]), np.array([0.5]))
        model = Model(np.array(moments[0]), np.maximum(np.array(moments[1]), 1e-6), directions, phases, np.zeros(FEATURES + 1), np.zeros(1), np.zeros(1))

        def normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((FEATURES + 2, FEATURES + 2))
            for b in batches:
                if b.num_rows:
                    x = model.features(np.array(b.column("stats").to_pylist()))
                    x = np.hstack([x, b.column("label").to_numpy().astype(float)[:, None]])
                    total += x.T @ x
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

        # A matrix from each of a few tasks: the labelled rows are bounded.
        sums = rows.where("not calibrates").coalesce(8).mapInArrow(normal, "sums binary").collect()
        model.weights = _solve((np.frombuffer(s[0]).reshape(FEATURES + 2, -1) for s in sums), FEATURES + 1)
        known = rows.where("calibrates").select("label", "stats").collect()
        if not known:
            known = rows.select("label", "stats").collect()
        model.knots, model.heights = isotonic(model.ridge(np.array([r[1] for r in known])), np.array([float(r[0]) for r in known]))
        return model
    finally:
        rows.unpersist()


def scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """doc_id, held_out, score and predicted of each row; with ``keep`` all columns of ``docs`` and the score."""
    rows = docs if keep else texts(docs, id_col, text_col)
    text_at = rows.columns.index(text_col if keep else "text")
    names = rows.columns if keep else ["doc_id"]
    score_name = "score"
    while score_name in rows.columns:
        score_name += "_"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                stats = np.array([statistics(t or "") for t in part.column(text_at).to_pylist()])
                found = pa.array(model.score(stats))
                columns = part.columns if keep else [part.column(0)]
                yield pa.RecordBatch.from_arrays([*columns, found], [*names, score_name])

    schema = T.StructType([*(rows.schema if keep else rows.select("doc_id").schema), T.StructField(score_name, T.DoubleType())])
    out = rows.mapInArrow(run, schema)
    if keep:
        return out
    return out.select("doc_id", (fold_of(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score at least ``least``, all columns as they were."""
    scored = scores(docs, fit(docs, labels), keep=True)
    name = scored.columns[-1]
    return scored.where(F.col(f"`{name}`") >= least).drop(name)
