"""Quality, toxicity and language: held-out accuracy and odd inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from streamwin.llm import language, quality, toxicity

BIG = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def big(spark):
    return spark.read.parquet(f"{BIG}/documents.parquet"), spark.read.parquet(f"{BIG}/labels.parquet")


def test_quality(spark, big, odd_docs, held_out):
    docs, labels = big
    model = quality.fit(docs, labels)
    got = quality.scores(docs, model).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in got]) > 0.95
    rows = quality.scores(odd_docs, model).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 and r.held_out == held_out(r.doc_id, 3, 1) and r.predicted == (r.score >= 0.5) for r in rows)
    kept = quality.keep_good(docs.withColumn("score", F.lit("mine")), labels)
    assert kept.columns == [*docs.columns, "score"] and 0.7 * docs.count() < kept.count() < docs.count()
    nothing = quality.fit(docs, labels.limit(0))
    assert {r.score for r in quality.scores(odd_docs, nothing).collect()} == {0.5}
    assert quality.scores(docs.limit(0), model).isEmpty()


def test_isotonic_is_monotone():
    rng = np.random.default_rng(0)
    x = rng.normal(size=500)
    knots, heights = quality.isotonic(x, (rng.random(500) < 1 / (1 + np.exp(-2 * x))).astype(float))
    fit = np.interp(np.sort(x), knots, heights)
    assert (np.diff(fit) >= 0).all() and 0 <= fit.min() and fit.max() <= 1 and (np.diff(knots) > 0).all()


def test_toxicity(spark, big, odd_docs, held_out):
    docs, labels = big
    model = toxicity.fit(docs, labels)
    got = toxicity.scores(docs, model).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.toxic for r in got]) > 0.93
    assert np.mean([r.predicted for r in got if not r.toxic]) < 0.02
    rows = toxicity.scores(odd_docs, model).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 and r.held_out == held_out(r.doc_id, 3, 1) for r in rows)
    assert {r.score for r in toxicity.scores(odd_docs, toxicity.fit(docs, labels.limit(0))).collect()} == {0.5}


def test_machine_learns_a_pair():
    """Two terms that are toxic only together, which no sum of weights can tell."""
    rng = np.random.default_rng(2)
    x = rng.random((3000, 2)) < 0.5
    y = (x[:, 0] == x[:, 1]).astype(float)
    rows, places = np.nonzero(x)
    model = toxicity.train(rows, places, y, np.array([5, 9]), epochs=150)
    score = [model.score(np.array([t for t, on in zip((5, 9), r) if on], np.int64)) > 0.5 for r in ((0, 0), (0, 1), (1, 0), (1, 1))]
    assert score == [True, False, False, True]


def test_language(spark, big, odd_docs, held_out):
    docs, _ = big
    model = language.fit(docs)
    got = language.predictions(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang_pred == r.lang for r in got]) > 0.98
    rows = {r.doc_id: r for r in language.predictions(odd_docs, model).collect()}
    assert [rows[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and rows[1].score == 0 and rows[1].rejected
    assert all(0 <= r.score <= 1 and r.held_out == held_out(r.doc_id, 4, 2) for r in rows.values()) and rows[10].lang_pred in model.languages
    assert {r.lang_pred for r in language.predictions(odd_docs, language.fit(docs.limit(0))).collect()} == {"und"}


def test_kneser_ney_by_hand():
    """Tables against the recursion written out, and probabilities that sum to one."""
    text = "abracadabra abba "
    points = np.concatenate([np.full(3, 32), [ord(c) for c in text]]).astype(np.uint32)
    grams, counts = np.unique(np.lib.stride_tricks.sliding_window_view(points, 4), axis=0, return_counts=True)
    model = language._kneser_ney(grams, counts, np.zeros(len(grams), np.int64), ["x"])
    letters = sorted(set(points.tolist()))
    for context in ([32, 32, 32], [ord("a"), ord("b"), ord("r")], [ord("z"), ord("a"), ord("b")], [ord("z")] * 3):
        p = [np.exp(model.log_probabilities(np.array([*context, c], np.uint32))[0, 0]) for c in [*letters, 0x3042]]
        assert abs(sum(p) - 1) < 1e-9


def test_no_language_goes_for_the_sequences_of_another(spark):
    """A small language of rare sequences beside one of over 240,000."""
    rng = np.random.default_rng(5)
    signs = [c for c in range(0x4E00, 0x9F00)]
    big, small = [c for c in signs if c & 255 < 32], [c for c in signs if c & 255 >= 240]
    texts = [("big", "".join(map(chr, rng.choice(big, 1000)))) for _ in range(500)]
    texts += [("small", "".join(map(chr, rng.choice(small, 50)))) for _ in range(60)]
    docs = spark.createDataFrame([(i, t, x) for i, (x, t) in enumerate(texts)], "doc_id long, text string, lang string")
    model = language.fit(docs)
    assert model.languages == ["big", "small"]
    # What was counted is there whole: one sequence for each place of a fitted text, less chance repeats.
    fitted = docs.where((language.fold_of(F.col("doc_id"), language.FOLDS) != language.HELD_OUT) & (F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(language.CALIBRATE_EVERY)) != 0))
    assert len(model.keys[3]) > 0.999 * fitted.agg(F.sum(F.length("text"))).first()[0] > 240_000
    got = language.predictions(docs, model).join(docs, "doc_id").where("held_out and lang = 'small'").collect()
    assert got and all(r.lang_pred == "small" for r in got)


def test_machine_is_the_sum_over_all_pairs():
    rng = np.random.default_rng(4)
    terms = np.arange(10, 40, 2)
    model = toxicity.Model(terms, -0.3, rng.normal(size=len(terms)), rng.normal(size=(len(terms), toxicity.RANK)))
    for size in (0, 1, 2, 7):
        mine = rng.choice(np.arange(10, 40), size, replace=False)  # some are terms that the model doesn't know
        known = [int(np.flatnonzero(terms == t)[0]) for t in mine if t in terms]
        logit = model.bias + sum(model.weights[i] for i in known)
        logit += sum(float(model.vectors[i] @ model.vectors[j]) for k, i in enumerate(known) for j in known[k + 1 :])
        assert abs(model.score(np.array(mine, np.int64)) - 1 / (1 + np.exp(-logit))) < 1e-9


def test_features_approximate_the_kernel_and_sums_solve_the_ridge():
    rng = np.random.default_rng(5)
    k, n = quality.STATISTICS, quality.FEATURES
    directions, phases = rng.standard_normal((k, n)) / np.sqrt(k), rng.uniform(0, 2 * np.pi, n)
    model = quality.Model(np.zeros(k), np.ones(k), directions, phases, np.zeros(n + 1), np.zeros(1), np.zeros(1))
    z = rng.normal(size=(40, k))
    wave = model.features(z)[:, :-1]
    kernel = np.exp(-((z[:, None] - z[None]) ** 2).sum(axis=2) / (2 * k))
    assert np.abs(wave @ wave.T - kernel).mean() < 2 / np.sqrt(n)
    x, y = rng.normal(size=(200, 6)), rng.random(200)
    parts = [np.hstack([a, b[:, None]]) for a, b in zip(np.array_split(x, 3), np.array_split(y, 3))]
    # The same problem with the ridge as further rows, by least squares.
    rows = np.vstack([x, np.sqrt(quality.RIDGE) * np.eye(6)])
    want = np.linalg.lstsq(rows, np.concatenate([y, np.zeros(6)]), rcond=None)[0]
    assert np.allclose(quality._solve((p.T @ p for p in parts), 6), want)


def test_ids_may_be_text(spark, big):
    docs, labels = (t.withColumn("doc_id", F.format_string("d%d", "doc_id")) for t in big)
    for module in (quality, toxicity):
        got = module.scores(docs, module.fit(docs, labels))
        assert got.schema["doc_id"].dataType.simpleString() == "string" and got.count() == docs.count()
        assert got.where("score > 0.7").count() and got.where("score < 0.3").count()


def test_fit_finds_a_term_that_matters_only_beside_another(spark):
    """Texts with the insult are toxic if they name the group; the group's name alone tells nothing."""
    rng = np.random.default_rng(6)
    rows = []
    for i in range(6000):
        insult, group = rng.random() < 0.3, rng.random() < 0.5
        toxic = group if insult else (not group and rng.random() < 0.3 / 0.7)
        filler = " ".join(rng.choice(["sun", "tree", "road", "milk", "stone", "cloud"], 4))
        rows.append((i, f"{'dolt ' if insult else ''}{'martians ' if group else ''}{filler}", int(toxic)))
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(table, table)
    terms = toxicity.make_terms()
    assert model.score(terms("dolt martians tree")) > 0.9 and model.score(terms("dolt tree road")) < 0.2
    assert model.score(terms("martians tree road")) < 0.2
