import random
import re

from streamwin.llm import decontamination as D
from streamwin.llm import oracles


def words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def brute(docs, items):
    windows = {}
    for i, t in items:
        w = words(t)
        if i is not None and w:
            n = min(8, len(w))
            for s in range(len(w) - n + 1):
                windows.setdefault(tuple(w[s : s + n]), set()).add(str(i))
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for s in range(len(w) - n + 1):
                if ids := windows.get(tuple(w[s : s + n])):
                    found |= ids
                    hit.update(range(s, s + n))
        out.append((-1 if i is None else i, len(w), len(hit), sorted(found)))
    return sorted(out)


def run(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_hit, r["items"]) for r in D.contamination(d, b).collect())


def test_equals_brute_force_on_few_words(spark):
    # Few different words: many equal k-grams, ties, and windows that overlap themselves.
    rng = random.Random(3)
    text = lambda n, k: " ".join(rng.choice("abcdefgh"[:k]) for _ in range(n))
    items = [(i, text(rng.randint(0, 30), rng.choice([1, 2, 3]))) for i in range(30)] + [(50, text(3, 8)), (51, text(5, 8)), (52, text(7, 8)), (53, None), (None, text(9, 1)), (54, "É é A-a"), (55, "É é A-a")]
    docs = [(i, text(rng.randint(0, 60), rng.choice([1, 2, 3, 8]))) for i in range(150)] + [(None, items[3][1]), (200, None), (200, "é É a.A É é a a"), (7, items[1][1]), (7, items[1][1])]
    assert run(spark, docs, items) == brute(docs, items)


def test_every_span_of_a_window_is_found(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    item = [word() for _ in range(40)]
    docs = []
    for i in range(120):
        s = rng.randint(0, 32)
        n = rng.choice([7, 8, 9])
        docs.append((i, " ".join([word() for _ in range(rng.randint(0, 9))] + item[s : s + n] + [word() for _ in range(rng.randint(0, 9))])))
    assert run(spark, docs, [(1, " ".join(item))]) == brute(docs, [(1, " ".join(item))])


def test_shuffled_join_gives_the_same(spark, monkeypatch, documents, sf_dir):
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    one = sorted(map(str, D.contamination(documents, benchmark).collect()))
    monkeypatch.setattr(D, "MOST_BROADCAST", 0)
    assert sorted(map(str, D.contamination(documents, benchmark).collect())) == one


def test_query_equals_sql(spark, sf_dir, same_as_sql):
    from streamwin.llm import catalog

    same_as_sql(catalog.op8_decontamination(spark, sf_dir), oracles.DECONTAMINATION)


def test_odd_and_empty_tables(spark, odd_docs):
    benchmark = spark.createDataFrame([(1, "the same words again and again"), (2, "THE same-words again and again!"), (3, None)], "item_id long, text string")
    bad = D.contamination(odd_docs, benchmark).where("contaminated")
    assert sorted(r.doc_id for r in bad.collect()) == [5, 6, 6]
    kept = D.keep_clean(odd_docs, benchmark)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count() - 3
    assert D.keep_clean(odd_docs, benchmark.limit(0)).count() == odd_docs.count()
    assert D.contamination(odd_docs.limit(0), benchmark).isEmpty()
