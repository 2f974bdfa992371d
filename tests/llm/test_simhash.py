import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from streamwin.llm import similar, simhash
from streamwin.llm.components import _round, components


def brute_fingerprint(text):
    import re

    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, fps, tau=4):
    fps = np.array(fps, np.uint64)
    label = np.arange(len(fps))
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= tau
    while True:
        new = np.array([label[near[i]].min() for i in range(len(fps))])
        if (new == label).all():
            break
        label = new
    least = {}
    for i, l in zip(ids, label.tolist()):
        least[l] = min([x for x in (least.get(l), i) if x is not None], default=None)
    return [least[l] for l in label.tolist()]


def check(docs):
    rows = docs.select("doc_id", "text").collect()
    fps = [brute_fingerprint(r.text) for r in rows]
    want = sorted(zip(((r.doc_id or -1) for r in rows), fps, brute_components([r.doc_id for r in rows], fps)))
    got = sorted((r.doc_id or -1, r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == want


def test_equals_brute_force(documents, odd_docs):
    check(documents)
    check(odd_docs)
    assert simhash.near_duplicates(odd_docs.limit(0)).isEmpty()


@pytest.mark.parametrize("block", [2048, 64])
def test_links_of_dense_fingerprints(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = np.random.default_rng(4)
    centres = rng.integers(0, 2**63, 6, dtype=np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 7), replace=False)) for _ in range(900)], np.uint64)
    fps = np.unique(np.concatenate([centres[rng.integers(0, 6, 900)] ^ flips, rng.integers(0, 2**63, 600, dtype=np.uint64)])).view(np.int64)
    nodes = spark.createDataFrame([(int(x),) for x in fps], "fp long")
    roots = {r.node: r.root for r in components(simhash.links(nodes)).collect()}
    got = [roots.get(int(x), int(x)) for x in fps]
    assert got == brute_components([int(x) for x in fps], fps.view(np.uint64))


def test_thresholds_keep_the_pigeonhole():
    rng = np.random.default_rng(1)
    sample = rng.integers(0, 2**63, 300, dtype=np.uint64)
    for m in range(1, 6):
        groups = simhash.group_bits(np.abs(np.corrcoef(rng.random((64, 50)))), m)
        assert sorted(sum(groups, [])) == list(range(64))
        _, thresholds = simhash.allocate(groups, sample, 10**6)
        assert sum(thresholds) == 4 - m + 1 and min(thresholds) >= -1


def test_one_of_each(spark, odd_docs):
    kept = simhash.one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    rows = sorted((r.doc_id or -1, r.text) for r in kept.select("doc_id", "text").collect())
    all_rows = odd_docs.select("doc_id", "text").collect()
    groups = brute_components(list(range(len(all_rows))), [brute_fingerprint(r.text) for r in all_rows])
    assert len(rows) == len(set(groups)) and (5, "the same words again and again") in rows and not any(i == 6 for i, _ in rows)


def test_rows_of_one_id_with_a_null_and_an_empty_text(spark):
    rows = [(1, None, "a"), (1, "", "b"), (2, "four words are here", "c"), (2, "four words are here", "d"), (3, "", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, text_hash string")
    assert sorted(r.doc_id for r in simhash.one_of_each(docs).collect()) == [1, 2]
    assert simhash.one_of_each(docs).columns == docs.columns


def test_components_of_a_path_and_a_star(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{i: 100 for i in range(101, 140)}}
    assert components(spark.createDataFrame([], "a long, b long")).isEmpty()


def test_components_of_random_links_and_a_hub(spark):
    """Repeated links, links in both directions, and a node with more neighbours than a window keeps in memory."""
    rng = np.random.default_rng(8)
    pairs = [tuple(map(int, p)) for p in rng.integers(0, 1500, (900, 2))]
    pairs += pairs[:200] + [(b, a) for a, b in pairs[:200]] + [(9000, i) for i in range(3000, 8000)]
    label = list(range(9001))

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for a, b in pairs:
        a, b = sorted((top(a), top(b)))
        label[b] = a
    got = [tuple(r) for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()]
    assert sorted(got) == [(i, top(i)) for i in range(9001) if top(i) != i]


def test_a_round_of_components_is_two_shuffles(spark):
    """The driver keeps account of each task: more shuffles a round have taken it beyond its memory on many partitions."""
    links = spark.createDataFrame([(i + 1, i) for i in range(9)], "u long, v long")
    plan = _round(links)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == plan.count("Exchange hashpartitioning(u") == 2


def brute_similar(texts, tau=4, similarity=0.8):
    """Component of each text: linked within tau bits or by five-word shingles."""
    import re

    def shingles(text):
        words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    sets, fps = [shingles(t) for t in texts], [brute_fingerprint(t) for t in texts]
    label = list(range(len(texts)))

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if (fps[i] ^ fps[j]).bit_count() <= tau or shared and 5 * shared >= 4 * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                label[b] = a
    return [top(i) for i in range(len(texts))]


@pytest.mark.parametrize("block", [1024, 16])
def test_edited_copies_are_linked(spark, odd_docs, monkeypatch, block):
    monkeypatch.setattr(similar, "BLOCK", block)
    rng = np.random.default_rng(6)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = []
    for _ in range(12):
        words = [vocabulary[i] for i in rng.integers(0, 3000, rng.integers(80, 200))]
        for _ in range(14):
            copy = list(words)
            for at in rng.integers(0, len(copy), rng.integers(0, 9)):
                copy[at] = vocabulary[rng.integers(0, 3000)]
            texts.append(" ".join(copy))
    texts += [r.text for r in odd_docs.select("text").collect()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = brute_similar(texts)
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs, similarity=0.8).collect()}
    assert [got[i] for i in range(len(texts))] == want
    assert sorted(r.doc_id for r in simhash.one_of_each(docs, similarity=0.8).collect()) == sorted(set(want))
    assert len(set(want)) < len(set(brute_components(list(range(len(texts))), [brute_fingerprint(t) for t in texts])))
