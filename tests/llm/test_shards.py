import pytest
from pyspark.sql import functions as F

from streamwin.llm import catalog, oracles
from streamwin.llm.shards import ShardStore


def rows(df):
    return sorted(map(str, df.collect()))


def test_append_compact_and_read(spark, odd_docs, tmp_path):
    store = ShardStore(spark, str(tmp_path / "s"), target_bytes=1 << 20, fanout=3)
    with pytest.raises(ValueError):
        store.read()
    for i in range(7):
        store.append(odd_docs, f"day{i}")
    assert len(store.manifest()["runs"]) == 7
    before = store.manifest()["version"]
    store.append(odd_docs, "day3")  # was appended before
    assert store.manifest()["version"] == before
    old = rows(store.read(2))
    store.compact()
    assert len(store.manifest()["runs"]) < 3 and rows(store.read(2)) == old
    want = sorted(rows(odd_docs) * 7)
    assert rows(store.read()) == want
    assert all(len(r) < 3 for r in store.tiers(store.manifest()).values())
    assert store.vacuum() == 7 and rows(store.read()) == want and store.versions() == [store.manifest()["version"]]
    store.append(odd_docs.limit(0), "nothing")
    assert rows(store.read()) == want
    with pytest.raises(ValueError, match="columns"):
        store.append(odd_docs.drop("lang"), "other")


def test_concurrent_commits_both_stay(spark, odd_docs, tmp_path, monkeypatch):
    one, two = (ShardStore(spark, str(tmp_path / "s")) for _ in range(2))
    one.append(odd_docs, "first")
    real, raced = one.manifest, []

    def stale(version=None):
        found = real(version)
        if not raced:  # another writer commits after this one has read
            raced.append(1)
            two.append(odd_docs, "second")
        return found

    monkeypatch.setattr(one, "manifest", stale)
    one.append(odd_docs, "third")
    assert sorted(real()["arrivals"]) == ["first", "second", "third"] and real()["version"] == 3


def test_compaction_of_runs_that_went_meanwhile(spark, odd_docs, tmp_path):
    store = ShardStore(spark, str(tmp_path / "s"), fanout=2)
    store.append(odd_docs, F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(3)))
    assert store.compact()["version"] == store.manifest()["version"]
    assert rows(store.read()) == rows(odd_docs)


def test_query_equals_sql(spark, sf_dir, same_as_sql):
    same_as_sql(catalog.op4_compaction(spark, sf_dir), oracles.COMPACTION)


def test_arrivals_without_a_name_and_clashing_columns(spark, odd_docs, tmp_path):
    store = ShardStore(spark, str(tmp_path / "s"))
    for name in (F.col("source"), F.lit("")):  # one source is null
        with pytest.raises(ValueError, match="null or empty"):
            store.append(odd_docs, name)
    assert store.versions() == []
    mine = odd_docs.withColumn("streamwin_arrival", F.col("doc_id"))
    store.append(mine, "day0")
    assert rows(store.read()) == rows(mine)


def test_vacuum_takes_what_dead_jobs_left(spark, odd_docs, tmp_path):
    store = ShardStore(spark, str(tmp_path / "s"))
    store.append(odd_docs, "day0")
    odd_docs.write.parquet(str(tmp_path / "s" / "runs" / "dead"))
    store.vacuum()  # it may still be written
    assert (tmp_path / "s" / "runs" / "dead").exists()
    store.vacuum(orphan_hours=0)
    assert not (tmp_path / "s" / "runs" / "dead").exists() and rows(store.read()) == rows(odd_docs)
