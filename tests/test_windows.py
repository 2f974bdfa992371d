"""Rules and window assignment, against the rotation rules written out."""

import random

import pytest
from pyspark.sql import functions as F

from streamwin.model import records
from streamwin.operators.assign import assign_windows, numbered
from streamwin.operators.windows import apply_handler, window_info, window_rows
from streamwin.plans.strategy import AnyOf, Count, Custom, Never, Time

S = 1_000_000_000


def frame(spark, rows):
    """rows: (key, seconds) in order of arrival, or (key, seconds, id, data)."""
    full = [(i, *(r if len(r) == 4 else (*r, f"{i:04d}", ""))) for i, r in enumerate(rows)]
    df = spark.createDataFrame(full, "seq long, k string, s double, id string, data string")
    return records(df, F.col("seq"), F.col("id"), F.col("k"), F.timestamp_micros((F.col("s") * 1_000_000).cast("long")), F.col("data"))


def model(rows, strategy, eviction):
    """Windows by the rules, one record after another."""
    opened, numbers, out = {}, {}, []
    for stamp, (key, s) in enumerate(rows):
        now = round(s * S)
        w = opened.get(key)
        if w is None or strategy.closes(w["n"], w["first"], now):
            numbers[key] = numbers.get(key, -1) + 1
            w = opened[key] = {"n": 0, "first": now, "win": numbers[key]}
        w["n"], w["last"], w["stamp"] = w["n"] + 1, now, stamp
        out.append((key, w["win"], w["first"]))
        while eviction == "global" and opened:
            k, h = min(opened.items(), key=lambda e: (e[1]["last"], e[1]["stamp"]))
            if not strategy.closes(h["n"], h["first"], now):
                break
            del opened[k]
    return out


def assigned(spark, rows, strategy, eviction="local"):
    df = assign_windows(frame(spark, rows), strategy, eviction).orderBy("seq")
    return [(r.partition_key, r.window_id, r.window_first_ns) for r in df.collect()]


def test_count_rule():
    assert [Count(100).closes(n, 0, 0) for n in (100, 150, 50, 0)] == [True, True, False, False]
    assert Count(0).closes(1, 0, 0)


def test_time_rule_is_strict():
    rule = Time.of(minutes=5)
    assert [rule.closes(1, 1000 * S, t * S) for t in (1001, 1300, 1301, 0)] == [False, False, True, False]


def test_any_of():
    yes, no = Custom(lambda *_: True), Never()
    cases = [(), (yes,), (no,), (yes, no), (no, yes), (no, no, no), (yes, yes, yes)]
    assert [AnyOf(*c).closes(1, 0, 0) for c in cases] == [False, True, False, True, True, False, True]


def test_strategy_is_required(spark):
    with pytest.raises(ValueError, match="partition strategy is required"):
        assign_windows(frame(spark, [("a", 0.0)]), None)


STRATEGIES = [Count(3), Count(0), Never(), AnyOf(), Time.of(seconds=10), AnyOf(Time.of(seconds=10), Count(3)), Custom(lambda n, first, now: n >= 2 and now % 3 == 0)]


@pytest.mark.parametrize("eviction", ["local", "global"])
def test_random_streams_equal_the_model(spark, eviction):
    rng = random.Random(7)
    for strategy in STRATEGIES:
        for in_order in (True, False):
            times = [rng.randint(0, 60) for _ in range(60)]
            rows = [(rng.choice("abc"), float(t)) for t in (sorted(times) if in_order else times)]
            got = assigned(spark, rows, strategy, eviction)
            assert got == model(rows, strategy, eviction)
            # A rule that once true stays true closes the same windows either way; others needn't.
            if in_order and not isinstance(strategy, Custom):
                assert [g[:2] for g in got] == [m[:2] for m in model(rows, strategy, "local")]


def test_late_row_after_another_keys_record(spark):
    rows = [("a", 0.0), ("b", 400.0), ("a", 100.0), ("a", 200.0)]
    assert [w for _, w, _ in assigned(spark, rows, Time.of(seconds=300), "global")] == [0, 0, 1, 1]
    assert [w for _, w, _ in assigned(spark, rows, Time.of(seconds=300))] == [0, 0, 0, 0]


def test_long_key_over_many_batches(spark):
    rows = [("a", float(i)) for i in range(25_000)]
    got = assigned(spark, rows, Time.of(seconds=999))
    assert [w for _, w, _ in got] == [i // 1000 for i in range(25_000)]


def test_numbers_over_chunks(spark):
    df = frame(spark, [("ab"[i % 2], float(i)) for i in range(100)])
    assert [r.number for r in numbered(df, chunk=7).orderBy("seq").collect()] == [i // 2 for i in range(100)]


def test_duplicates_keep_the_last_write_but_count(spark):
    a = assign_windows(frame(spark, [("k", 1.0, "x", "old"), ("k", 1.0, "x", "new"), ("k", 0.5, "a", "")]), Never())
    assert [(r.id, bytes(r.data)) for r in window_rows(a).collect()] == [("a", b""), ("x", b"new")]
    info = window_info(a).first()
    assert (info.record_count, info.distinct_count, info.window_first_ns, info.last_ns, info.close_reason) == (3, 2, S, S // 2, "open")


def test_awkward_keys_reach_the_handler(spark):
    import pandas as pd

    keys = ["a_b", "a/b", "", "ключ", "a_b"]
    a = assign_windows(frame(spark, [(k, 0.1) for k in keys]), Count(1))
    out = apply_handler(a, lambda key, f: pd.DataFrame({"k": [key[0]], "w": [key[1]], "n": [len(f)]}), "k string, w long, n long")
    assert sorted((r.k, r.w, r.n) for r in out.collect()) == sorted([("a_b", 0, 1), ("a_b", 1, 1), ("a/b", 0, 1), ("", 0, 1), ("ключ", 0, 1)])


def test_empty_input(spark):
    for strategy in (Count(2), Time.of(seconds=1), Never()):
        assert assign_windows(frame(spark, [("a", 0.0)]).limit(0), strategy).isEmpty()


def test_global_eviction_over_a_table(spark, sf_dir):
    """Every order of the table, row by row, against the rules written out."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey", F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("s"), "o_orderkey")
    rows = [(str(r[0]), float(r[1])) for r in sorted(orders.collect(), key=lambda r: r.o_orderkey)]
    strategy = Time.of(days=180)
    got = assigned(spark, rows, strategy, "global")
    assert got == model(rows, strategy, "global") and len(rows) == orders.count()
    assert got != assigned(spark, rows, strategy)  # other keys' records did close windows


def test_global_pass_takes_numbers_only(spark, monkeypatch):
    """The one task gets neither ids nor payloads, and clears its queue of stale entries."""
    from streamwin.operators import assign

    monkeypatch.setattr(assign, "QUEUE", 4, raising=False)
    rng = random.Random(3)
    rows = [(rng.choice("abcdefgh"), float(rng.randint(0, 500) + i // 10)) for i in range(3000)]
    strategy = Time.of(seconds=300)
    assert assigned(spark, rows, strategy, "global") == model(rows, strategy, "global") != model(rows, strategy, "local")

    def through_one_task(plan):
        if plan.nodeName() == "Repartition" and plan.numPartitions() == 1:
            yield [plan.output().apply(i).name() for i in range(plan.output().size())]
        for i in range(plan.children().size()):
            yield from through_one_task(plan.children().apply(i))

    plan = assign_windows(frame(spark, rows), strategy, "global")._jdf.queryExecution().optimizedPlan()
    assert list(through_one_task(plan)) == [["low", "high", "n", "data"]]


def test_rules_that_never_close_number_nothing(spark, monkeypatch):
    """A key's numbers with far-apart arrivals are as many chunks as rows, and one task's."""
    from streamwin.operators import assign

    df = frame(spark, [("ab"[i % 7 == 0], float(i * 37 % 500)) for i in range(500)]).withColumn("seq", (F.col("seq") - 250) * (1 << 40))
    want = {"a": 37 * S, "b": 0}
    monkeypatch.setattr(assign, "numbered", None)
    for rule in (Never(), AnyOf()):
        got = assign_windows(df, rule).collect()
        assert len(got) == 500 and {(r.partition_key, r.window_id, r.window_first_ns) for r in got} == {(k, 0, v) for k, v in want.items()}
