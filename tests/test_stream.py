"""The engine: windows of a stream, handlers, restart."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from streamwin.operators.assign import assign_windows
from streamwin.plans.strategy import AnyOf, Count, Never, Time
from streamwin.streaming.engine import Engine

SCHEMA = "seq long, id string, partition_key string, watermark_ns long, data string"


def make_handler():
    # A function of its own: executors can't import this module.
    def handler(key, frame):
        return pd.DataFrame({"partition_key": [key[0]], "window_id": [key[1]], "ids": [",".join(frame["id"])]})

    return handler


def engine(spark, folder, strategy):
    return Engine(spark, strategy, folder, handler=make_handler(), handler_schema="partition_key string, window_id long, ids string")


def write(spark, rows, path):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").json(path)


def results(df):
    return sorted((r.partition_key, r.window_id, r.ids) for r in df.collect())


def test_strategy_is_required(spark, tmp_path):
    with pytest.raises(ValueError, match="partition strategy is required"):
        Engine(spark, None, str(tmp_path))


def test_windows_handlers_and_restart(spark, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path / "out")
    strategy = AnyOf(Count(2), Time.of(seconds=100))
    first = [(0, "t1", "same", 1_000_000_000_000, ""), (1, "t2", "same", 1_001_000_000_000, ""), (2, "x", "other", 1, "")]
    second = [(3, "t3", "same", 1_002_000_000_000, ""), (4, "late", "other", 0, ""), (5, "t4", "same", 1_200_000_000_000, "")]
    write(spark, first, source)
    stream = spark.readStream.schema(SCHEMA).json(source)
    e = engine(spark, folder, strategy)
    e.ingest(stream, available_now=True).awaitTermination()
    assert e.process().isEmpty()  # nothing is closed yet
    write(spark, second, source)
    e = engine(spark, folder, strategy)  # goes on from the checkpoint
    e.ingest(stream, available_now=True).awaitTermination()
    assert results(e.process()) == [("same", 0, "t1,t2"), ("same", 1, "t3")]
    e.stop()  # handles what is still open
    want = [("other", 0, "late,x"), ("same", 0, "t1,t2"), ("same", 1, "t3"), ("same", 2, "t4")]
    assert results(e.process()) == want
    batch = assign_windows(spark.createDataFrame(first + second, SCHEMA), strategy)
    columns = ["seq", "window_id", "window_first_ns"]
    assert sorted(map(tuple, batch.select(columns).collect())) == sorted(map(tuple, e.assigned().select(columns).collect()))


def test_failed_window_is_handled_again(spark, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path / "out")
    write(spark, [(i, str(i), "k", i, "") for i in range(4)], source)
    e = engine(spark, folder, Count(2))

    def broken(key, frame):
        raise RuntimeError("handler failed")

    e.handler = broken
    e.ingest(spark.readStream.schema(SCHEMA).json(source), available_now=True).awaitTermination()
    with pytest.raises(Exception, match="handler failed"):
        e.process()
    e.handler = make_handler()
    assert results(e.process()) == [("k", 0, "0,1")]
    assert e.windows().where(F.col("close_reason") == "open").count() == 1


def test_records_after_a_flush_are_handled_once(spark, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path / "out")
    engine(spark, folder, Count(2)).stop()  # nothing has come yet
    stream = None
    for rows in (["a", "b", "c"], ["d", "e"], ["f"]):
        write(spark, [(ord(x), x, "k", ord(x), "") for x in rows], source)
        stream = stream or spark.readStream.schema(SCHEMA).json(source)
        e = engine(spark, folder, Count(2))
        e.ingest(stream, available_now=True).awaitTermination()
        e.stop()
    assert results(e.process()) == [("k", 0, "a,b"), ("k", 1, "c"), ("k", 2, "d,e"), ("k", 3, "f")]


def test_polling(spark, tmp_path):
    import time

    source, folder = str(tmp_path / "in"), str(tmp_path / "out")
    write(spark, [(i, f"{i:02}", "k", i, "") for i in range(9)], source)
    e = Engine(spark, Count(2), folder, 0.5, make_handler(), "partition_key string, window_id long, ids string", max_windows=3)
    e.start(spark.readStream.schema(SCHEMA).json(source))
    end = time.time() + 60
    while time.time() < end and not (e._exists(e.results) and spark.read.schema(e.handler_schema).parquet(e.results).count() >= 4):
        time.sleep(0.5)
    e.stop(flush=False)
    assert not e.failures and [r[1:] for r in results(e.process())] == [(i, f"{2 * i:02},{2 * i + 1:02}") for i in range(4)]
    with pytest.raises(ValueError, match="greater than 0"):
        Engine(spark, Count(1), folder, max_windows=0)


def test_handled_windows_are_deleted(spark, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "partition_key string, window_id long, ids string"
    stream, want = None, []
    for i, rows in enumerate((["a", "b", "c"], ["d", "e"], ["f"])):
        write(spark, [(ord(x), x, "k", ord(x), "") for x in rows], source)
        stream = stream or spark.readStream.schema(SCHEMA).json(source)
        e = Engine(spark, Count(2), folder, handler=make_handler(), handler_schema=schema, delete_handled=True)
        e.ingest(stream, available_now=True).awaitTermination()
        want += [[("k", 0, "a,b")], [("k", 1, "c,d")], []][i]
        assert results(e.process()) == want
        assert sorted(r.id for r in e.assigned().collect()) == [["c"], ["e"], ["e", "f"]][i]
        assert len(e._names(e.sink)) == [1, 1, 2][i]  # what was kept, and a batch without a closed window
    # A batch that is run again after its purge leaves nothing.
    e._write(spark.createDataFrame([], e.schema), 0)
    assert len(e._names(e.sink)) == 2
    # A purge that has died before its record: what it wrote counts for nothing.
    e.assigned().write.parquet(f"{e.sink}/kept-dead")
    assert e.assigned().count() == 2
    e.stop()
    assert results(e.process()) == [*want, ("k", 2, "e,f")] and e.assigned().isEmpty() and not e._exists(f"{e.sink}/kept-dead")


def test_no_task_holds_a_keys_records(spark, tmp_path):
    """Windows come from sorts and joins; a state operator had each key's records of a batch in one Python process."""
    source = str(tmp_path / "in")
    write(spark, [(i, f"{i:03}", "same", i, "") for i in range(250)], source)
    e = engine(spark, str(tmp_path / "out"), Count(100))
    query = e.ingest(spark.readStream.schema(SCHEMA).json(source), available_now=True)
    query.awaitTermination()
    assert query.lastProgress["stateOperators"] == []
    assert sorted((r.window_id, r["count"]) for r in e.assigned().groupBy("window_id").count().collect()) == [(0, 100), (1, 100), (2, 50)]


@pytest.mark.parametrize("strategy", [Count(3), Never(), AnyOf(Time.of(seconds=5), Count(4))])
def test_batches_go_on_from_their_keys_state(spark, tmp_path, monkeypatch, strategy):
    from streamwin.streaming import engine as module

    monkeypatch.setattr(module, "WHOLE", 2)
    rows = [(i, str(i), "aab"[i % 3] if i < 20 else "bc"[i % 2], (i * 7 % 23) * 1_000_000_000, "") for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA)
    e = engine(spark, str(tmp_path / "out"), strategy)
    for number, (lo, hi) in enumerate([(0, 7), (7, 20), (20, 20), (20, 33), (33, 40)]):
        e._write(df.where(f"seq >= {lo} and seq < {hi}"), number)
        if number == 3:  # a batch that died before its state, and one that is run again
            e._delete(f"{e.folder}/states/batch-3")
            e._write(df.limit(0), 3)
            e._write(df, 3)
    columns = ["seq", "window_id", "window_first_ns"]
    assert sorted(map(tuple, e.assigned().select(columns).collect())) == sorted(map(tuple, assign_windows(df, strategy).select(columns).collect()))
    with pytest.raises(RuntimeError, match="no state of batch 5"):
        e._write(df, 6)
