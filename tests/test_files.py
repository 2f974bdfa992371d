"""Record bytes, files, tables, merging and the queue."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from streamwin.functions.record import parse_filename, record_size, window_filename
from streamwin.model import RECORD
from streamwin.operators import merge, queue, table
from streamwin.sources import codec, formats
from streamwin.sources.codec import CodecError, Record

NS = 1_704_067_200 * 1_000_000_000  # 2024-01-01


def test_sizes():
    cases = [(Record("", "", NS, "UTC", b"test data"), 55), (Record("ID", "test", NS, "UTC", b"test data"), 61), (Record("", "", 0, "Local", b""), 48), (Record("test1", "partition1", NS, "UTC", b"Hello, World!"), 74)]
    for r, size in cases:
        assert len(codec.encode(r)) == size
    assert codec.encode(None) == b""


def test_size_expression(spark):
    df = spark.createDataFrame([("é", "k", "UTC", bytearray(b"abc"))], "id string, partition_key string, tz string, data binary")
    assert df.select(record_size().alias("n")).first().n == len(codec.encode(Record("é", "k", 0, "UTC", b"abc")))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.builds(Record, st.text(), st.text(), st.integers(-(2**63), 2**63 - 1), st.text(max_size=8), st.binary()), max_size=6))
def test_round_trips(records):
    assert list(codec.scan(b"".join(map(codec.encode, records)))) == records
    log = codec.encode_segment(records[:3]) + codec.encode_segment(records[3:])
    assert list(codec.records_of(log, "wal")) == records
    ordered = sorted(records, key=lambda r: r.id.encode())
    data = codec.encode_table(ordered)
    assert list(codec.records_of(data, "sstable")) == ordered
    for r in ordered:
        assert codec.table_get(data, r.id) == next(x for x in ordered if x.id == r.id)


def test_faults():
    good = codec.encode(Record("a", "b", 1, "UTC", b"x"))
    for bad in (b"REB" + good[3:], good[:-1], b"RE"):
        with pytest.raises(CodecError):
            list(codec.scan(good + bad))
        assert len(list(codec.scan(good + bad, permissive=True))) == 1
    log = codec.encode_segment([Record("a", "b", 1, "UTC", b"x")])
    with pytest.raises(CodecError):
        list(codec.records_of(log + b"\x01\x02", "wal"))
    assert len(list(codec.records_of(log + b"\x01\x02", "wal", True))) == 1
    for bad in (b"", b"x" * 16, b"x" * 64):
        with pytest.raises(CodecError):
            codec.table_index(bad)
    with pytest.raises(CodecError):
        codec.encode_table([Record("key1", "", 0, "UTC", b""), Record("key0", "", 0, "UTC", b"")])
    table_bytes = codec.encode_table([Record(k, "", 0, "UTC", v) for k, v in (("", b"0"), ("key-with-special-chars!@#", b"2"), ("key1", b"1"))])
    assert codec.table_get(table_bytes, "key1").data == b"1" and codec.table_get(table_bytes, "") is not None
    assert codec.table_get(table_bytes, "key2") is None


def test_log_files(spark, tmp_path):
    formats.register(spark)
    rows = spark.range(2500).select(F.format_string("%06d", F.lit(2499) - F.col("id")).alias("id"), F.lit("k").alias("partition_key"), F.lit(0).cast("long").alias("watermark_ns"), F.lit("UTC").alias("tz"), F.lit("d").cast("binary").alias("data"))
    path = str(tmp_path / "log")
    rows.coalesce(1).write.format("wal").option("segmentRecords", 1000).mode("append").save(path)
    files = list((tmp_path / "log").glob("*.wal"))
    assert len(files) == 1 and len(codec.segment_bounds(files[0].read_bytes())) == 3
    again = spark.read.format("wal").load(path)
    assert again.rdd.getNumPartitions() == 3 and again.count() == 2500
    assert [r.id for r in formats.merged_log(again).limit(3).collect()] == ["000000", "000001", "000002"]
    assert formats.read_files(spark, path, "wal").count() == 2500
    (tmp_path / "log" / "bad.wal").write_bytes(b"\xff" * 9)
    with pytest.raises(Exception, match="segment goes beyond"):
        formats.read_files(spark, path, "wal").count()
    assert formats.read_files(spark, path, "wal", "PERMISSIVE").count() == 2500
    with pytest.raises(Exception, match="max records"):
        rows.write.format("wal").option("segmentRecords", 0).mode("append").save(path)


def test_file_names(spark):
    df = spark.createDataFrame([("partition1", 1643673600_000000), ("part-123_test", 1643673600_000000)], "k string, us long")
    names = [r[0] for r in df.select(window_filename("k", "us")).collect()]
    assert names == ["partition1_1643673600.wal", "part-123_test_1643673600.wal"]
    parsed = spark.createDataFrame([(n,) for n in [*names, "invalid.wal", "partition_abc.wal"]], "n string").select(parse_filename("n").alias("p")).collect()
    assert [r.p and tuple(r.p) for r in parsed] == [("partition1", 1643673600), None, None, None]


def _rows(spark, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "seq long, id string, partition_key string, watermark_ns long, data string")
    return df.withColumn("data", F.col("data").cast("binary"))


def test_compaction(spark):
    one, two = _rows(spark, [("1", "", 1, "version1"), ("2", "", 1, "record2")]), _rows(spark, [("1", "", 2, "version2"), ("3", "", 1, "record3")])
    got = {r.id: bytes(r.data) for r in merge.compact(one, two).collect()}
    assert got == {"1": b"version2", "2": b"record2", "3": b"record3"}
    assert merge.compact(one.limit(0)).isEmpty()
    assert merge.compact(spark=spark).isEmpty() and merge.compact(spark=spark).schema == RECORD
    tie = merge.compact(_rows(spark, [("1", "", 1, "a")]), _rows(spark, [("1", "", 1, "b")])).first()
    assert bytes(tie.data) == b"b"
    keys = _rows(spark, [("2", "a", 1, "x"), ("1", "b", 1, "y")])
    assert sorted(r.id for r in merge.compact(keys).collect()) == ["1", "2"]


@pytest.mark.parametrize("lists", [[[1, 2, 3, 4]], [[3, 4, 5], [1, 2]], [[], [1, 2]], [[1, 2], []], [[1, 3], [2, 4], [5]], [[1, 1], [1]]])
def test_merge(spark, lists):
    inputs = [spark.createDataFrame([(x,) for x in xs], "v int") for xs in lists]
    assert [r.v for r in merge.merge_sorted(*inputs, by=("v",)).collect()] == sorted(sum(lists, []))


def test_table(spark, tmp_path):
    rows = _rows(spark, [("key1", "", 0, "v1"), ("key2", "", 0, "v2"), ("key3", "", 0, "v3")])
    path = str(tmp_path / "t")
    table.write_table(rows, path, strict=True)
    assert [bytes(r.data) for r in table.scan(spark, path).collect()] == [b"v1", b"v2", b"v3"]
    assert bytes(table.get(spark, path, "key2").first().data) == b"v2" and table.get(spark, path, "none").isEmpty()
    assert "EqualTo(id,key2)" in table.get(spark, path, "key2")._jdf.queryExecution().toString()
    with pytest.raises(table.TableOrderError):
        table.write_table(_rows(spark, [("key1", "", 0, ""), ("key0", "", 0, "")]), str(tmp_path / "u"), strict=True)


def test_order_violations_across_chunks(spark):
    df = _rows(spark, [(str(x), "", 0, "") for x in (1, 3, 2, 5, 4, 4)])
    assert [r.seq for r in table.order_violations(df, chunk=2).orderBy("seq").collect()] == [2, 4]


def test_queue(spark):
    sets = [("a", 5), ("b", 3), ("c", 7), ("d", 1), ("e", 4)]
    df = lambda rows: spark.createDataFrame([(i, k, v, v is None) for i, (k, v) in enumerate(rows)], "seq long, key string, value int, gone boolean")
    assert [r.value for r in queue.drain(queue.state(df(sets))).collect()] == [1, 3, 4, 5, 7]
    assert queue.peek(queue.state(df([*sets, ("a", 0)]))).first().key == "a"
    assert [r.value for r in queue.pop_k(queue.state(df([("A", 10), ("B", 20), ("C", 15), ("A", 25)])), 3, greatest=True).collect()] == [25, 20, 15]
    held = queue.state(df([*sets, ("d", None)]), removed="gone")
    assert queue.peek(held).first().key == "b" and queue.get(held, "d").isEmpty()
    assert queue.remove(held, spark.createDataFrame([("b",), ("zz",)], "key string")).count() == 3
    assert queue.peek(queue.state(df(sets).limit(0))).isEmpty()


def test_a_table_is_read_by_its_index(spark, tmp_path):
    formats.register(spark)
    rows = spark.range(3000).select(F.format_string("%06d", F.col("id")).alias("id"), F.lit("k").alias("partition_key"), F.lit(0).cast("long").alias("watermark_ns"), F.lit("UTC").alias("tz"), F.lit("d").cast("binary").alias("data"))
    path = f"file:{tmp_path}/t"
    rows.coalesce(1).write.format("sstable").mode("append").save(path)
    assert len(list((tmp_path / "t").glob("*.sstable"))) == 1
    for options, want in (({"key": "000007"}, [7]), ({"key": "none"}, []), ({"low": "002995"}, range(2995, 3000)), ({"high": "000002"}, range(3)), ({"low": "000010", "high": "000012"}, [10, 11, 12]), ({}, range(3000))):
        df = spark.read.format("sstable").options(**options).load(path)
        assert [int(r.id) for r in df.collect()] == list(want)
        assert df.where("id = '000007'").count() == (7 in want) and df.count() == len(want)
    with pytest.raises(Exception, match="mounted folders only"):
        spark.read.format("sstable").load("hdfs://host/x").count()


def test_files_are_read_in_steps():
    import io

    rows = [Record(f"{i:04d}", "k", i, "UTC", b"x" * (i % 50)) for i in range(300)]
    data = b"".join(map(codec.encode, rows))
    for step in (1, 7, 100, 1 << 20):
        assert list(codec.scan_file(io.BytesIO(data), len(data), step=step)) == rows
        assert list(codec.scan_file(io.BytesIO(data[:-1]), len(data) - 1, True, step)) == rows[:-1]
        with pytest.raises(CodecError):
            list(codec.scan_file(io.BytesIO(data[:-1]), len(data) - 1, step=step))
