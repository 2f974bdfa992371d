"""The library's queries, and the same in SQL for DuckDB.

Times are microseconds since 1970 as bigint, so that both engines agree.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.record import parse_filename, record_size, window_filename
from .model import ORDER, padded, records
from .operators import merge, queue, table
from .operators.assign import assign_windows, numbered
from .operators.windows import apply_handler, window_info, window_rows
from .plans.strategy import AnyOf, Count, Never, Strategy, Time
from .sources import formats
from .streaming.engine import Engine, assign_stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder that spark.checkpoint.dir names."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or tempfile.gettempdir()
    return f"{base.rstrip('/')}/streamwin-{name}-{uuid.uuid4().hex}"


# -- adapters ---------------------------------------------------------------


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(df: DataFrame, key: str) -> DataFrame:
    return records(df, F.col("event_id"), padded("event_id"), F.col(key), F.col("ts"), F.col("props"))


def events_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(_table(spark, sf_dir, "events"), "event_type")


def events_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(_table(spark, sf_dir, "events"), "user_id")


def orders_by_cust(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _table(spark, sf_dir, "orders")
    return records(df, F.col("o_orderkey"), padded("o_orderkey"), F.col("o_custkey"), F.col("o_orderdate"), F.col("o_orderpriority"))


def lineitem_versions(spark: SparkSession, sf_dir: str, key: str | None = "l_returnflag") -> DataFrame:
    """Versions of order lines. Their order of arrival is made up from all their columns."""
    df = _table(spark, sf_dir, "lineitem")
    parts = (F.col("l_partkey") * 1_000_000_000 + F.col("l_suppkey") * 10_000 + F.col("l_quantity").cast("long") * 100) * 10 + F.pmod(F.round(F.col("l_extendedprice")).cast("long"), F.lit(10))
    id = F.concat(padded("l_orderkey"), F.lit("-"), F.col("l_linenumber").cast("string"))
    return records(df, parts, id, F.col(key) if key else F.lit(""), F.col("l_shipdate"), F.format_string("%.2f", "l_extendedprice"))


_LINE_SEQ = "(l_partkey * 1000000000 + l_suppkey * 10000 + cast(l_quantity as bigint) * 100) * 10 + cast(round(l_extendedprice) as bigint) % 10"
_LINE_ID = "lpad(cast(l_orderkey as varchar), 12, '0') || '-' || cast(l_linenumber as varchar)"


def _us(column: str) -> F.Column:
    return F.expr(f"{column} div 1000")


def _summary(assigned: DataFrame) -> DataFrame:
    info = window_info(assigned)
    return info.select("partition_key", "window_id", "record_count", _us("window_first_ns").alias("first_us"), _us("last_ns").alias("last_us"))


# -- window assignment --------------------------------------------------------


def _count_sql(table: str, key: str, seq: str, ts: str, n: int) -> str:
    return f"""SELECT k AS partition_key, w AS window_id, count(*) AS record_count, arg_min(t, s) AS first_us, arg_max(t, s) AS last_us
FROM (SELECT k, t, s, (row_number() OVER (PARTITION BY k ORDER BY s) - 1) // {n} AS w
      FROM (SELECT cast({key} AS VARCHAR) AS k, epoch_us({ts}) AS t, {seq} AS s FROM {table})) GROUP BY ALL"""


def _never_sql(table: str, key: str, seq: str, ts: str) -> str:
    return f"""SELECT k AS partition_key, cast(0 AS BIGINT) AS window_id, count(*) AS record_count, arg_min(t, s) AS first_us, arg_max(t, s) AS last_us
FROM (SELECT cast({key} AS VARCHAR) AS k, epoch_us({ts}) AS t, {seq} AS s FROM {table}) GROUP BY k"""


def _fold_sql(table: str, key: str, seq: str, ts: str, us: int, n: int | None = None) -> str:
    shut = f"o.t - r.f > {us}" + (f" OR r.n >= {n}" if n else "")
    return f"""WITH RECURSIVE o AS (SELECT cast({key} AS VARCHAR) AS k, epoch_us({ts}) AS t, row_number() OVER (PARTITION BY {key} ORDER BY {seq}) AS rn FROM {table}),
r AS (SELECT k, rn, t, t AS f, cast(0 AS BIGINT) AS w, cast(1 AS BIGINT) AS n FROM o WHERE rn = 1
      UNION ALL
      SELECT o.k, o.rn, o.t, CASE WHEN {shut} THEN o.t ELSE r.f END, CASE WHEN {shut} THEN r.w + 1 ELSE r.w END, CASE WHEN {shut} THEN 1 ELSE r.n + 1 END
      FROM r JOIN o ON o.k = r.k AND o.rn = r.rn + 1)
SELECT k AS partition_key, w AS window_id, count(*) AS record_count, arg_min(t, rn) AS first_us, arg_max(t, rn) AS last_us FROM r GROUP BY k, w"""


DAY_US = 86_400_000_000
_BY_TYPE, _BY_USER, _BY_CUST = ("events", "event_type", "event_id", "ts"), ("events", "user_id", "event_id", "ts"), ("orders", "o_custkey", "o_orderkey", "o_orderdate")


@query(_count_sql(*_BY_TYPE, 100))
def count_window_100(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summary(assign_windows(events_by_type(spark, sf_dir), Count(100)))


@query(_count_sql(*_BY_TYPE, 1))
def count_window_1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summary(assign_windows(events_by_type(spark, sf_dir), Count(1)))


@query(_count_sql(*_BY_TYPE, 1))
def count_window_0(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summary(assign_windows(events_by_type(spark, sf_dir), Count(0)))


@query(_count_sql(*_BY_USER, 10))
def count_window_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summary(assign_windows(events_by_user(spark, sf_dir), Count(10)))


@query(_never_sql(*_BY_TYPE))
def never_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summary(assign_windows(events_by_type(spark, sf_dir), Never()))


@query(_fold_sql(*_BY_USER, DAY_US))
def time_window_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summary(assign_windows(events_by_user(spark, sf_dir), Time.of(days=1)))


#: A gap between two neighbours, to the microsecond: the record after it must stay in its window.
_GAP_SQL = "SELECT epoch_us(max(ts)) - epoch_us(min(ts)) FROM (SELECT ts FROM events WHERE user_id = (SELECT min(user_id) FROM events) ORDER BY event_id LIMIT 2)"


@query(_fold_sql(*_BY_USER, 0).replace("o.t - r.f > 0", f"o.t - r.f > ({_GAP_SQL})"))
def time_window_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events")
    first = events.where(F.col("user_id") == events.agg(F.min("user_id")).first()[0]).orderBy("event_id").limit(2)
    low, high = first.select(F.unix_micros(F.col("ts").cast("timestamp")).alias("t")).agg(F.min("t"), F.max("t")).first()
    return _summary(assign_windows(events_by_user(spark, sf_dir), Time((high - low) * 1000)))


@query(_fold_sql(*_BY_CUST, 180 * DAY_US))
def time_window_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summary(assign_windows(orders_by_cust(spark, sf_dir), Time.of(days=180)))


@query(_fold_sql(*_BY_USER, DAY_US, 3))
def composite_1d_or_3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summary(assign_windows(events_by_user(spark, sf_dir), AnyOf(Time.of(days=1), Count(3))))


@query(_never_sql(*_BY_TYPE))
def composite_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summary(assign_windows(events_by_type(spark, sf_dir), AnyOf()))


@query(_fold_sql(*_BY_CUST, 180 * DAY_US, 4))
def window_info_first_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summary(assign_windows(orders_by_cust(spark, sf_dir), AnyOf(Time.of(days=180), Count(4))))


@query()
def evict_global_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summary(assign_windows(orders_by_cust(spark, sf_dir), Time.of(days=180), eviction="global"))


# -- names, sizes, order --------------------------------------------------------

_NAME_SQL = f"""SELECT partition_key, window_id, partition_key || '_' || cast(first_us // 1000000 AS VARCHAR) || '.wal' AS name FROM ({_count_sql(*_BY_TYPE, 100)})"""


@query(_NAME_SQL)
def window_filenames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_window_100(spark, sf_dir).select("partition_key", "window_id", window_filename("partition_key", "first_us").alias("name"))


@query(f"""SELECT name, CASE WHEN ok THEN regexp_extract(name, '^([^_]*)_([0-9]+).wal$', 1) END AS parsed_key, CASE WHEN ok THEN cast(regexp_extract(name, '^([^_]*)_([0-9]+).wal$', 2) AS BIGINT) END AS seconds
FROM (SELECT name, regexp_matches(name, '^[^_]*_[0-9]+.wal$') AS ok FROM (SELECT CASE WHEN window_id % 2 = 0 THEN name ELSE 'a_' || name END AS name FROM ({_NAME_SQL})))""")
def window_filename_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = window_filenames(spark, sf_dir).select(F.when(F.col("window_id") % 2 == 0, F.col("name")).otherwise(F.concat(F.lit("a_"), "name")).alias("name"))
    return names.select("name", parse_filename("name").alias("p")).select("name", F.col("p.partition_key").alias("parsed_key"), "p.seconds")


@query("SELECT doc_id, cast(43 + 12 + strlen(source) + 3 + strlen(text) AS BIGINT) AS bytes FROM documents")
def record_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    rows = records(docs, F.col("doc_id"), padded("doc_id"), F.col("source"), F.lit("1970-01-01").cast("timestamp"), F.col("text"))
    return rows.select(F.col("seq").alias("doc_id"), record_size().alias("bytes"))


@query("""SELECT k AS partition_key, (n // 1000) AS segment, count(*) AS records, cast(sum(b) + 8 AS BIGINT) AS bytes
FROM (SELECT event_type AS k, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS n, 43 + 12 + strlen(event_type) + 3 + strlen(coalesce(props, '')) AS b FROM events) GROUP BY ALL""")
def segment_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table.segments(events_by_type(spark, sf_dir))


@query("SELECT event_id AS seq, event_type AS partition_key, row_number() OVER (PARTITION BY event_type ORDER BY lpad(cast(event_id AS VARCHAR), 12, '0'), ts) AS place FROM events")
def record_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("partition_key").orderBy(*ORDER[1:])).cast("long")
    return events_by_type(spark, sf_dir).select("seq", "partition_key", place.alias("place"))


# -- windows' rows ---------------------------------------------------------------


@query(f"""SELECT partition_key, id, us, data FROM (
SELECT l_returnflag AS partition_key, {_LINE_ID} AS id, epoch_us(l_shipdate) AS us, printf('%.2f', l_extendedprice) AS data,
       row_number() OVER (PARTITION BY l_returnflag, {_LINE_ID}, l_shipdate ORDER BY {_LINE_SEQ} DESC, l_extendedprice DESC) AS rn FROM lineitem) WHERE rn = 1""")
def window_rows_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = window_rows(assign_windows(lineitem_versions(spark, sf_dir), Never()))
    return rows.select("partition_key", "id", _us("watermark_ns").alias("us"), F.col("data").cast("string").alias("data"))


SUMS = "partition_key string, window_id long, n long, total double"
_SUMS_SQL = """SELECT k AS partition_key, w AS window_id, count(*) AS n, sum(cast(v AS DECIMAL(18,2)))::DOUBLE AS total
FROM (SELECT event_type AS k, value AS v, (row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) // 100 AS w FROM events) GROUP BY ALL"""


def _event_values(df: DataFrame) -> DataFrame:
    return records(df, F.col("event_id"), padded("event_id"), F.col("event_type"), F.col("ts"), F.col("value").cast("decimal(18,2)").cast("string"))


def _sum_handler() -> Callable:
    # A function of its own: executors need not have this module.
    def handler(key, frame):
        import decimal

        import pandas as pd

        total = sum((decimal.Decimal(bytes(x).decode()) for x in frame["data"]), decimal.Decimal(0))
        return pd.DataFrame({"partition_key": [key[0]], "window_id": [key[1]], "n": [len(frame)], "total": [float(total)]})

    return handler


@query(_SUMS_SQL)
def handler_window_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _table(spark, sf_dir, "events")
    return apply_handler(assign_windows(_event_values(df), Count(100)), _sum_handler(), SUMS)


@query("""SELECT partition_key, window_id, id, place FROM (
SELECT k AS partition_key, w AS window_id, id, row_number() OVER (PARTITION BY k, w ORDER BY v DESC, id) AS place
FROM (SELECT event_type AS k, lpad(cast(event_id AS VARCHAR), 12, '0') AS id, cast(value AS DECIMAL(18,2)) AS v, (row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) // 100 AS w FROM events)) WHERE place <= 3""")
def handler_window_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _table(spark, sf_dir, "events")
    rows = assign_windows(_event_values(df), Count(100))

    def handler(key, frame):
        import decimal

        import pandas as pd

        best = sorted(zip((-decimal.Decimal(bytes(x).decode()) for x in frame["data"]), frame["id"]))[:3]
        return pd.DataFrame({"partition_key": key[0], "window_id": key[1], "id": [i for _, i in best], "place": range(1, len(best) + 1)})

    return apply_handler(rows, handler, "partition_key string, window_id long, id string, place long")


# -- merge and compaction -----------------------------------------------------------


def _in_order(df: DataFrame, name: str) -> DataFrame:
    """``df`` with ``place``, the row's number in the order in which ``df`` has its
    rows, so that a comparison sees that order. The rows are written once with their
    partition and place in it; partitions' counts give the offsets."""
    spark, path = df.sparkSession, _scratch(df.sparkSession, name)
    df.withColumn("_at", F.monotonically_increasing_id()).write.parquet(path)
    rows = spark.read.parquet(path).withColumn("_all", F.lit(0))
    return numbered(rows, "_all", "_at", "place", chunk=1 << 33).drop("_all", "_at")


def _merged(rows: DataFrame) -> DataFrame:
    return _in_order(rows, "merged").select("id", _us("watermark_ns").alias("us"), "seq", F.col("data").cast("string").alias("data"), "place")


def _merge_sql(inputs: int) -> str:
    return f"""SELECT id, us, seq, data, row_number() OVER (ORDER BY id, us, seq % {inputs}, seq, data) - 1 AS place
FROM (SELECT {_LINE_ID} AS id, epoch_us(l_shipdate) AS us, {_LINE_SEQ} AS seq, printf('%.2f', l_extendedprice) AS data FROM lineitem)"""


@query(_merge_sql(4))
def merge_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lineitem_versions(spark, sf_dir, None)
    return _merged(merge.merge_sorted(*(rows.where(F.pmod("seq", F.lit(4)) == i) for i in range(4))))


@query(_merge_sql(2))
def merge_with_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lineitem_versions(spark, sf_dir, None)
    return _merged(merge.merge_sorted(rows.where(F.pmod("seq", F.lit(2)) == 0), rows.limit(0), rows.where(F.pmod("seq", F.lit(2)) == 1)))


@query(f"""SELECT id, us, data FROM (SELECT id, us, data, row_number() OVER (PARTITION BY id ORDER BY us DESC, seq DESC, data DESC) AS rn
FROM (SELECT {_LINE_ID} AS id, epoch_us(l_shipdate) AS us, {_LINE_SEQ} AS seq, printf('%.2f', l_extendedprice) AS data FROM lineitem)) WHERE rn = 1""")
def compact_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.compact(lineitem_versions(spark, sf_dir, None)).select("id", _us("watermark_ns").alias("us"), F.col("data").cast("string").alias("data"))


@query("SELECT cast(o_custkey AS VARCHAR) AS id, max(epoch_us(o_orderdate)) AS us, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS seq FROM orders GROUP BY o_custkey")
def compact_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _table(spark, sf_dir, "orders")
    rows = records(df, F.col("o_orderkey"), F.col("o_custkey"), F.lit(""), F.col("o_orderdate"), F.col("o_orderpriority"))
    return merge.compact(rows).select("id", _us("watermark_ns").alias("us"), "seq")


# -- sorted tables ---------------------------------------------------------------------


def _orders_table(spark: SparkSession, sf_dir: str) -> str:
    path = _scratch(spark, "table")
    table.write_table(orders_by_cust(spark, sf_dir), path)
    return path


def _table_columns(rows: DataFrame) -> DataFrame:
    return rows.select("id", "partition_key", _us("watermark_ns").alias("us"), F.col("data").cast("string").alias("data"))


_ORDERS_SQL = "SELECT lpad(cast(o_orderkey AS VARCHAR), 12, '0') AS id, cast(o_custkey AS VARCHAR) AS partition_key, epoch_us(o_orderdate) AS us, o_orderpriority AS data FROM orders"


@query(f"{_ORDERS_SQL} WHERE o_orderkey = 7")
def table_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table_columns(table.get(spark, _orders_table(spark, sf_dir), "000000000007"))


@query(f"{_ORDERS_SQL} WHERE o_orderkey = -1")
def table_get_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table_columns(table.get(spark, _orders_table(spark, sf_dir), "none"))


@query(f"SELECT *, row_number() OVER (ORDER BY id) - 1 AS place FROM ({_ORDERS_SQL})")
def table_scan_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _in_order(_table_columns(table.scan(spark, _orders_table(spark, sf_dir))), "scanned")


@query("""SELECT seq, id, before FROM (SELECT o_orderkey AS seq, id, lag(id) OVER (ORDER BY o_orderkey) AS before
FROM (SELECT o_orderkey, lpad(cast(o_custkey AS VARCHAR), 12, '0') AS id FROM orders)) WHERE id < before""")
def table_order_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), padded("o_custkey").alias("id"))
    return table.order_violations(rows)


# -- priority queue ---------------------------------------------------------------------


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "value", F.col("event_id").alias("seq"))


_HELD_SQL = "SELECT user_id AS key, arg_max(value, event_id) AS value FROM events GROUP BY user_id"


@query(_HELD_SQL)
def pq_latest_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.state(_changes(spark, sf_dir))


@query(f"SELECT * FROM ({_HELD_SQL}) ORDER BY value, key LIMIT 1")
def pq_peek_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.peek(queue.state(_changes(spark, sf_dir)))


@query(f"SELECT * FROM ({_HELD_SQL}) ORDER BY value DESC, key LIMIT 5")
def pq_pop_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.pop_k(queue.state(_changes(spark, sf_dir)), 5, greatest=True)


@query(f"SELECT * FROM ({_HELD_SQL}) WHERE key NOT IN (SELECT user_id FROM events WHERE value < 1)")
def pq_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = queue.state(_changes(spark, sf_dir))
    return queue.remove(held, _table(spark, sf_dir, "events").where("value < 1").select(F.col("user_id").alias("key")))


@query(f"SELECT *, row_number() OVER (ORDER BY value, key) - 1 AS place FROM ({_HELD_SQL})")
def pq_drain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _in_order(queue.drain(queue.state(_changes(spark, sf_dir))), "drained")


# -- streaming ---------------------------------------------------------------------------


def _stream(spark: SparkSession, sf_dir: str, key: str, strategy: Strategy) -> DataFrame:
    schema = _table(spark, sf_dir, "events").schema
    # The stream's source takes folders and patterns only; this is a pattern of one file.
    rows = _events(spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]"), key)
    out = _scratch(spark, "stream")
    assign_stream(rows, strategy, out).trigger(availableNow=True).start().awaitTermination()
    return _summary(spark.read.parquet(f"{out}/assigned/batch-*"))


@query(_count_sql(*_BY_TYPE, 100))
def stream_count_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stream(spark, sf_dir, "event_type", Count(100))


@query(_fold_sql(*_BY_USER, DAY_US))
def stream_time_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stream(spark, sf_dir, "user_id", Time.of(days=1))


@query(_SUMS_SQL)
def engine_handled_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the handler gives of a stream that is taken in, handled, stopped with
    its open windows, and taken up again by another engine on the same folder."""
    schema = _table(spark, sf_dir, "events").schema
    folder = _scratch(spark, "engine")
    for _ in range(2):
        engine = Engine(spark, Count(100), folder, handler=_sum_handler(), handler_schema=SUMS, delete_handled=True)
        engine.ingest(_event_values(spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")), available_now=True).awaitTermination()
        engine.process()
        engine.stop()
    return engine.process()


# -- record files -------------------------------------------------------------------------

_EVENTS_SQL = "SELECT lpad(cast(event_id AS VARCHAR), 12, '0') AS id, event_type AS partition_key, epoch_us(ts) AS us, coalesce(props, '') AS data FROM events"


def _round_trip(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    formats.register(spark)
    path = _scratch(spark, kind)
    rows = events_by_type(spark, sf_dir)
    if kind == "sstable":
        rows = rows.repartitionByRange("id").sortWithinPartitions("id")
    rows.select("id", "partition_key", "watermark_ns", "tz", "data").write.format(kind).mode("append").save(path)
    return _table_columns(formats.read_files(spark, path, kind))


@query(_EVENTS_SQL)
def codec_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round_trip(spark, sf_dir, "recordio")


@query(_EVENTS_SQL)
def wal_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round_trip(spark, sf_dir, "wal")


@query(_EVENTS_SQL)
def sstable_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round_trip(spark, sf_dir, "sstable")


@query("SELECT event_type AS partition_key, event_id AS seq, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS number FROM events")
def arrival_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbered(events_by_type(spark, sf_dir)).select("partition_key", "seq", "number")
