import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "3g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{sf_dir}/{f}'")
    return con


def rows_of(df):
    """Rows as sorted tuples, columns by name."""
    columns = sorted(df.columns)
    key = lambda t: tuple((x is None, str(type(x)), x) for x in t)
    return sorted((tuple(r[c] for c in columns) for r in df.select(*[f"`{c}`" for c in columns]).collect()), key=key)


@pytest.fixture(scope="session")
def same_as_sql(duck):
    def check(df, sql):
        want = duck.execute(sql)
        names = [d[0] for d in want.description]
        assert sorted(names) == sorted(df.columns)
        order = sorted(range(len(names)), key=lambda i: names[i])
        key = lambda t: tuple((x is None, str(type(x)), x) for x in t)
        assert rows_of(df) == sorted((tuple(r[i] for i in order) for r in want.fetchall()), key=key)

    return check
