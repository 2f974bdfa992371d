"""Every query of the library against its SQL."""

import pytest

from streamwin import catalog


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, sf_dir, same_as_sql, name):
    same_as_sql(catalog.QUERIES[name](spark, sf_dir), catalog.SQL[name])


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 13
    assert set(e.oracle_sql()) <= set(e.queries())
