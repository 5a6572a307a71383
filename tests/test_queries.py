"""Every query with SQL against DuckDB, and the others for a stable schema."""

import pytest

from confluo.plans import catalogue

from .oracle import connect, difference

SQL = catalogue.oracle_sql()


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, small, con, name):
    assert difference(catalogue.queries()[name](spark, small), con, SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(SQL)))
def test_without_sql(spark, small, name):
    df = catalogue.queries()[name](spark, small)
    assert df.count() >= 0 and all(kind != "void" for _, kind in df.dtypes)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())
