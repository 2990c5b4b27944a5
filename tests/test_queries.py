"""Every registered query against its SQL."""

import pytest
from compare import connect, difference

import __spark_entry__ as entry_points
from trawlspark.plans.oracles import ORACLES
from trawlspark.plans.queries import registered

SQL = ORACLES
QUERIES = registered()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


def test_all_queries_have_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    assert difference(QUERIES[name](spark, sf), con, SQL[name]) is None


def test_registered():
    assert set(QUERIES) <= set(entry_points.queries()) and set(SQL) <= set(entry_points.oracle_sql())


def test_entry(spark):
    df = entry_points.entry(spark)
    assert df.columns == ["site", "decision", "n"] and df.count() > 0
