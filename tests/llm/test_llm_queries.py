"""Registered operator queries against their SQL, and what each registered query returns."""

import pytest
from compare import connect, difference

import __spark_entry__ as entry_points
from trawlspark.llm.oracles import ORACLES
from trawlspark.llm.queries import registered


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf, name):
    assert difference(registered()[name](spark, sf), connect(sf), ORACLES[name]) is None


def test_all_are_registered():
    found = entry_points.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in found if n.startswith("op")) == list(range(1, 14))
    assert "pipeline" in found
