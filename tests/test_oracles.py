"""Every query with a DuckDB twin gives the same rows, names, types and values."""

import pytest

import __spark_entry__ as E
from check_oracles import compare, connect

QUERIES, ORACLES = E.queries(), E.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


def test_entry_has_rows(spark):
    assert E.entry(spark).count() > 0


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, sf, name):
    result = compare(spark, con, sf, name, QUERIES[name], ORACLES.get(name))
    assert not result.startswith("FAIL"), result
