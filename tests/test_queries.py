"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", QUERIES)
def test_query_matches_sql(spark, con, name):
    out = compare(spark, name, QUERIES[name], SQL.get(name), FOLDER, con)
    assert out["problem"] is None
    assert out["rows"] > 0


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
