"""Every registered query with SQL against DuckDB, on the smallest test data."""

import os

import pytest

import __spark_entry__ as contract
import oracle

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = contract.queries(), contract.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF_DIR)


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    result = QUERIES[name](spark, SF_DIR)
    if name in SQL:
        assert oracle.difference(result, con, SQL[name]) is None
    else:
        assert result.count() > 0


def test_entry(spark):
    assert contract.entry(spark).count() > 0
