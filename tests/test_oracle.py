"""Every registered query against its SQL, and the shape of the registry."""
import os

import pytest

import __spark_entry__ as entry
from compare import connect, difference

FOLDER = os.environ.get("TIDECAST_TESTDATA", "/root/testdata/sf0.001")
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, name):
    assert difference(QUERIES[name](spark, FOLDER), con, SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_gives_rows(spark, name):
    df = QUERIES[name](spark, FOLDER)
    assert df.schema == QUERIES[name](spark, FOLDER).schema and len(df.collect()) > 0


def test_sql_has_queries():
    assert set(SQL) <= set(QUERIES)
