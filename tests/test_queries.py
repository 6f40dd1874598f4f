"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from talkmill.plans import registered
from tests.compare import compare, connection

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
QUERIES, SQL = registered()
#: Queries without SQL, and the tests that check their rules.
OTHERWISE = {"b06_compression_ratio": ("test_text.py", "test_compression")}


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("name", list(SQL))
def test_query(spark, con, name):
    ok, note = compare(spark, con, name, QUERIES[name], SQL[name], SF)
    assert ok, note


def test_queries_without_sql_are_checked_elsewhere():
    assert set(QUERIES) - set(SQL) == set(OTHERWISE)
    for file, test in OTHERWISE.values():
        with open(os.path.join(os.path.dirname(__file__), file), encoding="utf-8") as text:
            assert f"def {test}(" in text.read()


@pytest.mark.parametrize("name", list(OTHERWISE))
def test_query_without_sql_has_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_all_queries_are_exposed():
    assert set(QUERIES) <= set(queries()) and set(SQL) <= set(oracle_sql())


def test_entry(spark):
    assert entry(spark).columns == ["session_id", "document"]
