import pytest

import __spark_entry__ as entry
from oracle import compare, connect

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_sql(spark, connection, name):
    problem, rows = compare(spark, connection, entry.queries()[name], entry.oracle_sql()[name], SF_DIR)
    assert problem is None, problem
    assert rows > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 4
