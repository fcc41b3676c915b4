import pytest

import __spark_entry__ as entry
from oracle import compare, connect

SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(folder):
    return connect(folder)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, duck, folder, name):
    assert compare(spark, duck, folder, entry.queries()[name], SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(SQL)))
def test_query_runs(spark, folder, name):
    assert entry.queries()[name](spark, folder).count() > 0


def test_entry(spark):
    row = entry.entry(spark).collect()
    assert len(row) == 1 and row[0]["n"] == 500
