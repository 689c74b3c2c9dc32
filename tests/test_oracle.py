"""Every query with SQL gives the same rows as DuckDB on the smallest tables."""

import pytest

import __spark_entry__ as entry
from check import connection, difference

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_rows(spark, con, name):
    df = entry.queries()[name](spark, SF)
    cur = con.execute(entry.oracle_sql()[name])
    want_cols = [d[0] for d in cur.description]
    assert difference([tuple(r) for r in df.collect()], df.columns, cur.fetchall(), want_cols) is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
