"""Every query with an SQL twin gives its rows, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from quillon.plans import records, screening, views  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def norm(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(screening.SQL))
def test_matches_sql(spark, con, name):
    df = screening.QUERIES[name](spark, SF)
    want = con.sql(screening.SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    got = sorted(tuple(map(norm, r)) for r in df.select(*want.columns).collect())
    assert got == sorted(tuple(map(norm, r)) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(screening.QUERIES) - set(screening.SQL)))
def test_rows_only(spark, name):
    assert screening.QUERIES[name](spark, SF).limit(1).count() == 1


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
