"""Every registered query with SQL gives the same rows as DuckDB over the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def tidy(rows, columns):
    at = [columns.index(c) for c in sorted(columns)]
    return sorted(tuple(repr(round(r[k], 9)) if isinstance(r[k], float) else str(r[k]) for k in at) for r in rows)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    want = duck.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert tidy(df.collect(), df.columns) == tidy(want.fetchall(), want.columns)


@pytest.mark.parametrize("name", ["failure_attribution"])
def test_query_without_sql_runs(spark, name):
    assert entry.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
