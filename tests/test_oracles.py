"""Each query against its SQL in DuckDB, on the smallest tables."""

import glob

import __spark_entry__ as entry
import duckdb
import pytest


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        c.sql(f"create view {f.rsplit('/', 1)[1][:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, con, sf_dir, name):
    got = entry.queries()[name](spark, sf_dir).toPandas()
    want = con.sql(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    rows = lambda df: sorted((tuple(None if x is None or x != x else round(float(x), 6) if isinstance(x, float) else str(x) for x in r) for r in df[cols].itertuples(index=False)), key=str)
    assert rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).columns


def test_all_other_queries_are_registered():
    from quarry.plans import queries

    assert set(queries.QUERIES) <= set(entry.queries()) and set(queries.ORACLES) <= set(queries.QUERIES)
