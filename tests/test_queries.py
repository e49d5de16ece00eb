"""Every registered product-feed query against its SQL on the smallest driver tables."""

import os

import duckdb
import pandas as pd
import pytest

from feedlake.plans import catalog_queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables are not here")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DATA}/{f}'")
    return con


def plain(value):
    if value is None or value is pd.NaT or value is pd.NA or (isinstance(value, float) and value != value):
        return ""
    if hasattr(value, "year"):
        return str(value)[:10]
    return str(round(float(value), 6)) if isinstance(value, (int, float)) or hasattr(value, "dtype") else str(value)


def listed(frame):
    frame = frame[sorted(frame.columns)].map(plain)
    return list(frame.columns), sorted(map(tuple, frame.to_numpy()))


@pytest.mark.parametrize("name", sorted(catalog_queries.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    want = con.execute(catalog_queries.oracle_sql()[name]).df()
    got = catalog_queries.queries()[name](spark, DATA).toPandas()
    assert listed(got) == listed(want)


@pytest.mark.parametrize("name", sorted(set(catalog_queries.queries()) - set(catalog_queries.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert catalog_queries.queries()[name](spark, DATA).columns
