"""Every registered query of the library against its SQL on the smallest tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

from bazaarflow.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return con


def value(v):
    if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and math.isnan(v):
        return None
    v = v.item() if hasattr(v, "item") else v
    if isinstance(v, float):
        return int(v) if v == int(v) else round(v, 5)
    return v


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(([str(value(v)) for v in r] for r in frame.itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).columns
    QUERIES[name](spark, SF).count()


def test_entry_points(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() >= 0
