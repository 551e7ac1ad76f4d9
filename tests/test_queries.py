"""Every query with SQL gives the rows that DuckDB gives."""

import os
from datetime import datetime

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from tidewater.plans import catalog

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for f in os.listdir(SF):
        c.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return c


def _rows(df: pd.DataFrame) -> list:
    show = lambda v: "" if v is None or v is pd.NaT or v != v else repr(float(v)) if isinstance(v, float) else str(v)
    return sorted(tuple(show(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_sql(spark, con, name):
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), con.execute(catalog.ORACLES[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got) == _rows(want)


def test_entry(spark):
    d = entry.entry(spark)
    assert d.count() > 0 and "position" in d.columns
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_one_shuffle_for_nested_windows(spark):
    from tidewater.operators import signals

    d = spark.createDataFrame([("a", "1d", datetime.fromisoformat("2024-01-01"), 1.0, 1.0, 1.0)], "symbol string, frequency string, eob timestamp, close double, high double, low double")
    plan = signals.kdj(d)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
