"""Two-level scans against windows and plain loops, and that one series uses several tasks."""

import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewater.functions import scans
from tidewater.functions.windows import Series
from tidewater.operators import signals

SCHEMA = "symbol string, frequency string, eob timestamp, close double, high double, low double"


@pytest.fixture(scope="module")
def frame(spark):
    """Series of a year, of a few rows with gaps of months, of one row, and of a null key."""
    rng = random.Random(3)
    rows, t0 = [], datetime(2023, 1, 1)
    for symbol, n, step in (("long", 700, 12), ("gaps", 9, 24 * 47), ("one", 1, 1), (None, 40, 24)):
        x = 100.0
        for i in range(n):
            x *= 1 + rng.uniform(-0.03, 0.03)
            rows.append((symbol, "1h", t0 + timedelta(hours=i * step), x if rng.random() < 0.9 else x, x * 1.01, x * 0.99))
    return spark.createDataFrame(rows, SCHEMA).cache()


def _rows(df, *cols):
    show = lambda v: None if v is None else float(f"{v:.9g}") + 0.0 if isinstance(v, float) and abs(v) > 1e-12 else 0.0 if isinstance(v, float) else v
    return sorted(((str(r["symbol"]), str(r["eob"]), *(show(r[c]) for c in cols)) for r in df.collect()), key=repr)


@pytest.mark.parametrize("unit", ["month", "week", "year"])
def test_running_equals_windows(frame, unit):
    s = signals.BARS
    x = F.when(F.hour("eob") % 3 != 1, F.col("close") / 100)
    kinds = ("sum", "count", "product", "max", "min", "last")
    got = scans.running(frame, s, {k: (k, x) for k in kinds}, unit)
    want = frame.withColumn("_x", x).withColumns({"sum": F.sum("_x").over(s.so_far), "count": F.count("_x").over(s.so_far), "product": F.product("_x").over(s.so_far), "max": s.cum_max("_x"), "min": F.min("_x").over(s.so_far), "last": s.ffill("_x")})
    assert _rows(got, *kinds) == _rows(want, *kinds)
    assert set(got.columns) == {*frame.columns, *kinds}


@pytest.mark.parametrize("unit", ["month", "week", "year"])
def test_exponential_means(frame, unit):
    got = scans.ewm(frame, signals.BARS, {"a": (F.col("close"), scans.keep_of(span=12)), "b": (F.col("close"), scans.keep_of(com=2)), "c": (F.col("close"), scans.keep_of(span=1)), "d": (F.col("close"), scans.keep_of(span=900))}, unit).toPandas()
    for _, g in got.fillna({"symbol": "none"}).groupby("symbol"):
        g = g.sort_values("eob")
        for c, alpha in (("a", 2 / 13), ("b", 1 / 3), ("c", 1.0), ("d", 2 / 901)):
            want = g["close"].ewm(alpha=alpha, adjust=True).mean()
            assert ((g[c] - want).abs() / want).max() < 1e-11


def test_exponential_means_of_blocks_shorter_than_a_chunk(spark):
    n = 3000  # the scaled values of one chunk would overflow
    rows = [("s", i, float(i % 17)) for i in range(n)]
    d = spark.createDataFrame(rows, "symbol string, k long, x double")
    got = scans.ewm(d, Series(["symbol"], ["k"]), {"y": (F.col("x"), 0.5)}, unit=2500.0).toPandas().sort_values("k")
    want = pd.Series([r[2] for r in rows]).ewm(alpha=0.5).mean()
    assert (got["y"].to_numpy() - want.to_numpy()).__abs__().max() < 1e-12


def test_scanned_signals_equal_plain_ones(frame):
    assert _rows(signals.macd_scanned(frame), "macd") == _rows(signals.macd(frame), "macd")
    assert _rows(signals.kdj_scanned(frame, chunk=64), "kdj") == _rows(signals.kdj(frame), "kdj")
    held = frame.withColumn("p", F.signum(F.sin(F.unix_timestamp("eob") / 1e5)))
    assert _rows(signals.strategy_returns_scanned(held, "p", chunk=64), "strategy", "growth") == _rows(signals.strategy_returns(held, "p"), "strategy", "growth")


def _plain_dual(values, el, es, xl, xs):
    p, out = 0, []
    for v in values:
        if v is not None:
            if p == 0:
                p = 1 if v > el else -1 if v < es else 0
            elif p == 1 and v < xs:
                p = -1
            elif p == -1 and v > xl:
                p = 1
        out.append(p)
    return out


@pytest.mark.parametrize("bounds", [(0.3, -0.3, -0.2, 0.2), (0.1, -0.4, -0.5, 0.6), (2.0, -2.0, -0.1, 0.0), (0.5, -0.5, 0.4, -0.4)])
def test_positions_with_any_exits(spark, bounds):
    rng = random.Random(repr(bounds))
    rows = [(s, "1d", datetime(2024, 1, 1) + timedelta(days=i), rng.choice([None, rng.uniform(-1, 1), rng.uniform(-0.3, 0.3)])) for s in "abc" for i in range(120)]
    d = spark.createDataFrame(rows, "symbol string, frequency string, eob timestamp, x double").withColumns({"price": F.lit("1.5").cast("decimal(9,2)"), "xs": F.array(F.lit(1))})
    want = sorted((s, str(r[2]), p) for s in "abc" for r, p in zip((q for q in rows if q[0] == s), _plain_dual([q[3] for q in rows if q[0] == s], *bounds)))
    for got in (signals.thr_dual(d, "x", *bounds), signals.thr_dual_scanned(d, "x", *bounds, unit="week")):
        assert sorted((r["symbol"], str(r["eob"]), r["position"]) for r in got.collect()) == want


def test_one_series_uses_several_tasks(spark, frame):
    one = frame.where("symbol = 'long'")
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for d in (signals.macd_scanned(one), signals.thr_dual_scanned(one, "close", 1.0, 0.5, 0.2, 0.9)):
            assert len({r[0] for r in d.select(F.spark_partition_id()).distinct().collect()}) > 1
            assert "ArrowEval" not in d._jdf.queryExecution().executedPlan().toString() and "MapInArrow" not in d._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
