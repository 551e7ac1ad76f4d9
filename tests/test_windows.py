import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewater.functions.stats import rounded, safe_corr, t_p_value
from tidewater.functions.windows import Series, avg_rank, quantile_bucket, with_overlap
from tidewater.functions.stats import nan_to_null

S = Series("k", "t")


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(3)
    p = pd.DataFrame({"k": ["a"] * 40 + ["b"] * 25, "t": [*range(40), *range(25)], "x": rng.normal(10, 2, 65)})
    return p, spark.createDataFrame(p)


def _same(df, want, col="y"):
    got = df.orderBy("k", "t").toPandas()[col].to_numpy(float)
    np.testing.assert_allclose(got, want.to_numpy(float), rtol=1e-9, atol=1e-9, equal_nan=True)


@pytest.mark.parametrize("name", ["mean", "std", "min", "max"])
def test_rolling(frame, name):
    p, d = frame
    want = p.groupby("k").x.transform(lambda x: getattr(x.rolling(7), name)())
    _same(d.withColumn("y", getattr(S, name)("x", 7)), want)


def test_rolling_skips_nulls(spark):
    d = spark.createDataFrame([("a", i, None if i == 3 else float(i)) for i in range(8)], "k string, t int, x double")
    got = [r["y"] for r in d.withColumn("y", S.mean("x", 3)).orderBy("t").collect()]
    assert got == [None, None, 1.0, None, None, None, 5.0, 6.0]


@pytest.mark.parametrize("how", [{"span": 12}, {"com": 2}, {"com": 0}])
def test_ewm(frame, how):
    p, d = frame
    _same(d.withColumn("y", S.ewm("x", **how)), p.groupby("k").x.transform(lambda x: x.ewm(**how).mean()))


def test_changes_and_cumulation(frame):
    p, d = frame
    g = p.groupby("k").x
    _same(d.withColumn("y", S.pct_change("x", 3)), g.pct_change(3))
    _same(d.withColumn("y", S.cum_max("x")), g.cummax())
    _same(d.withColumn("y", S.cum_prod(F.col("x") / 10)), (p.x / 10).groupby(p.k).cumprod())


def test_avg_rank_and_safe_corr(spark):
    rng = np.random.default_rng(0)
    p = pd.DataFrame({"d": [1] * 30, "x": rng.integers(0, 8, 30).astype(float), "y": rng.normal(size=30)})
    d = spark.createDataFrame(p).withColumns({"rx": avg_rank("x", ["d"]), "ry": avg_rank("y", ["d"])})
    assert d.agg(safe_corr("rx", "ry")).first()[0] == pytest.approx(p.x.rank().corr(p.y.rank()))
    assert spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double").agg(safe_corr("a", "b")).first()[0] is None


@pytest.mark.parametrize("n", [9, 10, 23, 57])
def test_buckets_follow_interpolated_edges(spark, n):
    p = pd.DataFrame({"d": 1, "s": range(n), "x": np.random.default_rng(n).permutation(n).astype(float)})
    got = spark.createDataFrame(p).withColumn("b", quantile_bucket("x", "s", ["d"], 10)).toPandas()
    if n < 10:
        assert got.b.isna().all()
    else:
        want = pd.qcut(p.x.rank(method="first"), 10, labels=False) + 1
        assert (got.sort_values("s").b.to_numpy() == want.to_numpy()).all()


def test_nan_becomes_null(spark):
    d = nan_to_null(spark.createDataFrame([(float("nan"), "a"), (1.0, "b")], "x double, s string"))
    assert {(r["x"], r["s"]) for r in d.collect()} == {(None, "a"), (1.0, "b")}


def test_rounded_has_no_negative_zero(spark):
    assert str(spark.createDataFrame([(-1e-9,)], "x double").select(rounded("x")).first()[0]) == "0.0"


def test_t_p_value():
    assert t_p_value(2.0, 11) == pytest.approx(0.0733880, abs=1e-6)
    assert t_p_value(0.0, 5) == pytest.approx(1.0)


def test_chunks_with_overlap_give_the_same_windows(spark):
    d = spark.range(1000).select(F.lit("a").alias("k"), F.col("id").alias("t"), (F.col("id") % 17).cast("double").alias("x"))
    whole = {r["t"]: r["y"] for r in d.withColumn("y", S.mean("x", 8)).collect()}
    cut = with_overlap(d, ["k"], "t", 7, chunk=100).withColumn("y", Series(["k", "_chunk"], "t").mean("x", 8)).where("not _warm")
    assert {r["t"]: r["y"] for r in cut.collect()} == whole
    assert cut.select("_chunk").distinct().count() == 10
