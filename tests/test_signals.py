from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest

from tidewater.operators import asof, signals


def _bars(spark, close, high=None, low=None):
    n = len(close)
    rows = [("s", "1d", datetime.fromisoformat("2024-01-01") + timedelta(days=i), float(close[i]), float((high or close)[i]), float((low or close)[i]), 10.0 + i) for i in range(n)]
    return spark.createDataFrame(rows, "symbol string, frequency string, eob timestamp, close double, high double, low double, volume double")


def _col(df, name):
    return [r[name] for r in df.orderBy("eob").collect()]


def test_constant_price_is_neutral(spark):
    d = _bars(spark, [5.0] * 30)
    d = signals.boll(signals.kdj(signals.rsi(d)))
    assert set(_col(d, "rsi")) == {0.0}
    assert max(map(abs, _col(d, "kdj"))) < 1e-12
    assert set(_col(d, "boll")) == {0.0}


def test_rising_price_has_full_strength(spark):
    got = _col(signals.rsi(_bars(spark, range(1, 31))), "rsi")
    assert got[:13] == [0.0] * 13 and got[13:] == [50.0] * 17


def test_short_series(spark):
    d = _bars(spark, [1.0, 2.0, 3.0])
    assert _col(signals.ma_cross(d), "ma") == [None] * 3
    assert _col(signals.rsrs(d), "rsrs") == [0.0] * 3


def test_rsrs_scales_the_slope(spark):
    rng = np.random.default_rng(1)
    low = (10 + rng.normal(size=40).cumsum()).tolist()
    high = [x * 1.1 + e for x, e in zip(low, rng.normal(size=40))]
    got = _col(signals.rsrs(_bars(spark, low, high, low)), "rsrs")
    h, lo = np.array(high), np.array(low)
    want = np.polyfit(lo[22:40], h[22:40], 1)[0] * 18 / 17
    assert got[-1] == pytest.approx(want)


def _loop(v, el, es, xl, xs):
    p, out = 0, []
    for x in v:
        if x is not None:
            if p == 0:
                p = 1 if x > el else -1 if x < es else 0
            elif p == 1 and x < xs:
                p = -1
            elif p == -1 and x > xl:
                p = 1
        out.append(p)
    return out


@pytest.mark.parametrize("exits", [(0.3, -0.3), (-0.2, 0.2)])
def test_dual_threshold(spark, exits):
    rng = np.random.default_rng(2)
    v = [None if rng.random() < 0.1 else float(x) for x in rng.normal(size=120)]
    rows = [("s", "1d", datetime.fromisoformat("2024-01-01") + timedelta(days=i), x) for i, x in enumerate(v)]
    d = spark.createDataFrame(rows, "symbol string, frequency string, eob timestamp, x double")
    got = _col(signals.thr_dual(d, "x", 1.0, -1.0, *exits), "position")
    assert got == _loop(v, 1.0, -1.0, *exits)


def test_templates_and_registry(spark):
    assert len(signals.TEMPLATES) == 17
    d = signals.apply_signal(_bars(spark, range(1, 40)), "macd_fast")
    assert "macd_fast" in d.columns
    with pytest.raises(ValueError):
        signals.apply_signal(d, "nothing")


def test_vote_strength(spark):
    d = spark.createDataFrame([(1.0, 2.0, -1.0), (None, None, 0.0), (1.0, -1.0, 0.0)], "a double, b double, c double")
    got = [(r["direction"], round(r["strength"], 3)) for r in signals.vote_with_strength(d, ["a", "b", "c"]).collect()]
    assert got == [(1, 0.667), (0, 1.0), (0, 0.333)]


def test_asof_prefers_the_finer_frequency(spark):
    t = datetime.fromisoformat
    bars = spark.createDataFrame([("s", "1d", t("2024-01-01"), 1.0), ("s", "60m", t("2024-01-01 10:00"), 2.0), ("s", "60m", t("2024-01-01 11:00"), 0.0)], "symbol string, frequency string, eob timestamp, close double")
    q = spark.createDataFrame([("s", t("2024-01-01 09:00")), ("s", t("2024-01-01 10:30")), ("s", t("2024-01-01 12:00")), ("s", t("2023-12-31")), ("z", t("2024-01-02"))], "symbol string, at timestamp")
    got = {(r["symbol"], r["at"]): r["price"] for r in asof.latest_price(q, bars).collect()}
    # At noon the latest finer bar has no price, so the coarser one counts and not an older finer bar.
    assert [got["s", t("2024-01-01 09:00")], got["s", t("2024-01-01 10:30")], got["s", t("2024-01-01 12:00")], got["s", t("2023-12-31")], got["z", t("2024-01-02")]] == [1.0, 2.0, 1.0, None, None]
