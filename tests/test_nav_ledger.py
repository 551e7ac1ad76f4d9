import datetime as dt
from datetime import datetime, timedelta

import duckdb
import numpy as np
import pandas as pd
import pytest

from tidewater.operators import ledger, nav
from tidewater.plans import catalog, queries_nav  # noqa: F401 (the second registers its queries)


def _nav(spark, values, start="2024-01-01"):
    d0 = dt.date.fromisoformat(start)
    return spark.createDataFrame([("all", d0 + dt.timedelta(days=i), float(v)) for i, v in enumerate(values)], "portfolio string, date date, assets double")


def test_metrics_against_numpy(spark):
    rng = np.random.default_rng(5)
    a = 100 * np.cumprod(1 + rng.normal(0.001, 0.02, 60))
    m = nav.metrics(_nav(spark, a), ["portfolio"]).first()
    r = a[1:] / a[:-1] - 1
    peak = np.maximum.accumulate(a)
    assert m["return_rate"] == pytest.approx(a[-1] / a[0] - 1)
    assert m["volatility"] == pytest.approx(r.std() * np.sqrt(252))
    assert m["max_drawdown"] == pytest.approx(((peak - a) / peak).max())
    assert m["var"] == pytest.approx(-np.percentile(r, 5))
    assert m["cvar"] == pytest.approx(-np.sort(r)[: max(1, int(0.05 * len(r)))].mean())
    assert m["trough_date"] == dt.date(2024, 1, 1) + dt.timedelta(days=int(((peak - a) / peak).argmax()))


def test_short_and_rising(spark):
    one = nav.metrics(_nav(spark, [100]), ["portfolio"]).first()
    assert one["return_rate"] is None and one["volatility"] is None
    up = nav.metrics(_nav(spark, [100, 101, 103]), ["portfolio"]).first()
    assert up["sortino_ratio"] == float("inf") and up["max_drawdown"] is None


def test_periods_fall_back_to_all(spark):
    d = _nav(spark, range(100, 140))
    got = {r["period"]: r["n"] for r in nav.slices(d, ["1m", "5y", "all", "ytd"]).groupBy("period").count().withColumnRenamed("count", "n").collect()}
    assert got["5y"] == got["all"] == 40
    assert got["1m"] == 33  # 9 January is the start and 8 January the base
    assert got["ytd"] == 40


def test_benchmark_is_carried_over_zeros_and_gaps(spark):
    d = _nav(spark, [1, 2, 3, 4])
    b = spark.createDataFrame([(dt.date(2024, 1, 1), 5.0), (dt.date(2024, 1, 2), 0.0), (dt.date(2024, 1, 4), 6.0)], "date date, close double")
    assert [r["benchmark"] for r in nav.align_benchmark(d, b).orderBy("date").collect()] == [5.0, 5.0, 5.0, 6.0]


def _trades(spark, rows):
    t = datetime.fromisoformat("2024-01-01")
    return spark.createDataFrame([(i, t + timedelta(days=i), "s", float(p), float(v), side, float(f)) for i, (p, v, side, f) in enumerate(rows)], "seq int, created_at timestamp, symbol string, price double, volume double, side string, fee double")


def test_round_trips_average_cost(spark):
    d = _trades(spark, [(10, 100, "buy", 5), (12, 100, "buy", 5), (15, 100, "sell", 6), (16, 100, "sell", 6), (9, 50, "sell", 5), (20, 10, "buy", 5)])
    got = [r.asDict() for r in ledger.round_trips(d).orderBy("close_time").collect()]
    assert [round(x["profit"], 6) for x in got] == [1500 - 1105 - 6, 1600 - 1105 - 6]
    assert [x["open_price"] for x in got] == [10.0, 10.0] and [x["open_fee"] for x in got] == [2.5, 2.5]


def test_replay_conserves_cash(spark):
    t = datetime.fromisoformat("2024-01-01")
    rows = [("a", t, 0, "s", 1, 10.0, 100.0), ("a", t, 1, "s", 2, 11.0, 50.0), ("a", t, 2, "s", 2, 11.0, 500.0), ("a", t, 3, "z", 1, 1e9, 1.0)]
    d = spark.createDataFrame(rows, "account string, created_at timestamp, seq int, symbol string, side int, price double, volume double")
    got = ledger.replay(d, 10_000.0).orderBy("seq").collect()
    assert [r["filled_volume"] for r in got] == [100.0, 50.0, 0.0, 0.0]
    assert got[-1]["cash"] == pytest.approx(10_000 - 1005 + 550 - ledger.fees(11.0, 50, 2))
    assert got[0]["cost_price"] == 10.05 and got[-1]["holding"] == 0.0


def test_replay_percent_orders(spark):
    t = datetime.fromisoformat("2024-01-01")
    d = spark.createDataFrame([("a", t, 0, "s", 1, 10.0, None, 0.5), ("a", t, 1, "s", 2, 10.0, None, 1.0)], "account string, created_at timestamp, seq int, symbol string, side int, price double, volume double, percent double")
    got = ledger.replay(d, 10_000.0).orderBy("seq").collect()
    assert [r["filled_volume"] for r in got] == [499.0, 499.0]


def test_the_latest_bar_decides(spark):
    from datetime import datetime

    from tidewater.operators import asof

    t = lambda h: datetime(2024, 1, 1, h)
    rows = [("s", "60s", t(1), 10.0), ("s", "60s", t(2), 0.0), ("s", "1d", t(0), 7.0), ("r", "60s", t(1), None), ("r", "1d", t(0), 5.0), ("q", "60s", t(1), -1.0)]
    b = spark.createDataFrame(rows, "symbol string, frequency string, eob timestamp, close double")
    asked = spark.createDataFrame([("s", t(1)), ("s", t(3)), ("r", t(3)), ("q", t(3)), ("x", t(3)), ("s", datetime(2023, 1, 1))], "symbol string, at timestamp")
    got = {(r["symbol"], r["at"]): r["price"] for r in asof.latest_price(asked, b).collect()}
    assert got == {("s", t(1)): 10.0, ("s", t(3)): 7.0, ("r", t(3)): 5.0, ("q", t(3)): None, ("x", t(3)): None, ("s", datetime(2023, 1, 1)): None}


def test_refused_orders_take_no_number(spark):
    from datetime import datetime

    from tidewater.operators import ledger

    t = datetime(2024, 1, 1)
    rows = [("a", t, 1, "s", 1, 10.0, 1e9), ("a", t, 2, "s", 1, 10.0, 100.0), ("a", t, 3, "s", 2, 10.0, 200.0), ("a", t, 4, "s", 2, 10.0, 100.0), ("a", t, 5, "s", 1, 10.0, 0.0)]
    got = ledger.replay(spark.createDataFrame(rows, "account string, created_at timestamp, seq long, symbol string, side int, price double, volume double"), 10_000.0)
    assert [(r["order_id"], r["filled_volume"]) for r in got.orderBy("seq").collect()] == [("order_1", 0.0), ("order_1", 100.0), ("order_2", 0.0), ("order_2", 100.0), (None, 0.0)]


def test_metrics_of_few_days_are_null(spark):
    from datetime import date

    from tidewater.operators import nav

    rows = [("one", date(2024, 1, 1), 5.0), ("two", date(2024, 1, 1), 4.0), ("two", date(2024, 1, 2), 5.0), ("three", date(2024, 1, 1), 4.0), ("three", date(2024, 1, 2), 5.0), ("three", date(2024, 1, 3), 6.0)]
    got = {r["portfolio"]: r for r in nav.metrics(spark.createDataFrame(rows, "portfolio string, date date, assets double"), ["portfolio"]).collect()}
    known = lambda k: {n for n in ("return_rate", "annualized_return", "volatility", "var", "cvar", "ulcer_index", "sortino_ratio", "sharpe_ratio", "upi") if got[k][n] is not None}
    assert known("one") == set() and known("two") == {"return_rate", "annualized_return", "ulcer_index"}
    assert known("three") == {"return_rate", "annualized_return", "volatility", "var", "cvar", "ulcer_index", "sortino_ratio", "sharpe_ratio"} and got["three"]["sortino_ratio"] == float("inf")


def test_folds_carry_any_type(spark):
    from decimal import Decimal

    from tidewater.functions.folds import folded

    rows = [(float("nan"), 1, Decimal("1.50"), [1, 2], {"a": (1, b"x")}), (float("nan"), 2, Decimal("2.50"), None, None), (None, 1, None, [], {})]
    schema = "k double, i int, d decimal(9,2), xs array<int>, m map<string, struct<p: int, q: binary>>"
    got = folded(spark.createDataFrame(rows, schema), ["k"], ["i"], lambda: [0], lambda s, r: (s.__setitem__(0, s[0] + 1), [(*r, s[0])])[1], schema + ", n int").collect()
    assert sorted((r["n"], str(r["d"])) for r in got) == [(1, "1.50"), (1, "None"), (2, "2.50")]
    assert next(r for r in got if r["n"] == 1 and r["d"] is not None)["m"]["a"]["q"] == b"x"


def _plain_trips(rows):
    """Clipped round trips of one symbol, trade by trade."""
    held = cost = fee0 = 0.0
    opened, out = None, []
    for i, (p, v, side, f) in enumerate(rows):
        if side == "buy":
            if held == 0:
                opened, fee0, cost = p, f, 0.0
            held, cost = held + v, cost + v * p + f
        elif held > 0:
            q = min(v, held)
            share = q / held
            out.append((i, q * p - share * cost - f, opened, share * fee0, q))
            held, cost, fee0 = held - q, cost - share * cost, fee0 - share * fee0
    return out


@pytest.mark.parametrize("kind", ["mixed", "never flat"])
def test_clipped_round_trips_by_windows(spark, kind):
    import random

    rng = random.Random(7)
    if kind == "mixed":
        rows = [(rng.randint(1, 50), rng.randint(1, 9) * 100, rng.choice(["buy", "sell"]), rng.randint(0, 7)) for _ in range(400)]
    else:  # what is left of the first cost falls far below the smallest number
        rows = [(10, 64_000_000, "buy", 3)] + [(rng.randint(5, 20), v, side, 1) for _ in range(900) for side, v in (("sell", 63_999_936), ("buy", 63_999_936))]
    got = sorted(((r["close_time"] - datetime.fromisoformat("2024-01-01")).days, r["profit"], r["open_price"], r["open_fee"], r["volume"]) for r in ledger.clipped_round_trips(_trades(spark, rows)).collect())
    want = _plain_trips(rows)
    assert [(g[0], g[2], g[4]) for g in got] == [(w[0], w[2], w[4]) for w in want]
    assert all(g[1] == pytest.approx(w[1], rel=1e-9, abs=1e-6) and g[3] == pytest.approx(w[3], rel=1e-9, abs=1e-12) for g, w in zip(got, want))
    assert "MapInArrow" not in ledger.clipped_round_trips(_trades(spark, rows))._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("price", [7.5, 0.0])
def test_trade_metrics_of_odd_trades_match_sql(spark, tmp_path, price):
    """A trip of a day less half a second is of no whole day, and one opened for nothing has an infinite share, as in the SQL."""
    at = lambda day, second: datetime(2024, 1, 1 + day) + timedelta(seconds=second)
    rows = [(0, at(0, 60.7), 1, "view", 10.0), (1, at(1, 60.2), 1, "error", 12.0), (2, at(0, 0.2), 2, "view", 20.0), (3, at(2, 0.7), 2, "click", 9.0), (4, at(0, 5.0), 3, "view", price), (5, at(3, 4.9), 3, "click", 8.0)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    for name in ("trade_metrics", "trade_metrics_legacy"):
        got, want = catalog.QUERIES[name](spark, str(tmp_path)).toPandas(), con.execute(catalog.ORACLES[name]).fetchdf()
        assert got[want.columns].values.tolist() == want.values.tolist()
