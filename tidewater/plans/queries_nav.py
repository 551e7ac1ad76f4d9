"""Queries on net asset values, benchmarks, trades and the ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.stats import rounded
from tidewater.operators import asof, ledger, nav, strategy
from tidewater.plans.catalog import query, r
from tidewater.sources import bars

KEYS = ["portfolio"]

RET = "SELECT date, assets, assets / lag(assets) OVER (ORDER BY date) - 1 AS r, max(assets) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS peak FROM nav"
NAMES = ("return_rate", "annualized_return", "volatility", "sharpe_ratio", "max_drawdown", "var", "cvar", "ulcer_index", "sortino_ratio", "upi")


def _nav(spark, d) -> DataFrame:
    return nav.with_portfolio(bars.order_nav(spark, d))


def _rounded(df: DataFrame, names, digits: int = 6) -> list:
    return [rounded(n, digits).alias(n) for n in names]


@query("nav_daily", "WITH {nav} SELECT * FROM nav", dates=("date",))
def nav_daily(spark, d):
    return bars.order_nav(spark, d)


@query("nav_from_snapshots", "SELECT CAST(ts AS DATE) AS date, arg_max(value, ts) AS assets FROM events GROUP BY 1", dates=("date",))
def nav_from_snapshots(spark, d):
    return nav.daily_assets(bars.read(spark, d, "events").select(F.col("ts").alias("created_at"), F.col("event_id").alias("seq"), F.col("value").alias("nav")))


@query("nav_returns", f"WITH {{nav}}, x AS ({RET}) SELECT date, {r('r')} AS r, {r('(peak - assets) / peak')} AS dd FROM x", dates=("date",))
def nav_returns(spark, d):
    return nav.returns(_nav(spark, d), KEYS).select("date", *_rounded(None, ["r", "dd"]))


def _metrics_sql(source: str, extra: str = "", group: str = "") -> str:
    """Metrics of slices in ``source(date, assets, g)``, one row for each ``g``."""
    return f"""x AS (SELECT g, date, assets, assets / lag(assets) OVER (PARTITION BY g ORDER BY date) - 1 AS r, max(assets) OVER (PARTITION BY g ORDER BY date ROWS UNBOUNDED PRECEDING) AS peak FROM {source}),
y AS (SELECT *, (peak - assets) / peak AS dd, count(r) OVER (PARTITION BY g) AS n, row_number() OVER (PARTITION BY g ORDER BY r NULLS LAST, date) AS k FROM x),
a AS (SELECT g, count(*) AS n_days, (arg_max(assets, date) - arg_min(assets, date)) / arg_min(assets, date) AS return_rate, date_diff('day', min(date), max(date)) AS days, stddev_pop(r) * sqrt(252) AS volatility,
  max(dd) AS dd, -quantile_cont(r, 0.05) AS q, -avg(r) FILTER (k <= greatest(1, floor(n * 0.05 + 1e-9)) AND r IS NOT NULL) AS tail, sqrt(avg((dd * 100) ** 2)) AS ui, count(r) AS m, count(*) FILTER (r < 0) AS losses,
  sqrt(avg(CASE WHEN r < 0 THEN r * r WHEN r IS NOT NULL THEN 0.0 END)) AS down FROM y GROUP BY g),
guarded AS (SELECT * REPLACE (CASE WHEN n_days >= 2 THEN return_rate END AS return_rate, CASE WHEN m >= 2 THEN volatility END AS volatility), CASE WHEN dd > 0 THEN dd END AS max_drawdown, CASE WHEN m >= 2 THEN q END AS var, CASE WHEN m >= 2 THEN tail END AS cvar, CASE WHEN n_days >= 2 THEN ui END AS ulcer_index FROM a),
yearly AS (SELECT *, CASE WHEN return_rate IS NULL THEN NULL WHEN days = 0 THEN 0 WHEN return_rate > -1 THEN pow(1 + return_rate, 365.0 / days) - 1 END AS annualized_return FROM guarded),
z AS (SELECT *, (annualized_return - 0.02) / nullif(volatility, 0) AS sharpe_ratio, CASE WHEN m < 2 OR annualized_return IS NULL THEN NULL WHEN losses = 0 THEN 'inf'::DOUBLE ELSE (annualized_return - 0.02) / (down * sqrt(252)) END AS sortino_ratio, (annualized_return - 0.02) / (nullif(ulcer_index, 0) / 100) AS upi FROM yearly)
SELECT {group}n_days, {', '.join(f'{r(n)} AS {n}' for n in NAMES)}{extra} FROM z"""


@query("nav_metrics", "WITH {nav}, s AS (SELECT 1 AS g, * FROM nav), " + _metrics_sql("s", ", t.date AS trough_date").replace(" FROM z", " FROM z, (SELECT date FROM y ORDER BY dd DESC, date LIMIT 1) t"), dates=("trough_date",))
def nav_metrics(spark, d):
    x = nav.metrics(_nav(spark, d), KEYS)
    return x.select("n_days", *_rounded(x, NAMES), "trough_date")


@query(
    "nav_periods",
    "WITH {nav}, f AS (SELECT max(date) AS last, min(date) AS first FROM nav), "
    "w AS (SELECT p, CASE WHEN p = 'ytd' THEN CAST(date_trunc('year', last) AS DATE) ELSE CAST(last - to_months(m) AS DATE) END AS since, first FROM f, (VALUES ('1m', 1), ('3m', 3), ('1y', 12), ('ytd', NULL), ('all', NULL)) v(p, m)), "
    "b AS (SELECT p, coalesce(CASE WHEN p = 'ytd' THEN (SELECT min(date) FROM nav WHERE date >= since) ELSE (SELECT max(date) FROM nav WHERE date <= since AND date > first) END, (SELECT min(date) FROM nav WHERE date > first)) AS start FROM w), "
    "c AS (SELECT p, coalesce((SELECT max(date) FROM nav WHERE date < start), (SELECT first FROM f)) AS base FROM b), "
    "s AS (SELECT p AS g, date, assets FROM nav, c WHERE date >= base), " + _metrics_sql("s", group="g AS period, "),
)
def nav_periods(spark, d):
    x = nav.metrics(nav.slices(_nav(spark, d), ["1m", "3m", "1y", "ytd", "all"]), ["portfolio", "period"])
    return x.select("period", "n_days", *_rounded(x, NAMES))


_LOGS = ("annualized_return", "sharpe_ratio", "sortino_ratio", "upi")


@query(
    "nav_short_slices",
    "WITH {nav}, w AS (SELECT *, row_number() OVER (ORDER BY date) AS i FROM nav), s AS (SELECT k AS g, date, assets FROM w, range(1, 6) t(k) WHERE i > 10 AND i <= 10 + k), "
    + _metrics_sql("s").rsplit("\nSELECT", 1)[0] + " SELECT g AS n, n_days, " + ", ".join(f"{r(f'sign({x}) * ln(1 + abs({x}))' if x in _LOGS else x)} AS {x}" for x in NAMES) + " FROM z",
)
def nav_short_slices(spark, d):
    """Slices of one to five days from the eleventh on: what is defined of so few. Figures of a year are given as logarithms."""
    days = _nav(spark, d).withColumn("_i", F.row_number().over(Window.partitionBy("portfolio").orderBy("date"))).where(F.col("_i").between(11, 15))
    x = nav.metrics(days.withColumn("n", F.explode(F.sequence(F.col("_i") - 10, F.lit(5)))).withColumn("n", F.col("n").cast("long")), ["portfolio", "n"])
    x = x.withColumns({n: F.signum(n) * F.log(1 + F.abs(n)) for n in _LOGS})
    return x.select("n", "n_days", *_rounded(x, NAMES))


@query("nav_between", "WITH {nav}, s AS (SELECT 1 AS g, * FROM nav WHERE date >= (SELECT max(date) FROM nav WHERE date < DATE '1996-01-01') AND date <= DATE '1996-12-31'), " + _metrics_sql("s"))
def nav_between(spark, d):
    x = nav.metrics(nav.between(_nav(spark, d), "1996-01-01", "1996-12-31"), KEYS)
    return x.select("n_days", *_rounded(x, NAMES))


@query("nav_drawdown", f"WITH {{nav}}, x AS ({RET}) SELECT date, {r('-100 * (peak - assets) / peak')} AS drawdown FROM x", dates=("date",))
def nav_drawdown(spark, d):
    return nav.drawdowns(_nav(spark, d), KEYS).select("date", rounded("drawdown").alias("drawdown"))


ALIGNED = "{nav}, {bench}, al AS (SELECT date, assets, last_value(nullif(close, 0) IGNORE NULLS) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS benchmark FROM nav LEFT JOIN bench USING (date))"


@query("benchmark_align", f"WITH {ALIGNED} SELECT date, assets, benchmark FROM al", dates=("date",))
def benchmark_align(spark, d):
    return nav.align_benchmark(_nav(spark, d), bars.ship_benchmark(spark, d)).select("date", "assets", "benchmark")


@query(
    "nav_excess",
    f"WITH {ALIGNED}, p AS (SELECT date, 100 * (assets / first_value(assets) OVER w - 1) AS s, 100 * (benchmark / first_value(benchmark IGNORE NULLS) OVER w - 1) AS b FROM al WINDOW w AS (ORDER BY date ROWS UNBOUNDED PRECEDING)), "
    f"e AS (SELECT *, s - b AS x FROM p) SELECT date, {r('s')} AS strategy_pct, {r('b')} AS benchmark_pct, {r('x')} AS excess_pct, {r('x - max(x) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING)')} AS excess_drawdown FROM e",
    dates=("date",),
)
def nav_excess(spark, d):
    x = nav.excess(nav.align_benchmark(_nav(spark, d), bars.ship_benchmark(spark, d)), KEYS)
    return x.select("date", *_rounded(x, ["strategy_pct", "benchmark_pct", "excess_pct", "excess_drawdown"]))


CLIENT = ("return_rate", "annualized_return", "volatility", "max_drawdown", "sharpe_ratio", "sortino_ratio", "var", "cvar", "ulcer_index", "upi", "benchmark_return", "benchmark_max_drawdown", "relative_return")


def _client_sql(source: str, group: str = "") -> str:
    """Metrics of the browser report of slices in ``source(date, assets, benchmark, g)``; a slice's first day is its base."""
    w = "(PARTITION BY g ORDER BY date)"
    up = "(PARTITION BY g ORDER BY date ROWS UNBOUNDED PRECEDING)"
    return f"""e AS (SELECT *, row_number() OVER {w} AS i FROM {source}), en AS (SELECT g, arg_min(assets, date) AS a0, arg_max(assets, date) AS a1, arg_min({{'b': benchmark}}, date).b AS b0, arg_max({{'b': benchmark}}, date).b AS b1 FROM e GROUP BY g),
x AS (SELECT g, date, assets, benchmark, assets / lag(assets) OVER {w} - 1 AS r, max(assets) OVER {up} AS peak, max(benchmark) OVER {up} AS bpeak FROM e WHERE i > 1),
y AS (SELECT *, (peak - assets) / peak AS dd, (bpeak - benchmark) / bpeak AS bd, row_number() OVER (PARTITION BY g ORDER BY r NULLS LAST, date) AS k, count(r) OVER (PARTITION BY g) AS n FROM x),
a AS (SELECT g, count(*) AS n_days, date_diff('day', min(date), max(date)) AS days, stddev_pop(r) * sqrt(252) AS volatility, max(dd) AS max_drawdown, coalesce(max(bd), 0) AS benchmark_max_drawdown,
  -max(r) FILTER (k - 1 = floor(n * 0.05 + 1e-9)) AS var, -avg(r) FILTER (k <= greatest(1, floor(n * 0.05 + 1e-9)) AND r IS NOT NULL) AS cvar, sqrt(avg(dd * dd)) AS ulcer_index,
  sqrt(avg(CASE WHEN r < 0 THEN r * r WHEN r IS NOT NULL THEN 0.0 END)) AS down FROM y GROUP BY g),
m AS (SELECT a.*, (a1 - a0) / a0 AS return_rate, (b1 - b0) / b0 AS benchmark_return FROM a JOIN en USING (g)), n AS (SELECT *, pow(1 + return_rate, 365.0 / days) - 1 AS annualized_return FROM m),
z AS (SELECT *, (annualized_return - 0.02) / volatility AS sharpe_ratio, (annualized_return - 0.02) / (down * sqrt(252)) AS sortino_ratio, (annualized_return - 0.02) / ulcer_index AS upi, return_rate - coalesce(benchmark_return, 0) AS relative_return FROM n)
SELECT {group}n_days, {', '.join(f'{r(n)} AS {n}' for n in CLIENT)} FROM z"""


def _with_benchmark(spark, d) -> DataFrame:
    return nav.align_benchmark(_nav(spark, d), bars.ship_benchmark(spark, d))


@query("nav_client_metrics", f"WITH {ALIGNED}, s AS (SELECT 1 AS g, * FROM al), " + _client_sql("s"))
def nav_client_metrics(spark, d):
    x = nav.client_metrics(_with_benchmark(spark, d), KEYS)
    return x.select("n_days", *_rounded(x, CLIENT))


@query(
    "nav_client_stats",
    f"WITH {ALIGNED}, f AS (SELECT max(date) AS last, min(date) AS first FROM nav), wd AS (SELECT p, CASE WHEN p = 'ytd' THEN CAST(date_trunc('year', last) AS DATE) ELSE CAST(last - to_months(m) AS DATE) END AS since, first FROM f, (VALUES ('1m', 1), ('1y', 12), ('ytd', NULL), ('all', NULL)) v(p, m)), "
    "bs AS (SELECT p, coalesce(CASE WHEN p = 'ytd' THEN (SELECT min(date) FROM nav WHERE date >= since) ELSE (SELECT max(date) FROM nav WHERE date <= since AND date > first) END, (SELECT min(date) FROM nav WHERE date > first)) AS start FROM wd), "
    "c AS (SELECT p, coalesce((SELECT max(date) FROM nav WHERE date < start), (SELECT first FROM f)) AS base FROM bs), "
    "s AS (SELECT p AS g, date, assets, benchmark FROM al, c WHERE date >= base), " + _client_sql("s", "g AS period, "),
)
def nav_client_stats(spark, d):
    x = nav.client_metrics(nav.slices(_with_benchmark(spark, d), ["1m", "1y", "ytd", "all"]), ["portfolio", "period"])
    return x.select("period", "n_days", *_rounded(x, CLIENT))


@query(
    "nav_client_series",
    f"WITH {ALIGNED}, p AS (SELECT *, 100 * (assets / first_value(assets) OVER w - 1) AS s, 100 * (benchmark / first_value(benchmark IGNORE NULLS) OVER w - 1) AS b, max(assets) OVER w AS pa, max(benchmark) OVER w AS pb FROM al WINDOW w AS (ORDER BY date ROWS UNBOUNDED PRECEDING)) "
    f"SELECT date, {r('s')} AS strategy_pct, {r('b')} AS benchmark_pct, {r('s - b')} AS excess_pct, {r('-100 * (pa - assets) / pa')} AS strategy_drawdown, {r('-100 * (pb - benchmark) / pb')} AS benchmark_drawdown FROM p",
    dates=("date",),
)
def nav_client_series(spark, d):
    x = nav.client_series(_with_benchmark(spark, d), KEYS)
    return x.select("date", *_rounded(x, ["strategy_pct", "benchmark_pct", "excess_pct", "strategy_drawdown", "benchmark_drawdown"]))


@query(
    "nav_slider",
    "WITH {nav}, p AS (SELECT *, row_number() OVER (ORDER BY date) - 1 AS i FROM nav), q AS (SELECT *, max(assets) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS peak FROM p WHERE i BETWEEN 100 AND 400) "
    f"SELECT {r('100 * (arg_max(assets, date) - arg_min(assets, date)) / arg_min(assets, date)')} AS period_return_pct, {r('100 * max((peak - assets) / peak)')} AS max_drawdown_pct FROM q",
)
def nav_slider(spark, d):
    x = nav.index_range(_nav(spark, d), KEYS, 100, 400)
    return x.select(*_rounded(x, ["period_return_pct", "max_drawdown_pct"]))


@query(
    "nav_metric_rows",
    "WITH {nav}, s AS (SELECT 1 AS g, * FROM nav), " + _metrics_sql("s").replace("\nSELECT n_days, ", ", w AS (SELECT ") + ") SELECT name, CAST(list_position(["
    + ", ".join(f"'{n}'" for n in sorted(nav.METRICS, key=lambda n: (nav.METRICS[n], n))) + "], name) - 1 AS INT) AS place, value FROM (UNPIVOT w ON COLUMNS(*) INTO NAME name VALUE value)",
)
def nav_metric_rows(spark, d):
    return nav.metric_rows(nav.metrics(_nav(spark, d), KEYS), KEYS).select("name", "place", rounded("value").alias("value"))


_LEGACY = ("first_assets", "last_assets", "return_rate", "annualized_return", "volatility", "sharpe_ratio", "sortino_ratio", "max_drawdown_pct", "var", "cvar", "ulcer_index", "upi")


@query(
    "nav_legacy_metrics",
    "WITH {nav}, f AS (SELECT max(date) AS last FROM nav), s AS (SELECT p AS g, date, assets FROM nav, f, (VALUES ('all', NULL), ('3m', 3), ('1y', 12)) v(p, m) WHERE m IS NULL OR date >= CAST(last - to_months(m) AS DATE)), "
    + _metrics_sql("s").rsplit("\nSELECT", 1)[0]
    + ", w AS (SELECT g, -max(r) FILTER (k - 1 = floor((1 - 0.95::DOUBLE) * n)) AS vp, min(date) AS first_date, max(date) AS last_date, arg_min(assets, date) AS first_assets, arg_max(assets, date) AS last_assets, coalesce(-100 * max(dd), 0) AS max_drawdown_pct, arg_max(date, (dd, -epoch(date))) AS trough_date FROM y GROUP BY g), "
    "q AS (SELECT z.g, z.* EXCLUDE (g, var, sharpe_ratio), w.* EXCLUDE (g), vp AS var, coalesce(z.sharpe_ratio, 0) AS sharpe_ratio FROM z JOIN w ON w.g = z.g) SELECT g AS interval, first_date, last_date, trough_date, " + ", ".join(f"{r(x, 5)} AS {x}" for x in _LEGACY) + " FROM q",
    dates=("first_date", "last_date", "trough_date"),
)
def nav_legacy_metrics(spark, d):
    """The asset metrics of the older report over all days, a quarter and a year."""
    x = nav.legacy_metrics(nav.intervals(_nav(spark, d), ["all", "3m", "1y"]), ["portfolio", "interval"])
    return x.select("interval", "first_date", "last_date", "trough_date", *_rounded(x, _LEGACY, 5))


@nav.metric("winning_days", 60, "share of days with a gain")
def _winning_days():
    return F.avg((F.col("r") > 0).cast("double"))


@nav.metric("days_under_water", 61, "days below the highest assets so far")
def _days_under_water():
    return F.count(F.when(F.col("dd") > 0, 1))


@nav.metric("of_a_missing_column", 62, "a metric that cannot be built")
def _of_a_missing_column():
    return F.avg("no_such_column")


_USER = ["return_rate", "volatility", "max_drawdown", "winning_days", "days_under_water", "of_a_missing_column"]


@query(
    "nav_user_metrics",
    "WITH {nav}, s AS (SELECT 1 AS g, * FROM nav), " + _metrics_sql("s").rsplit("\nSELECT", 1)[0] + ", u AS (SELECT return_rate, volatility, max_drawdown, (SELECT avg((r > 0)::INT) FROM y WHERE r IS NOT NULL) AS winning_days, (SELECT count(*) FROM y WHERE dd > 0) AS days_under_water FROM z) "
    "SELECT 'return_rate' AS name, 0 AS place, " + r("return_rate") + " AS value, false AS failed FROM u UNION ALL SELECT 'volatility', 1, " + r("volatility") + ", false FROM u UNION ALL SELECT 'max_drawdown', 2, " + r("max_drawdown") + ", false FROM u "
    "UNION ALL SELECT 'winning_days', 3, " + r("winning_days") + ", false FROM u UNION ALL SELECT 'days_under_water', 4, days_under_water, false FROM u UNION ALL SELECT 'of_a_missing_column', 5, NULL, true",
)
def nav_user_metrics(spark, d):
    """Registered metrics beside the built-in ones; one of them fails and stays a row."""
    x = nav.collected_metrics(_nav(spark, d), KEYS, _USER)
    return x.select("name", "place", rounded("value").alias("value"), F.col("error").isNotNull().alias("failed"))


# Trades -----------------------------------------------------------------------------------------------

def _clip(spark, d):
    return ledger.clipped_round_trips(bars.event_trades(spark, d))


def _shown(trips: DataFrame) -> DataFrame:
    return trips.select("symbol", "open_time", "close_time", "open_price", rounded("open_fee", 6).alias("open_fee"), "close_fee", "close_price", "volume", rounded("profit", 6).alias("profit"))


#: The same fold as a recursive query: trades of a symbol are numbered and taken one by one.
FOLD = """
n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY created_at, seq) AS k FROM trades),
s AS (SELECT symbol, k, CASE WHEN side = 1 THEN volume ELSE 0.0 END AS v, CASE WHEN side = 1 THEN volume * price + fee ELSE 0.0 END AS cost, created_at AS ot, price AS op,
        CASE WHEN side = 1 THEN fee ELSE 0.0 END AS of, NULL::DOUBLE AS q, NULL::DOUBLE AS profit, NULL::DOUBLE AS ofp, created_at AS ct, price AS cp, fee AS cf FROM n WHERE k = 1
      UNION ALL
      SELECT n.symbol, n.k,
        CASE WHEN side = 1 THEN s.v + volume ELSE greatest(s.v - volume, 0.0) END,
        CASE WHEN side = 1 AND s.v = 0 THEN volume * price + fee WHEN side = 1 THEN s.cost + (volume * price + fee) WHEN s.v > 0 THEN s.cost - least(volume, s.v) / s.v * s.cost ELSE s.cost END,
        CASE WHEN s.v = 0 THEN created_at ELSE s.ot END, CASE WHEN s.v = 0 THEN price ELSE s.op END,
        CASE WHEN s.v = 0 THEN fee WHEN side = 2 THEN s.of - least(volume, s.v) / s.v * s.of ELSE s.of END,
        CASE WHEN side = 2 AND s.v > 0 THEN least(volume, s.v) END, CASE WHEN side = 2 AND s.v > 0 THEN least(volume, s.v) * price - least(volume, s.v) / s.v * s.cost - fee END,
        CASE WHEN side = 2 AND s.v > 0 THEN least(volume, s.v) / s.v * s.of END, created_at, price, fee
      FROM s JOIN n ON n.symbol = s.symbol AND n.k = s.k + 1),
trips AS (SELECT symbol, profit, ot AS open_time, ct AS close_time, op AS open_price, ofp AS open_fee, cf AS close_fee, cp AS close_price, q AS volume FROM s WHERE q IS NOT NULL)"""


@query("roundtrips", "WITH RECURSIVE {trades}," + FOLD + f" SELECT symbol, open_time, close_time, open_price, {r('open_fee', 6)} AS open_fee, close_fee, close_price, volume, {r('profit', 6)} AS profit FROM trips")
def roundtrips(spark, d):
    """Trade by trade, as a fold."""
    return _shown(ledger.round_trips(bars.event_trades(spark, d), clip=True))


@query("roundtrips_windowed", "WITH RECURSIVE {trades}," + FOLD + f" SELECT symbol, open_time, close_time, open_price, {r(r('open_fee', 9), 6)} AS open_fee, close_fee, close_price, volume, {r(r('profit', 9), 6)} AS profit FROM trips")
def roundtrips_windowed(spark, d):
    """The same by windows; both sides are freed of noise beyond nine decimals before they are rounded."""
    return _shown(_clip(spark, d).withColumn("open_fee", F.round("open_fee", 9)))


@query(
    "trade_metrics",
    "WITH RECURSIVE {trades}," + FOLD + ", a AS (SELECT avg(CASE WHEN profit > 0 THEN 1.0 ELSE 0.0 END) AS win_rate, avg(profit) FILTER (profit > 0) AS avg_profit, avg(profit) FILTER (profit < 0) AS avg_loss, "
    "avg(profit / (abs(volume) * open_price)) FILTER (profit > 0) AS avg_profit_pct, avg(profit / (abs(volume) * open_price)) FILTER (profit < 0) AS avg_loss_pct, avg(floor((epoch(close_time) - epoch(open_time)) / 86400)) AS avg_holding_days, count(*) AS n FROM trips), "
    "b AS (SELECT *, abs(avg_profit / avg_loss) AS profit_loss_ratio FROM a) "
    "SELECT n, " + ", ".join(f"{r(x, 4)} AS {x}" for x in ("win_rate", "avg_profit", "avg_loss", "avg_profit_pct", "avg_loss_pct", "avg_holding_days", "profit_loss_ratio")) + f", {r('win_rate - (1 - win_rate) / profit_loss_ratio', 4)} AS kelly FROM b",
)
def trade_metrics(spark, d):
    x = ledger.trade_metrics(_clip(spark, d))
    return x.select("n", *[rounded(c, 4).alias(c) for c in ("win_rate", "avg_profit", "avg_loss", "avg_profit_pct", "avg_loss_pct", "avg_holding_days", "profit_loss_ratio", "kelly")])


@query("trade_metrics_legacy", "WITH RECURSIVE {trades}," + FOLD + f" SELECT {r('100 * avg(CASE WHEN profit > 0 THEN 1.0 ELSE 0.0 END)', 4)} AS win_rate_pct, {r('avg((epoch(date_trunc(' + chr(39) + 'second' + chr(39) + ', close_time)) - epoch(date_trunc(' + chr(39) + 'second' + chr(39) + ', open_time))) / 86400)', 4)} AS avg_holding_days FROM trips")
def trade_metrics_legacy(spark, d):
    x = ledger.trade_metrics(_clip(spark, d), whole_days=False)
    return x.select(rounded(100 * F.col("win_rate"), 4).alias("win_rate_pct"), rounded("avg_holding_days", 4).alias("avg_holding_days"))


@query("top_trades", "WITH RECURSIVE {trades}," + FOLD + f" SELECT symbol, close_time, {r('profit', 6)} AS profit FROM trips ORDER BY trips.profit DESC, close_time LIMIT 10")
def top_trades(spark, d):
    return ledger.top_trades(_clip(spark, d), 10).select("symbol", "close_time", rounded("profit", 6).alias("profit"))


@query("worst_trades", "WITH RECURSIVE {trades}," + FOLD + f" SELECT symbol, close_time, {r('profit', 6)} AS profit FROM trips ORDER BY trips.profit, close_time LIMIT 10")
def worst_trades(spark, d):
    return ledger.top_trades(_clip(spark, d), 10, worst=True).select("symbol", "close_time", rounded("profit", 6).alias("profit"))


@query("ledger_backtest")
def ledger_backtest(spark, d):
    """Every user's trades replayed through an account of their own."""
    return ledger.replay(bars.event_trades(spark, d).withColumn("account", F.col("symbol")), cash=100_000.0)


@query(
    "ledger_percent",
    "WITH {trades}, n AS (SELECT symbol AS account, created_at, seq, price, row_number() OVER (PARTITION BY symbol ORDER BY created_at, seq) AS k FROM trades WHERE price > 0), b AS (SELECT account, floor((50000 - 15) / price) AS v FROM n WHERE k = 1) "
    "SELECT account, n.seq, CASE WHEN k = 1 THEN 1 ELSE 2 END AS side, CAST(CASE WHEN k = 1 THEN v WHEN k = 2 THEN floor(v * 0.5) WHEN k = 3 THEN v - floor(v * 0.5) ELSE 0 END AS DOUBLE) AS filled_volume, "
    "CASE WHEN k = 1 AND v > 0 THEN 'order_1' WHEN k = 2 AND floor(v * 0.5) > 0 THEN 'order_2' WHEN k = 3 AND v > 0 THEN 'order_3' END AS order_id FROM n JOIN b USING (account) WHERE k <= 4",
)
def ledger_percent(spark, d):
    """Orders by percent: half of the account's value bought, half of the holding sold, all of it, and all of nothing."""
    w = Window.partitionBy("symbol").orderBy("created_at", "seq")
    k = F.col("_k")
    t = bars.event_trades(spark, d).where("price > 0").withColumn("_k", F.row_number().over(w)).where(k <= 4)
    orders = t.withColumns({"account": F.col("symbol"), "side": F.when(k == 1, 1).otherwise(2), "volume": F.lit(None).cast("double"), "percent": F.when(k <= 2, 0.5).otherwise(1.0)}).drop("_k")
    return ledger.replay(orders, cash=100_000.0).select("account", "seq", "side", "filled_volume", "order_id")


# Strategies -------------------------------------------------------------------------------------------

def buy_and_hold(context, now) -> None:
    """Buys at the first bar of the period and sells at its 25th; an account trades one symbol."""
    if context.step == 1:
        context.buy(now[0].symbol, 10_000)
    elif context.step == 25:
        context.sell(now[0].symbol, 10_000)


def _backtest(spark, d) -> DataFrame:
    return strategy.backtest(bars.event_bars(spark, d).where("close > 0"), buy_and_hold, "2024-01-05 00:00:00", "2024-01-15 00:00:00", "symbol", cash=1e9)


#: Volumes are such that fees come out in whole cents.
HELD = """{bars}, p AS (SELECT symbol, eob, close, row_number() OVER (PARTITION BY symbol ORDER BY eob) AS k FROM bars WHERE close > 0 AND eob BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-15'),
f AS (SELECT symbol, max(close) FILTER (k = 1) AS p1, max(close) FILTER (k = 25) AS p2 FROM p GROUP BY symbol),
c AS (SELECT symbol, p1, p2, 1e9 - (10000 * p1 + greatest(3 * p1, 5)) AS c1, 10000 * p2 - (greatest(3 * p2, 5) + 10 * p2) AS gain FROM f),
o AS (SELECT symbol, eob, k, close, p1, p2, CASE WHEN k >= 25 THEN c1 + gain ELSE c1 END AS cash, CASE WHEN k >= 25 THEN 0 ELSE 10000 END AS held FROM p JOIN c USING (symbol)),
s AS (SELECT symbol AS account, eob AS created_at, cash, cash + held * close AS nav FROM o
      UNION ALL SELECT symbol, max(eob), 1e9, 1e9 FROM bars WHERE close > 0 AND eob < TIMESTAMP '2024-01-05' GROUP BY symbol)"""


@query("strategy_backtest", f"WITH {HELD} SELECT account, created_at, {r('cash', 2)} AS cash, {r('nav', 2)} AS nav FROM s")
def strategy_backtest(spark, d):
    x = strategy.snapshots(_backtest(spark, d))
    return x.select("account", "created_at", *_rounded(x, ["cash", "nav"], 2))


@query(
    "strategy_orders",
    f"WITH {HELD} SELECT symbol AS account, eob AS created_at, CASE WHEN k = 1 THEN 1 ELSE 2 END AS side, close AS price, 10000.0::DOUBLE AS volume, {r('greatest(3 * close, 5) + CASE WHEN k = 25 THEN 10 * close ELSE 0 END', 2)} AS fee FROM o WHERE k IN (1, 25) AND eob >= TIMESTAMP '2024-01-05 01:00:00'",
)
def strategy_orders(spark, d):
    x = ledger.orders_between(strategy.fills(_backtest(spark, d)), "2024-01-05 01:00:00", "2024-01-15 00:00:00")
    return x.select("account", "created_at", "side", "price", F.col("filled_volume").alias("volume"), rounded("fee", 2).alias("fee"))


@query("strategy_account_at", f"WITH {HELD} SELECT account, {r('arg_max(nav, created_at)', 2)} AS nav, max(created_at) AS created_at FROM s WHERE created_at <= TIMESTAMP '2024-01-05 20:30:00' GROUP BY account")
def strategy_account_at(spark, d):
    x = asof.snapshot_at(strategy.snapshots(_backtest(spark, d)), "2024-01-05 20:30:00", "nav", ["account"])
    return x.withColumn("nav", rounded("nav", 2))


@query("strategy_positions", f"WITH {HELD} SELECT symbol AS account, symbol, 10000.0::DOUBLE AS volume FROM f WHERE p1 IS NOT NULL AND (SELECT min(eob) FROM p WHERE p.symbol = f.symbol) <= TIMESTAMP '2024-01-05 20:30:00' AND coalesce((SELECT min(eob) FROM p WHERE p.symbol = f.symbol AND k = 25) > TIMESTAMP '2024-01-05 20:30:00', true)")
def strategy_positions(spark, d):
    return ledger.positions_at(strategy.fills(_backtest(spark, d)), "2024-01-05 20:30:00").select("account", "symbol", "volume")
