"""Queries on bars: loading, as-of prices, signals, fusion and thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.functions.stats import rounded
from tidewater.operators import asof, signals
from tidewater.plans.catalog import ORACLES, query, r
from tidewater.sources import bars

#: A trailing window of ``n`` rows of a symbol, and a mean that is null until it is full.
W = "OVER (PARTITION BY symbol ORDER BY eob ROWS BETWEEN {} PRECEDING AND CURRENT ROW)"


def roll(agg: str, x: str, n: int) -> str:
    w = W.format(n - 1)
    return f"CASE WHEN count({x}) {w} = {n} THEN {agg}({x}) {w} END"


def ewm(x: str, span: float | None = None, com: float | None = None) -> str:
    keep = repr(1.0 - (2.0 / (span + 1) if span is not None else 1.0 / (1 + com)))
    unbounded = "OVER (PARTITION BY symbol ORDER BY eob ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    fold = f"list_reduce(list_transform(list({x}) {unbounded}, lambda v: {{'n': CAST(v AS DOUBLE), 'd': 1.0::DOUBLE}}), lambda p, q: {{'n': p.n * {keep}::DOUBLE + q.n, 'd': p.d * {keep}::DOUBLE + q.d}})"
    return f"({fold}).n / ({fold}).d"


def _out(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.select("symbol", "eob", *(rounded(n, digits).alias(n) for n in names))


def _like(name: str) -> str:
    """The SQL of a query that another one must agree with."""
    return ORACLES[name]


MA = f"({roll('avg', 'close', 5)} - {roll('avg', 'close', 20)}) / {roll('avg', 'close', 20)}"
MOM = "close / lag(close, 20) OVER (PARTITION BY symbol ORDER BY eob) - 1"
VOL = f"volume / ({roll('avg', 'volume', 5)}) - 1"
BOLL = f"coalesce((close - (({roll('avg', 'close', 20)}) - 2 * ({roll('stddev_samp', 'close', 20)}))) / nullif(4 * ({roll('stddev_samp', 'close', 20)}), 0) - 0.5, 0.0)"
THREE = "{bars}, s AS (SELECT symbol, eob, close, " + f"{MA} AS ma, {BOLL} AS boll, {VOL} AS vol FROM bars)"


def _three(spark, d) -> DataFrame:
    x = bars.event_bars(spark, d)
    return signals.volume_ratio(signals.boll(signals.ma_cross(x)))


@query("bars_hourly", "WITH {bars} SELECT * FROM bars")
def bars_hourly(spark, d):
    return bars.event_bars(spark, d)


@query("bars_daily", "WITH {days} SELECT * FROM days")
def bars_daily(spark, d):
    return bars.event_bars(spark, d, "day")


@query(
    "bars_dedup_last_wins",
    "WITH l AS (SELECT event_type AS symbol, '60m' AS frequency, date_trunc('hour', ts) AS eob, event_id AS seq, value AS close, CASE WHEN event_id % 3 = 0 THEN value END AS mark FROM events) "
    "SELECT symbol, frequency, eob, arg_max(close, seq) AS close, arg_max(mark, seq) FILTER (mark IS NOT NULL) AS mark FROM l GROUP BY symbol, frequency, eob",
)
def bars_dedup_last_wins(spark, d):
    e = bars.read(spark, d, "events")
    loads = e.select(F.col("event_type").alias("symbol"), F.lit("60m").alias("frequency"), F.date_trunc("hour", "ts").alias("eob"), F.col("event_id").alias("seq"), F.col("value").alias("close"), F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("mark"))
    return bars.merge_bars(loads, "seq", ["close", "mark"])


@query(
    "bars_dedup_first_wins",
    "SELECT event_type AS symbol, '60m' AS frequency, date_trunc('hour', ts) AS eob, arg_min(value, event_id) AS close, arg_min(user_id, event_id) AS user_id FROM events GROUP BY ALL",
)
def bars_dedup_first_wins(spark, d):
    e = bars.read(spark, d, "events")
    return bars.first_bars(e.select(F.col("event_type").alias("symbol"), F.lit("60m").alias("frequency"), F.date_trunc("hour", "ts").alias("eob"), F.col("event_id").alias("seq"), F.col("value").alias("close"), "user_id"), "seq")


@query("bars_backfill", "WITH {bars} SELECT symbol, frequency, eob, close FROM bars")
def bars_backfill(spark, d):
    b = bars.event_bars(spark, d).select("symbol", "frequency", "eob", "close")
    middle = b.groupBy("symbol", "frequency").agg(F.percentile_approx(F.unix_timestamp("eob"), 0.5).alias("_m"))
    live = b.join(middle, ["symbol", "frequency"]).where(F.unix_timestamp("eob") >= F.col("_m")).drop("_m")
    return bars.backfill(live, b)


@query(
    "bars_backfill_depth",
    "WITH {bars}, n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY eob DESC) AS k, count(*) FILTER (eob >= TIMESTAMP '2024-01-29') OVER (PARTITION BY symbol) AS live FROM bars) "
    "SELECT symbol, frequency, eob, close FROM n WHERE eob >= TIMESTAMP '2024-01-29' OR (live > 0 AND live < 60 AND k <= 61)",
)
def bars_backfill_depth(spark, d):
    """Series short of 60 bars are filled up to 61."""
    b = bars.event_bars(spark, d).select("symbol", "frequency", "eob", "close")
    return bars.backfill(b.where("eob >= timestamp'2024-01-29'"), b, 60)


@query("bars_at_close", "WITH {days}, {bars}, u AS (SELECT symbol, frequency, eob + INTERVAL '15 hours 1 second' AS eob, close FROM days UNION ALL SELECT symbol, frequency, eob, close FROM bars) SELECT * FROM u WHERE eob <= TIMESTAMP '2024-01-20 15:00:00'")
def bars_at_close(spark, d):
    b = bars.event_bars(spark, d, "day").unionByName(bars.event_bars(spark, d)).select("symbol", "frequency", "eob", "close")
    return bars.at_close(b, "2024-01-20 15:00:00")


@query(
    "subscribed_bars",
    "WITH {bars}, n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY eob DESC) AS k FROM bars) SELECT symbol, frequency, eob, close, CASE WHEN symbol <> 'click' THEN volume END AS volume FROM n WHERE symbol = 'click' AND k <= 7 OR symbol IN ('view', 'error') AND k <= 12",
)
def subscribed_bars(spark, d):
    s = bars.Subscriptions(12)
    s.subscribe("click", "60m", ["close"], 7)
    s.subscribe(["view", "error", "signup"], "60m")
    s.unsubscribe("signup", "60m")
    return s.apply(bars.event_bars(spark, d)).select("symbol", "frequency", "eob", "close", "volume")


@query("last_n_bars", "WITH {bars} SELECT symbol, frequency, eob, close FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY eob DESC) AS n FROM bars) WHERE n <= 10")
def last_n_bars(spark, d):
    return bars.last_n(bars.event_bars(spark, d), 10, ["close"])


@query("history_arrays", "WITH {bars} SELECT symbol, eob, len(h) AS n, " + r("list_sum(h)") + " AS total FROM (SELECT symbol, eob, list(close) " + W.format(4) + " AS h FROM bars)")
def history_arrays(spark, d):
    b = bars.event_bars(spark, d)
    h = b.withColumn("h", signals.BARS.last_rows(["close"], 5))
    return h.select("symbol", "eob", F.size("h").cast("long").alias("n"), rounded(F.aggregate("h", F.lit(0.0), lambda s, x: s + x["close"])).alias("total"))


@query("subscribed_symbols", "SELECT DISTINCT event_type AS symbol FROM events")
def subscribed_symbols(spark, d):
    return bars.read(spark, d, "events").select(F.col("event_type").alias("symbol")).distinct()


@query("bars_between", "WITH {bars}, s AS (SELECT symbol, eob, " + roll("avg", "close", 5) + " AS m FROM bars) SELECT symbol, eob, " + r("m") + " AS m FROM s WHERE eob BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-20'")
def bars_between(spark, d):
    b = bars.event_bars(spark, d).withColumn("m", signals.BARS.mean("close", 5))
    return _out(signals.position_window(b, "2024-01-10", "2024-01-20"), "m")


@query(
    "asof_price",
    "WITH {bars}, {days}, q AS (SELECT event_id, event_type AS symbol, ts AS at FROM events), h AS (SELECT symbol, eob, CASE WHEN hour(eob) % 5 = 0 THEN 0 WHEN hour(eob) % 7 <> 3 THEN close END AS x FROM bars) "
    "SELECT q.event_id, q.symbol, CASE WHEN h.x > 0 THEN h.x WHEN d.close > 0 THEN d.close END AS price FROM q ASOF LEFT JOIN h ON q.symbol = h.symbol AND q.at >= h.eob ASOF LEFT JOIN days d ON q.symbol = d.symbol AND q.at >= d.eob",
)
def asof_price(spark, d):
    """Prices of events from hourly bars, of which some are 0 or lack a price, else from daily ones."""
    q = bars.read(spark, d, "events").select("event_id", F.col("event_type").alias("symbol"), F.col("ts").alias("at"))
    hour = F.hour("eob")
    hourly = bars.event_bars(spark, d).withColumn("close", F.when(hour % 5 == 0, 0.0).when(hour % 7 != 3, F.col("close")))
    return asof.latest_price(q, hourly.unionByName(bars.event_bars(spark, d, "day")), ("60m", "1d")).select("event_id", "symbol", "price")


@query(
    "asof_snapshot",
    "WITH q AS (SELECT o_orderkey, o_custkey, o_orderdate FROM orders), s AS (SELECT user_id, ts, value FROM events) "
    "SELECT o_orderkey, o_custkey, value FROM q ASOF LEFT JOIN s ON q.o_custkey = s.user_id AND q.o_orderdate >= s.ts",
)
def asof_snapshot(spark, d):
    q = bars.read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    s = bars.read(spark, d, "events").select(F.col("user_id").alias("o_custkey"), "ts", "value")
    return asof.asof_join(q, s, ["o_custkey"], "o_orderdate", "ts", ["value"]).drop("o_orderdate")


def _signal(name: str, sql: str, make, ctes: str = "{bars}", source: str = "bars") -> None:
    @query(f"sig_{name}", f"WITH {ctes} SELECT symbol, eob, {r('x')} AS {name} FROM (SELECT symbol, eob, {sql} AS x FROM {source})")
    def run(spark, d):
        return _out(make(bars.event_bars(spark, d)), name)


_signal("ma", MA, signals.ma_cross)
_signal("momentum", MOM, signals.momentum)
_signal("vol", VOL, signals.volume_ratio)
_signal("boll", BOLL, signals.boll)
_signal("volatility", f"2 * ({roll('stddev_samp', 'close', 20)}) / ({roll('avg', 'close', 20)})", signals.volatility)
_signal("macd", f"dif - {ewm('dif', span=9)}", signals.macd, f"{{bars}}, m AS (SELECT symbol, eob, {ewm('close', span=12)} - {ewm('close', span=26)} AS dif FROM bars)", "m")
_signal(
    "rsi",
    "CASE WHEN g IS NULL OR (g = 0 AND l = 0) THEN 50 WHEN l = 0 THEN 100 ELSE 100 - 100 / (1 + g / l) END - 50",
    signals.rsi,
    "{bars}, c AS (SELECT symbol, eob, close - lag(close) OVER (PARTITION BY symbol ORDER BY eob) AS x FROM bars), "
    "u AS (SELECT symbol, eob, CASE WHEN x > 0 THEN x ELSE 0.0 END AS up, CASE WHEN x < 0 THEN -x ELSE 0.0 END AS down FROM c), "
    f"gl AS (SELECT symbol, eob, {roll('avg', 'up', 14)} AS g, {roll('avg', 'down', 14)} AS l FROM u)",
    "gl",
)
_signal(
    "kdj",
    f"k - {ewm('k', com=2)}",
    signals.kdj,
    f"{{bars}}, v AS (SELECT symbol, eob, coalesce((close - ({roll('min', 'low', 9)})) / nullif(({roll('max', 'high', 9)}) - ({roll('min', 'low', 9)}), 0) * 100, 50.0) AS rsv FROM bars), "
    f"k AS (SELECT symbol, eob, {ewm('rsv', com=2)} AS k FROM v)",
    "k",
)
_signal(
    "rsrs",
    "coalesce(CASE WHEN count(b) OVER (PARTITION BY symbol) < 600 THEN b ELSE z END, 0.0)",
    signals.rsrs,
    f"{{bars}}, b AS (SELECT symbol, eob, CASE WHEN count(*) {W.format(17)} = 18 THEN covar_samp(high, low) {W.format(17)} / nullif(var_pop(low) {W.format(17)}, 0) END AS b FROM bars), "
    f"z AS (SELECT symbol, eob, b, (b - ({roll('avg', 'b', 600)})) / nullif({roll('stddev_samp', 'b', 600)}, 0) AS z FROM b)",
    "z",
)


@query("sig_ma_in_chunks", f"WITH {{bars}} SELECT symbol, eob, {r(MA)} AS ma FROM bars")
def sig_ma_in_chunks(spark, d):
    """The same as ``sig_ma``, with each series spread over tasks."""
    return _out(signals.in_chunks(bars.event_bars(spark, d), lambda b, s: signals.ma_cross(b, s=s), 19, 150), "ma")


@query("sig_macd_scanned", _like("sig_macd"))
def sig_macd_scanned(spark, d):
    """The same as ``sig_macd``, with each series spread over tasks by week."""
    return _out(signals.macd_scanned(bars.event_bars(spark, d), unit="week"), "macd")


@query("sig_kdj_scanned", _like("sig_kdj"))
def sig_kdj_scanned(spark, d):
    """The same as ``sig_kdj``, with each series spread over tasks."""
    return _out(signals.kdj_scanned(bars.event_bars(spark, d), unit="week", chunk=150), "kdj")


@query("sig_custom", f"WITH {{bars}} SELECT symbol, eob, {r('close / open - 1')} AS body FROM bars")
def sig_custom(spark, d):
    return _out(signals.custom(bars.event_bars(spark, d), lambda b: F.col("close") / F.col("open") - 1, "body"), "body")


@query("sig_composite", "WITH " + THREE + f" SELECT symbol, eob, {r('(coalesce(ma, 0) + boll + coalesce(vol, 0)) / ((ma IS NOT NULL)::INT + 1 + (vol IS NOT NULL)::INT)')} AS composite FROM s")
def sig_composite(spark, d):
    return _out(signals.composite(_three(spark, d), ["ma", "boll", "vol"]), "composite")


@query("sig_latest", "WITH {bars} SELECT symbol, frequency, " + r("value") + " AS value, CAST(coalesce(sign(value), 0) AS INT) AS direction FROM (SELECT symbol, frequency, arg_max(x, eob) AS value FROM (SELECT symbol, frequency, eob, " + MOM + " AS x FROM bars) GROUP BY symbol, frequency)")
def sig_latest(spark, d):
    x = signals.latest_direction(signals.momentum(bars.event_bars(spark, d)), "momentum")
    return x.withColumn("value", rounded("value"))


@query("sig_templates", "WITH {bars} SELECT symbol, eob, " + r(MA) + " AS ma_short, " + r(f"volume / ({roll('avg', 'volume', 10)}) - 1") + " AS vol_medium FROM bars")
def sig_templates(spark, d):
    return _out(signals.signal_set(bars.event_bars(spark, d), ["ma_short", "vol_medium"]), "ma_short", "vol_medium")


@query("fuse_vote", "WITH " + THREE + " SELECT symbol, eob, CAST(sign(coalesce(sign(ma), 0) + coalesce(sign(boll), 0) + coalesce(sign(vol), 0)) AS DOUBLE) AS fused FROM s")
def fuse_vote(spark, d):
    return signals.fuse_vote(_three(spark, d), ["ma", "boll", "vol"]).select("symbol", "eob", F.col("fused").cast("double").alias("fused"))


@query(
    "fuse_score",
    "WITH " + THREE + ", t AS (SELECT symbol, eob, 2.0 * tanh(coalesce(ma, 0)) + tanh(coalesce(boll, 0)) + 0.5 * tanh(coalesce(vol, 0)) AS t FROM s) "
    f"SELECT symbol, eob, {r('t / nullif(max(abs(t)) OVER (PARTITION BY symbol), 0)')} AS fused FROM t",
)
def fuse_score(spark, d):
    return _out(signals.fuse_score(_three(spark, d), ["ma", "boll", "vol"], {"ma": 2.0, "vol": 0.5}), "fused")


@query("fuse_weighted", "WITH " + THREE + f" SELECT symbol, eob, {r('0.75 * coalesce(ma, 0) + 0.25 * coalesce(boll, 0) + coalesce(vol, 0)')} AS fused FROM s")
def fuse_weighted(spark, d):
    return _out(signals.fuse_weighted(_three(spark, d), ["ma", "boll", "vol"], {"ma": 3.0, "boll": 1.0}), "fused")


@query("fuse_equal", "WITH " + THREE + f" SELECT symbol, eob, {r('(coalesce(ma, 0) + boll + coalesce(vol, 0)) / ((ma IS NOT NULL)::INT + 1 + (vol IS NOT NULL)::INT)')} AS fused FROM s")
def fuse_equal(spark, d):
    return _out(signals.fuse_equal(_three(spark, d), ["ma", "boll", "vol"]), "fused")


@query(
    "fuse_adaptive",
    "WITH " + THREE + ", p AS (SELECT *, close / lag(close) OVER w - 1 AS ret, lag(ma) OVER w AS pm, lag(boll) OVER w AS pb, lag(vol) OVER w AS pv FROM s WINDOW w AS (PARTITION BY symbol ORDER BY eob)), "
    "c AS (SELECT symbol, abs(coalesce(corr(pm, ret), 0)) AS wm, abs(coalesce(corr(pb, ret), 0)) AS wb, abs(coalesce(corr(pv, ret), 0)) AS wv FROM p GROUP BY symbol) "
    f"SELECT symbol, eob, {r('(wm * coalesce(ma, 0) + wb * coalesce(boll, 0) + wv * coalesce(vol, 0)) / (wm + wb + wv)')} AS fused FROM s JOIN c USING (symbol)",
)
def fuse_adaptive(spark, d):
    x = _three(spark, d).withColumn("ret", signals.BARS.pct_change("close"))
    return _out(signals.fuse_adaptive(x, ["ma", "boll", "vol"], "ret"), "fused")


def _threshold(name: str, sql: str, make, ctes: str = "", frm: str = "m") -> None:
    @query(f"thr_{name}", f"WITH {{bars}}, m AS (SELECT symbol, frequency, eob, close, round({MOM}, 9) AS x FROM bars){ctes} SELECT symbol, eob, CAST({sql} AS INT) AS position FROM {frm}")
    def run(spark, d):
        x = signals.momentum(bars.event_bars(spark, d), out="x").withColumn("x", F.round("x", 9))
        return make(x).select("symbol", "eob", F.col("position").cast("int").alias("position"))


_threshold("simple", "CASE WHEN x > 0.5 THEN 1 WHEN x < -0.5 THEN -1 ELSE 0 END", lambda x: signals.thr_simple(x, "x", 0.5))
_threshold("preset", "CASE WHEN x > 0.2 THEN 1 WHEN x < -0.2 THEN -1 ELSE 0 END", lambda x: signals.thr_preset(x, "x", "moderate"))
_threshold("percentile", "CASE WHEN x > u THEN 1 WHEN x < l THEN -1 ELSE 0 END", lambda x: signals.thr_percentile(x, "x"), ", q AS (SELECT symbol, quantile_cont(x, 0.75) AS u, quantile_cont(x, 0.25) AS l FROM m GROUP BY symbol)", "m JOIN q USING (symbol)")
_threshold("zscore", "CASE WHEN (x - a) / s > 1 THEN 1 WHEN (x - a) / s < -1 THEN -1 ELSE 0 END", lambda x: signals.thr_zscore(x, "x"), ", q AS (SELECT symbol, avg(x) AS a, stddev_samp(x) AS s FROM m GROUP BY symbol)", "m JOIN q USING (symbol)")
_threshold("moving", "CASE WHEN x > a + 0.1 THEN 1 WHEN x < a - 0.1 THEN -1 ELSE 0 END", lambda x: signals.thr_moving(x, "x", 20, 0.1), f", q AS (SELECT symbol, eob, x, {roll('avg', 'x', 20)} AS a FROM m)", "q")
_threshold(
    "dual",
    "coalesce(last_value(ev IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY eob ROWS UNBOUNDED PRECEDING), 0)",
    lambda x: signals.thr_dual(x, "x", 0.8, -0.8, 0.4, -0.4),
    ", e AS (SELECT *, first_value(CASE WHEN x > 0.8 THEN 1 WHEN x < -0.8 THEN -1 END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY eob ROWS UNBOUNDED PRECEDING) AS e0 FROM m), "
    "f AS (SELECT *, lag(e0) OVER (PARTITION BY symbol ORDER BY eob) AS was FROM e), "
    "g AS (SELECT symbol, eob, CASE WHEN was IS NULL THEN e0 WHEN x > 0.4 THEN 1 WHEN x < -0.4 THEN -1 END AS ev FROM f)",
    "g",
)


@query(
    "thr_dual_wide",
    f"WITH RECURSIVE {{bars}}, m AS (SELECT symbol, eob, round({MOM}, 9) AS x, row_number() OVER (PARTITION BY symbol ORDER BY eob) AS k FROM bars), "
    "s(symbol, eob, k, p) AS (SELECT symbol, eob, k, CASE WHEN x > 0.3 THEN 1 WHEN x < -0.3 THEN -1 ELSE 0 END FROM m WHERE k = 1 UNION ALL "
    "SELECT m.symbol, m.eob, m.k, CASE WHEN x IS NULL THEN p WHEN p = 0 THEN CASE WHEN x > 0.3 THEN 1 WHEN x < -0.3 THEN -1 ELSE 0 END WHEN p = 1 AND x < 0.2 THEN -1 WHEN p = -1 AND x > -0.2 THEN 1 ELSE p END FROM s JOIN m ON m.symbol = s.symbol AND m.k = s.k + 1) "
    "SELECT symbol, eob, CAST(p AS INT) AS position FROM s",
)
def thr_dual_wide(spark, d):
    """Exits that can hold at once: the position depends on the whole path."""
    x = signals.momentum(bars.event_bars(spark, d), out="x").withColumn("x", F.round("x", 9))
    return signals.thr_dual(x, "x", 0.3, -0.3, -0.2, 0.2).select("symbol", "eob", "position")


@query("thr_dual_scanned", _like("thr_dual_wide"))
def thr_dual_scanned(spark, d):
    """The same as ``thr_dual_wide``, with each series spread over tasks by week."""
    x = signals.momentum(bars.event_bars(spark, d), out="x").withColumn("x", F.round("x", 9))
    return signals.thr_dual_scanned(x, "x", 0.3, -0.3, -0.2, 0.2, unit="week").select("symbol", "eob", "position")


@query(
    "score_rows",
    "WITH " + THREE + ", q AS (SELECT symbol, eob, ma, boll, vol, coalesce((CASE WHEN ma IS NOT NULL THEN 2 * tanh(ma) ELSE 0 END + CASE WHEN boll IS NOT NULL THEN tanh(boll) ELSE 0 END + CASE WHEN vol IS NOT NULL THEN tanh(vol) ELSE 0 END) "
    "/ nullif((ma IS NOT NULL)::INT * 2 + (boll IS NOT NULL)::INT + (vol IS NOT NULL)::INT, 0), 0) AS sc FROM s), t AS (SELECT *, CASE WHEN sc = 0 THEN 0.0 WHEN abs(sc) = 1 THEN (coalesce(abs(ma), 0) + coalesce(abs(boll), 0) + coalesce(abs(vol), 0)) / ((ma IS NOT NULL)::INT + (boll IS NOT NULL)::INT + (vol IS NOT NULL)::INT) ELSE abs(sc) END AS strength FROM q) "
    f"SELECT symbol, eob, CAST(sign(sc) AS INT) AS direction, {r('strength')} AS strength, strength >= 0.5 AS actionable FROM t",
)
def score_rows(spark, d):
    x = signals.score_rows(_three(spark, d), ["ma", "boll", "vol"], {"ma": 2.0})
    return x.select("symbol", "eob", "direction", rounded("strength").alias("strength"), "actionable")


@query(
    "vote_strength",
    "WITH " + THREE + ", q AS (SELECT *, (coalesce(ma, 0) > 0)::INT + (coalesce(boll, 0) > 0)::INT + (coalesce(vol, 0) > 0)::INT AS up, (coalesce(ma, 0) < 0)::INT + (coalesce(boll, 0) < 0)::INT + (coalesce(vol, 0) < 0)::INT AS down FROM s), "
    "t AS (SELECT symbol, eob, CASE WHEN up > down THEN 1 WHEN down > up THEN -1 ELSE 0 END AS direction, CASE WHEN up > down THEN up / 3.0 WHEN down > up THEN down / 3.0 ELSE 0.0 END AS st, (coalesce(abs(ma), 0) + coalesce(abs(boll), 0) + coalesce(abs(vol), 0)) / nullif((ma IS NOT NULL)::INT + (boll IS NOT NULL)::INT + (vol IS NOT NULL)::INT, 0) AS av FROM q) "
    f"SELECT symbol, eob, CAST(direction AS INT) AS direction, {r('CASE WHEN direction <> 0 AND st = 1 THEN av ELSE st END')} AS strength, coalesce(CASE WHEN direction <> 0 AND st = 1 THEN av ELSE st END >= 0.5, false) AS actionable FROM t",
)
def vote_strength(spark, d):
    """The majority's direction; a unanimous vote's strength is the mean size of the signals."""
    names = ["ma", "boll", "vol"]
    x = signals.with_strength_rule(signals.vote_with_strength(_three(spark, d), names), names)
    return x.select("symbol", "eob", "direction", rounded("strength").alias("strength"), "actionable")


@query(
    "strategy_return",
    f"WITH {{bars}}, m AS (SELECT symbol, eob, close, CASE WHEN {MOM} > 0 THEN 1 WHEN {MOM} < 0 THEN -1 ELSE 0 END AS p FROM bars), "
    "x AS (SELECT symbol, eob, (close / lag(close) OVER w - 1) * lag(p) OVER w AS strategy FROM m WINDOW w AS (PARTITION BY symbol ORDER BY eob)) "
    f"SELECT symbol, eob, {r('strategy')} AS strategy FROM x",
)
def strategy_return(spark, d):
    x = signals.thr_simple(signals.momentum(bars.event_bars(spark, d)), "momentum", 0.0)
    return _out(signals.strategy_returns(x, "position"), "strategy")


@query(
    "strategy_growth",
    f"WITH {{bars}}, m AS (SELECT symbol, eob, close, CASE WHEN {MOM} > 0 THEN 1 WHEN {MOM} < 0 THEN -1 ELSE 0 END AS p FROM bars), "
    "x AS (SELECT symbol, eob, (close / lag(close) OVER w - 1) * lag(p * 0.001::DOUBLE) OVER w AS y FROM m WINDOW w AS (PARTITION BY symbol ORDER BY eob)), "
    "g AS (SELECT symbol, eob, product(1 + coalesce(y, 0)) OVER (PARTITION BY symbol ORDER BY eob ROWS UNBOUNDED PRECEDING) AS g FROM x) "
    f"SELECT symbol, eob, {r('ln(g)')} AS growth, {r('1 - g / max(g) OVER (PARTITION BY symbol ORDER BY eob ROWS UNBOUNDED PRECEDING)')} AS drawdown FROM g",
)
def strategy_growth(spark, d):
    """What a thousandth of the capital held by the signal grows to (as a logarithm), and how far below its maximum it is; each series spread over tasks."""
    x = signals.in_chunks(bars.event_bars(spark, d), lambda b, s: signals.thr_simple(signals.momentum(b, s=s), "momentum", 0.0), 20, 150)
    g = signals.strategy_returns_scanned(x.withColumn("share", F.col("position") * 0.001), "share", unit="week", chunk=150)
    return _out(g.withColumn("growth", F.log(1 + F.col("growth"))), "growth", "drawdown")
