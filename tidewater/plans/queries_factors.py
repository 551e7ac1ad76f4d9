"""Queries on factor panels: factors, validation, weights, orthogonalisation and combination."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.functions.stats import rounded
from tidewater.operators import combine, factors, validation
from tidewater.plans.catalog import ORACLES, query, r
from tidewater.sources import bars

#: Three-month momentum ``f``, a second factor ``v``, and next month's return ``ret``, rounded so that ranks and comparisons agree.
BASE = """{panel}, fx AS (SELECT date, symbol, round(close / lag(close, 3) OVER w - 1, 9) AS f, round(volume / nullif(avg(volume) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 0) - 1, 9) AS v,
    round(lead(close) OVER w / close - 1, 9) AS ret, dense_rank() OVER (ORDER BY date) - 1 AS di FROM panel WINDOW w AS (PARTITION BY symbol ORDER BY date)),
nd AS (SELECT count(DISTINCT date) AS n FROM panel), al AS (SELECT fx.* FROM fx, nd WHERE di BETWEEN 1 AND n - 2)"""


def panel(spark, d) -> DataFrame:
    p = factors.future_return(factors.momentum(bars.supplier_panel(spark, d), 3, "f"), "ret")
    v = F.try_divide(F.col("volume"), F.avg("volume").over(factors.PANEL.last(3))) - 1
    return p.withColumn("v", F.round(v, 9)).withColumns({"f": F.round("f", 9), "ret": F.round("ret", 9)}).select("date", "symbol", "close", "volume", "f", "v", "ret")


def _out(df: DataFrame, *names: str, keys=("date", "symbol")) -> DataFrame:
    return df.select(*keys, *(rounded(n).alias(n) for n in names))


def roll(agg: str, x: str, n: int) -> str:
    w = f"OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {w} = {n} THEN {agg}({x}) {w} END"


@query("panel_monthly", "WITH {panel} SELECT date, symbol, close, volume FROM panel")
def panel_monthly(spark, d):
    return bars.supplier_panel(spark, d).select("date", "symbol", "close", "volume")


@query("factor_lnclose", f"WITH {{panel}} SELECT date, symbol, {r('ln(close)')} AS ln_close FROM panel")
def factor_lnclose(spark, d):
    return _out(factors.ln_close(bars.supplier_panel(spark, d)), "ln_close")


@query("factor_momentum", f"WITH {{panel}} SELECT date, symbol, {r('close / lag(close, 20) OVER (PARTITION BY symbol ORDER BY date) - 1')} AS momentum FROM panel")
def factor_momentum(spark, d):
    return _out(factors.momentum(bars.supplier_panel(spark, d)), "momentum")


@query("factor_volume", f"WITH {{panel}} SELECT date, symbol, {r('volume / (' + roll('avg', 'volume', 20) + ') - 1')} AS volume_factor FROM panel")
def factor_volume(spark, d):
    return _out(factors.volume(bars.supplier_panel(spark, d)), "volume_factor")


@query("factor_volatility", f"WITH {{panel}}, x AS (SELECT date, symbol, close / lag(close) OVER (PARTITION BY symbol ORDER BY date) - 1 AS rr FROM panel) SELECT date, symbol, {r(roll('stddev_samp', 'rr', 20))} AS volatility FROM x")
def factor_volatility(spark, d):
    return _out(factors.volatility(bars.supplier_panel(spark, d)), "volatility")


@query("factor_graph", f"WITH {{panel}}, x AS (SELECT date, symbol, ln(close) AS l FROM panel) SELECT date, symbol, {r('l')} AS ln_close, {r('l - lag(l) OVER (PARTITION BY symbol ORDER BY date)')} AS ln_change FROM x")
def factor_graph(spark, d):
    g = factors.FactorGraph()
    g.register("ln_change", lambda p: p.withColumn("ln_change", factors.PANEL.diff("ln_close")), ("ln_close",))
    g.register("ln_close", factors.ln_close)
    return _out(g.calculate(bars.supplier_panel(spark, d), ["ln_change"]), "ln_close", "ln_change")


@query("factor_complete_field", "WITH {panel}, d AS (SELECT DISTINCT date FROM panel), s AS (SELECT DISTINCT symbol FROM panel) SELECT d.date, s.symbol, volume FROM d CROSS JOIN s LEFT JOIN panel USING (date, symbol)")
def factor_complete_field(spark, d):
    p = bars.supplier_panel(spark, d)
    return bars.complete_field(p, p.select("date").distinct(), p.select("symbol").distinct(), "volume")


@query("factor_field_missing", "WITH {panel}, d AS (SELECT DISTINCT date FROM panel UNION SELECT TIMESTAMP '1900-01-01'), s AS (SELECT DISTINCT symbol FROM panel) SELECT d.date, s.symbol, NULL::DOUBLE AS volume FROM d CROSS JOIN s")
def factor_field_missing(spark, d):
    """A date is asked for that the panel lacks, so the whole field is null."""
    p = bars.supplier_panel(spark, d)
    dates = p.select("date").distinct().unionByName(spark.sql("select timestamp'1900-01-01' as date"))
    return bars.complete_field(p, dates, p.select("symbol").distinct(), "volume")


@query("panel_shape", "WITH {panel} SELECT f AS field, n_dates, n_symbols, n_rows, n_rows AS n_values, n_rows = n_dates * n_symbols AS complete FROM (SELECT count(DISTINCT date) AS n_dates, count(DISTINCT symbol) AS n_symbols, count(*) AS n_rows FROM panel), (SELECT unnest(['close', 'volume']) AS f)")
def panel_shape(spark, d):
    return factors.shape(bars.supplier_panel(spark, d), ["close", "volume"])


BUCKET = "b AS (SELECT *, CASE WHEN f IS NOT NULL AND count(f) OVER (PARTITION BY date) >= 10 THEN CAST(greatest(1, ceil(10 * (row_number() OVER (PARTITION BY date ORDER BY f NULLS LAST, symbol) - 1) / (count(f) OVER (PARTITION BY date) - 1))) AS INT) END AS bucket FROM fx)"


@query("decile_assign", f"WITH {BASE}, {BUCKET} SELECT date, symbol, bucket FROM b WHERE bucket IS NOT NULL")
def decile_assign(spark, d):
    return factors.buckets(panel(spark, d), "f").select("date", "symbol", "bucket").where("bucket is not null")


SPEARMAN = """k AS (SELECT date, rank() OVER (PARTITION BY date ORDER BY f) + (count(*) OVER (PARTITION BY date, f) - 1) / 2.0 AS x,
    rank() OVER (PARTITION BY date ORDER BY ret) + (count(*) OVER (PARTITION BY date, ret) - 1) / 2.0 AS y FROM al WHERE f IS NOT NULL AND ret IS NOT NULL),
ic AS (SELECT date, covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0) AS ic FROM k GROUP BY date HAVING count(*) >= 10 AND covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0) IS NOT NULL)"""


def _ics(spark, d, factor: str = "f") -> DataFrame:
    p = panel(spark, d)
    return factors.ic_by_date(factors.aligned(p, factor, "ret"), factor, "ret")


@query("ic_spearman", f"WITH {BASE}, {SPEARMAN} SELECT date, {r('ic')} AS ic FROM ic")
def ic_spearman(spark, d):
    return _out(_ics(spark, d), "ic", keys=("date",))


@query("ic_pearson", f"WITH {BASE} SELECT date, {r('covar_pop(f, ret) / nullif(stddev_pop(f) * stddev_pop(ret), 0)')} AS ic FROM al WHERE f IS NOT NULL AND ret IS NOT NULL GROUP BY date HAVING count(*) >= 10")
def ic_pearson(spark, d):
    p = panel(spark, d)
    return _out(factors.ic_by_date(factors.aligned(p, "f", "ret"), "f", "ret", "pearson"), "ic", keys=("date",))


@query("ic_shifted", f"WITH {BASE}, s AS (SELECT date, f, lead(ret) OVER (PARTITION BY symbol ORDER BY date) AS ret FROM fx) SELECT date, {r('covar_pop(f, ret) / nullif(stddev_pop(f) * stddev_pop(ret), 0)')} AS ic FROM s WHERE f IS NOT NULL AND ret IS NOT NULL GROUP BY date HAVING count(*) >= 10")
def ic_shifted(spark, d):
    return _out(factors.ic_by_date(factors.aligned(panel(spark, d), "f", "ret", 1, "shifted"), "f", "ret", "pearson"), "ic", keys=("date",))


@query(
    "ic_summary",
    f"WITH {BASE}, {SPEARMAN} SELECT {r('avg(ic)')} AS ic_mean, {r('stddev_pop(ic)')} AS ic_std, {r('avg(ic) / stddev_pop(ic)')} AS ic_ir, {r('avg(CASE WHEN ic > 0 THEN 1.0 ELSE 0.0 END)')} AS positive_ratio, "
    f"{r('avg(ic) / (stddev_samp(ic) / sqrt(count(ic)))')} AS t_stat, count(ic) AS n FROM ic",
)
def ic_summary(spark, d):
    return factors.ic_summary(_ics(spark, d)).select(*(rounded(c).alias(c) for c in ("ic_mean", "ic_std", "ic_ir", "positive_ratio", "t_stat")), "n")


@query(
    "turnover",
    f"WITH {BASE}, {BUCKET}, m AS (SELECT a.date, (a.bucket <> z.bucket)::INT::DOUBLE AS moved, z.bucket AS was FROM b a JOIN b z ON a.symbol = z.symbol AND a.di = z.di + 1 WHERE a.bucket IS NOT NULL AND z.bucket IS NOT NULL) "
    f"SELECT date, {r('avg(moved)')} AS turnover, {r('avg(moved) FILTER (was = 10)')} AS top, {r('avg(moved) FILTER (was = 1)')} AS bottom FROM m GROUP BY date",
)
def turnover(spark, d):
    return _out(factors.turnover(panel(spark, d), "f"), "turnover", "top", "bottom", keys=("date",))


@query(
    "ic_decay",
    f"WITH {BASE.replace('BETWEEN 1 AND n - 2', 'BETWEEN 0 AND n - 1')}, {SPEARMAN}, i AS (SELECT ic.*, di, n FROM ic JOIN (SELECT DISTINCT date, di FROM fx) USING (date), nd), "
    f"x AS (SELECT k.k, ic FROM i, generate_series(1, 20) AS k(k) WHERE k.k <= n // 2 - 1 AND di BETWEEN k.k AND n - 1 - k.k) SELECT CAST(k AS INT) AS k, {r('avg(ic)')} AS ic_mean, count(ic) AS n FROM x GROUP BY k",
)
def ic_decay(spark, d):
    return factors.ic_decay(panel(spark, d), "f", "ret").select("k", rounded("ic_mean").alias("ic_mean"), "n")


DECAY = f"{SPEARMAN}, i AS (SELECT ic.*, di, n FROM ic JOIN (SELECT DISTINCT date, di FROM fx) USING (date), nd), dk AS (SELECT kk.k AS k, avg(ic) AS m FROM i, generate_series(1, 20) AS kk(k) WHERE kk.k <= n // 2 - 1 AND di BETWEEN kk.k AND n - 1 - kk.k GROUP BY kk.k), hl AS (SELECT -regr_slope(ln(abs(m)), k) AS rate FROM dk WHERE abs(m) > 0)"


@query("half_life", f"WITH {BASE}, {DECAY} SELECT {r('rate')} AS decay_rate, {r('CASE WHEN rate > 0 THEN ln(2.0) / rate ELSE CAST(' + chr(39) + 'inf' + chr(39) + ' AS DOUBLE) END', 4)} AS half_life FROM hl")
def half_life(spark, d):
    x = factors.half_life(factors.ic_decay(panel(spark, d), "f", "ret"))
    return x.select(rounded("decay_rate").alias("decay_rate"), rounded("half_life", 4).alias("half_life"))


GROUPS = BASE.replace(", al AS", f", {BUCKET}, al AS").replace("SELECT fx.* FROM fx, nd", "SELECT b.* FROM b, nd")
GR = ", g1 AS (SELECT date, bucket, avg(ret) AS m FROM al WHERE bucket IS NOT NULL AND ret IS NOT NULL GROUP BY date, bucket), g AS (SELECT bucket, avg(m) AS mean_return, count(m) AS n_dates FROM g1 GROUP BY bucket)"


@query("group_returns", f"WITH {GROUPS}{GR} SELECT bucket, {r('mean_return')} AS mean_return, n_dates FROM g")
def group_returns(spark, d):
    return factors.group_returns(panel(spark, d), "f", "ret").select("bucket", rounded("mean_return").alias("mean_return"), "n_dates")


@query("group_returns_weighted", f"WITH {GROUPS.replace('round(lead(close)', 'volume, round(lead(close)')}, g1 AS (SELECT date, bucket, sum(ret * volume) / sum(volume) AS m FROM al WHERE bucket IS NOT NULL AND ret IS NOT NULL GROUP BY date, bucket) SELECT bucket, {r('avg(m)')} AS mean_return, count(m) AS n_dates FROM g1 GROUP BY bucket")
def group_returns_weighted(spark, d):
    return factors.group_returns(panel(spark, d), "f", "ret", weight="volume").select("bucket", rounded("mean_return").alias("mean_return"), "n_dates")


@query("monotonicity", f"WITH {GROUPS}{GR}, k AS (SELECT rank() OVER (ORDER BY bucket) AS x, rank() OVER (ORDER BY mean_return) AS y, bucket, mean_return FROM g) SELECT {r('arg_max(mean_return, bucket) - arg_min(mean_return, bucket)')} AS spread, {r('abs(corr(x, y))')} AS monotonicity FROM k")
def monotonicity(spark, d):
    x = factors.monotonicity(factors.group_returns(panel(spark, d), "f", "ret"))
    return x.select(rounded("spread").alias("spread"), rounded("monotonicity").alias("monotonicity"))


@query(
    "hit_rate",
    f"WITH {BASE}, v AS (SELECT date, f, ret FROM al WHERE f IS NOT NULL AND ret IS NOT NULL), m AS (SELECT date, quantile_cont(f, 0.5) AS mf, quantile_cont(ret, 0.5) AS mr FROM v GROUP BY date HAVING count(*) >= 10) "
    f"SELECT CAST(sum(((f > mf) = (ret > mr))::INT) AS BIGINT) AS hits, count(*) AS n, {r('avg(((f > mf) = (ret > mr))::INT)')} AS hit_rate FROM v JOIN m USING (date)",
)
def hit_rate(spark, d):
    return factors.hit_rate(panel(spark, d), "f", "ret").withColumn("hit_rate", rounded("hit_rate"))


@query(
    "stability",
    f"WITH {BASE}, {SPEARMAN}, s AS (SELECT ic, CASE WHEN count(ic) OVER w = 60 THEN stddev_samp(ic) OVER w END AS sd, product(1 + ic) OVER u AS c, lag(ic, 1) OVER o AS l1, lag(ic, 2) OVER o AS l2, lag(ic, 3) OVER o AS l3, lag(ic, 4) OVER o AS l4, lag(ic, 5) OVER o AS l5 "
    "FROM ic WINDOW w AS (ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW), u AS (ORDER BY date ROWS UNBOUNDED PRECEDING), o AS (ORDER BY date)), "
    "p AS (SELECT s.*, max(c) OVER (ORDER BY rn ROWS UNBOUNDED PRECEDING) AS pk FROM (SELECT *, row_number() OVER () AS rn FROM s) s) "
    f"SELECT {r('avg(sd)')} AS mean_rolling_std, {r('min((c - pk) / pk)')} AS max_ic_drawdown, " + ", ".join(f"{r(f'corr(ic, l{k})')} AS autocorr_{k}" for k in range(1, 6)) + " FROM p",
)
def stability(spark, d):
    x = factors.stability(_ics(spark, d))
    return x.select(*(rounded(c).alias(c) for c in ("mean_rolling_std", "max_ic_drawdown", *(f"autocorr_{k}" for k in range(1, 6)))))


@query("valid_ratio", f"WITH {BASE} SELECT count(f) AS valid, count(*) AS cells, {r('count(f) / count(*)')} AS valid_ratio FROM fx")
def valid_ratio(spark, d):
    return factors.valid_ratio(panel(spark, d), "f").withColumn("valid_ratio", rounded("valid_ratio"))


# Weights and combination ------------------------------------------------------------------------------

TWO = SPEARMAN + ", " + SPEARMAN.replace("k AS", "k2 AS").replace("FROM k ", "FROM k2 ").replace("ic AS (SELECT date", "ic2 AS (SELECT date").replace("BY f)", "BY v)").replace("date, f)", "date, v)").replace("WHERE f IS", "WHERE v IS")
ABS_IC = "i AS (SELECT (SELECT abs(avg(ic)) FROM ic) AS a, (SELECT abs(avg(ic)) FROM ic2) AS b)"
PAIR = "SELECT 'f' AS factor, {0} AS weight FROM {2} UNION ALL SELECT 'v', {1} FROM {2}"
COV = "c AS (SELECT covar_samp(f, f) AS ff, covar_samp(v, v) AS vv, covar_samp(CASE WHEN v IS NOT NULL THEN f END, CASE WHEN f IS NOT NULL THEN v END) AS fv FROM fx)"


def _weights(name: str, method: str, sql: str) -> None:
    @query(name, f"WITH {BASE}, {sql}")
    def run(spark, d):
        p = panel(spark, d)
        w = combine.weights(p, ["f", "v"], method, "ret")
        return combine.weight_rows(p, w).withColumn("weight", rounded("weight"))


HELD = "q AS (SELECT (count(f) > 0)::INT AS a, (count(v) > 0)::INT AS b FROM fx) " + PAIR.format("coalesce(a / nullif(a + b, 0), 0.5)::DOUBLE", "coalesce(b / nullif(a + b, 0), 0.5)::DOUBLE", "q")
_weights("w_equal", "equal_weight", HELD)
_weights("w_maxdiv", "max_diversification", HELD)
_weights("w_ic", "ic_weight", f"{TWO}, {ABS_IC} " + PAIR.format(r("a / (a + b)"), r("b / (a + b)"), "i"))
_weights("w_ir", "ir_weight", f"{TWO}, i AS (SELECT (SELECT abs(avg(ic) / stddev_pop(ic)) FROM ic) AS a, (SELECT abs(avg(ic) / stddev_pop(ic)) FROM ic2) AS b) " + PAIR.format(r("a / (a + b)"), r("b / (a + b)"), "i"))
_weights("w_minvar", "min_variance", f"{COV}, m AS (SELECT greatest(vv - fv, 0) AS a, greatest(ff - fv, 0) AS b FROM c) " + PAIR.format(r("a / (a + b)"), r("b / (a + b)"), "m"))
_weights("w_maxsharpe", "max_sharpe", f"{TWO}, {ABS_IC}, {COV}, m AS (SELECT greatest(vv * i.a - fv * i.b, 0) AS a, greatest(ff * i.b - fv * i.a, 0) AS b FROM c, i) " + PAIR.format(r("a / (a + b)"), r("b / (a + b)"), "m"))
_weights("w_riskparity", "risk_parity", "m AS (SELECT 1 / stddev_pop(f) AS a, 1 / stddev_pop(v) AS b FROM fx) " + PAIR.format(r("a / (a + b)"), r("b / (a + b)"), "m"))

#: A third factor, and the first component of the three by power iteration, its largest loading positive.
THREE = """t AS (SELECT fx.date, fx.symbol, f, v, round(ln(close), 9) AS l FROM fx JOIN panel USING (date, symbol)), tc AS (SELECT * FROM t WHERE f IS NOT NULL AND v IS NOT NULL AND l IS NOT NULL),
rho AS (SELECT corr(f, v) AS fv, corr(f, l) AS fl, corr(v, l) AS vl, avg(f) AS mf, stddev_pop(f) AS sf, avg(v) AS mv, stddev_pop(v) AS sv, avg(l) AS ml, stddev_pop(l) AS sl FROM tc),
pw(i, a, b, c) AS (SELECT 0, 1.0::DOUBLE, 0.9::DOUBLE, 0.8::DOUBLE UNION ALL
  SELECT i + 1, x / sqrt(x * x + y * y + z * z), y / sqrt(x * x + y * y + z * z), z / sqrt(x * x + y * y + z * z)
  FROM (SELECT i, a + fv * b + fl * c AS x, fv * a + b + vl * c AS y, fl * a + vl * b + c AS z FROM pw, rho WHERE i < 3000)),
ax AS (SELECT a * s AS a, b * s AS b, c * s AS c FROM (SELECT *, sign(CASE WHEN abs(a) >= abs(b) AND abs(a) >= abs(c) THEN a WHEN abs(b) >= abs(c) THEN b ELSE c END) AS s FROM pw WHERE i = 3000))"""
NAMES3 = ["f", "v", "l"]


def _three(spark, d) -> DataFrame:
    return panel(spark, d).withColumn("l", F.round(F.ln("close"), 9))


@query("w_pca", f"WITH RECURSIVE {BASE}, {THREE} SELECT n AS factor, {r('abs(w) / (abs(a) + abs(b) + abs(c))')} AS weight FROM (SELECT *, unnest(['f', 'v', 'l']) AS n, unnest([a, b, c]) AS w FROM ax)")
def w_pca(spark, d):
    p = _three(spark, d)
    return combine.weight_rows(p, combine.weights(p, NAMES3, "pca")).withColumn("weight", rounded("weight"))


@query(
    "orth_residual",
    f"WITH {BASE}, g AS (SELECT regr_slope(v, f) AS b, regr_intercept(v, f) AS a FROM fx) SELECT date, symbol, {r('f')} AS f, {r('v - (a + b * f)')} AS v FROM fx, g",
)
def orth_residual(spark, d):
    return _out(combine.orthogonalize(panel(spark, d), ["f", "v"], "residual"), "f", "v")


@query(
    "orth_gs",
    f"WITH {BASE}, o AS (SELECT sum(f * f) AS ff, sum(f * v) AS fv, sum(v * v) AS vv FROM fx WHERE f IS NOT NULL AND v IS NOT NULL) "
    f"SELECT date, symbol, {r('CASE WHEN v IS NOT NULL THEN f / sqrt(ff) END')} AS f, {r('(v - fv / ff * f) / sqrt(vv - fv * fv / ff)')} AS v FROM fx, o",
)
def orth_gs(spark, d):
    return _out(combine.orthogonalize(panel(spark, d), ["f", "v"], "gram_schmidt"), "f", "v")


@query(
    "orth_pca",
    f"WITH RECURSIVE {BASE}, {THREE}, z AS (SELECT date, symbol, (f - mf) / sf AS zf, (v - mv) / sv AS zv, (l - ml) / sl AS zl FROM t, rho), y AS (SELECT date, symbol, a * zf + b * zv + c * zl AS p, zf * zf + zv * zv + zl * zl AS q FROM z, ax) "
    f"SELECT date, symbol, {r('p', 5)} AS first_score, {r('q - p * p', 5)} AS rest FROM y",
)
def orth_pca(spark, d):
    """The first component's score with its sign, and the sum of squares of the other two."""
    x = combine.orthogonalize(_three(spark, d), NAMES3, "pca")
    return x.select("date", "symbol", rounded("f", 5).alias("first_score"), rounded(F.col("v") * F.col("v") + F.col("l") * F.col("l"), 5).alias("rest"))


@query("combine_factors", f"WITH {BASE}, {TWO}, {ABS_IC} SELECT date, symbol, {r('a / (a + b) * f + b / (a + b) * v')} AS combined FROM fx, i")
def combine_factors(spark, d):
    p = panel(spark, d)
    return _out(combine.combine(p, combine.weights(p, ["f", "v"], "ic_weight", "ret")), "combined")


@query("top_factors", f"WITH {BASE}, {TWO} SELECT factor, {r('m')} AS ic_mean FROM (SELECT 'f' AS factor, avg(ic) AS m FROM ic UNION ALL SELECT 'v', avg(ic) FROM ic2) ORDER BY abs(m) DESC LIMIT 1")
def top_factors(spark, d):
    """The factor of largest absolute correlation: of two, the first."""
    x = factors.ic_by_factor(panel(spark, d), ["f", "v"], "ret")
    return x.orderBy(F.desc(F.abs("ic_mean"))).limit(1).select("factor", rounded("ic_mean").alias("ic_mean"))


@query("factor_correlation", f"WITH RECURSIVE {BASE}, {THREE} SELECT * FROM (SELECT 'f' AS a, 'v' AS b, {r('corr(f, v)')} AS correlation FROM t UNION ALL SELECT 'f', 'l', {r('corr(f, l)')} FROM t UNION ALL SELECT 'v', 'l', {r('corr(v, l)')} FROM t)")
def factor_correlation(spark, d):
    return combine.correlations(_three(spark, d), NAMES3).withColumn("correlation", rounded("correlation"))


GK = "gk AS (SELECT rank() OVER (ORDER BY bucket) AS x, rank() OVER (ORDER BY mean_return) AS y, bucket, mean_return FROM g), gs AS (SELECT arg_max(mean_return, bucket) - arg_min(mean_return, bucket) AS spread, abs(corr(x, y)) AS monotonicity FROM gk)"
#: The groups of a combination 0.75 f + 0.25 v in place of the factor.
MIXED = BASE.replace("nd AS (SELECT", "fy AS (SELECT * REPLACE (0.75 * f + 0.25 * v AS f) FROM fx), nd AS (SELECT").replace(", al AS", ", " + BUCKET.replace("FROM fx)", "FROM fy)") + ", al AS").replace("SELECT fx.* FROM fx, nd", "SELECT b.* FROM b, nd")


@query("combination_metrics", f"WITH {MIXED}, {SPEARMAN}{GR}, {GK} SELECT {r('1 / (0.75 * 0.75 + 0.25 * 0.25)')} AS effective_number, {r('0.75 * 0.75 + 0.25 * 0.25')} AS herfindahl, (SELECT {r('avg(ic)')} FROM ic) AS ic, (SELECT {r('avg(ic) / stddev_pop(ic)')} FROM ic) AS ir, {r('spread')} AS spread, {r('monotonicity')} AS monotonicity FROM gs")
def combination_metrics(spark, d):
    x = combine.metrics(panel(spark, d), {"f": 0.75, "v": 0.25}, "ret")
    return x.select(*(rounded(c).alias(c) for c in x.columns))


@query(
    "validation_run",
    f"WITH {GROUPS}, {DECAY}{GR}, {GK}, hv AS (SELECT date, f, ret FROM al WHERE f IS NOT NULL AND ret IS NOT NULL), hm AS (SELECT date, quantile_cont(f, 0.5) AS mf, quantile_cont(ret, 0.5) AS mr FROM hv GROUP BY date HAVING count(*) >= 10), "
    "h AS (SELECT sum(((f > mf) = (ret > mr))::INT) AS hits, count(*) AS n FROM hv JOIN hm USING (date)), "
    "mv AS (SELECT a.date, (a.bucket <> z.bucket)::INT::DOUBLE AS moved, z.bucket AS was FROM b a JOIN b z ON a.symbol = z.symbol AND a.di = z.di + 1 WHERE a.bucket IS NOT NULL AND z.bucket IS NOT NULL), "
    "tn AS (SELECT avg(moved) AS t, avg(moved) FILTER (was = 10) AS top, avg(moved) FILTER (was = 1) AS bottom FROM mv GROUP BY date), "
    "vr AS (SELECT count(f) AS valid, count(*) AS cells FROM fx) "
    f"SELECT validation, name, {r('value', 5)} AS value FROM ("
    "SELECT 'validity' AS validation, 'valid' AS name, valid::DOUBLE AS value FROM vr UNION ALL SELECT 'validity', 'cells', cells FROM vr UNION ALL SELECT 'validity', 'valid_ratio', valid / cells FROM vr UNION ALL SELECT 'validity', 'sparse', (valid / cells < 0.7)::INT FROM vr "
    "UNION ALL SELECT 'information_coefficient', 'ic_mean', avg(ic) FROM ic UNION ALL SELECT 'information_coefficient', 'ic_std', stddev_pop(ic) FROM ic UNION ALL SELECT 'information_coefficient', 'ic_ir', avg(ic) / stddev_pop(ic) FROM ic "
    "UNION ALL SELECT 'information_coefficient', 'positive_ratio', avg((ic > 0)::INT) FROM ic UNION ALL SELECT 'information_coefficient', 't_stat', avg(ic) / (stddev_samp(ic) / sqrt(count(ic))) FROM ic UNION ALL SELECT 'information_coefficient', 'n', count(ic) FROM ic "
    "UNION ALL SELECT 'ic_decay', 'decay_rate', rate FROM hl UNION ALL SELECT 'ic_decay', 'half_life', CASE WHEN rate > 0 THEN ln(2.0) / rate ELSE CAST('inf' AS DOUBLE) END FROM hl "
    "UNION ALL SELECT 'group_returns', 'spread', spread FROM gs UNION ALL SELECT 'group_returns', 'monotonicity', monotonicity FROM gs "
    "UNION ALL SELECT 'turnover', 'turnover', avg(t) FROM tn UNION ALL SELECT 'turnover', 'top', avg(top) FROM tn UNION ALL SELECT 'turnover', 'bottom', avg(bottom) FROM tn "
    "UNION ALL SELECT 'hit_rate', 'hits', hits FROM h UNION ALL SELECT 'hit_rate', 'n', n FROM h UNION ALL SELECT 'hit_rate', 'hit_rate', hits / n FROM h)",
)
def validation_run(spark, d):
    """All validations but the stability of the correlation, which has a query of its own, and the p-value, which has no SQL."""
    names = [n for n in validation.CHECKS if n != "stability"]
    rows = validation.result_rows(spark, validation.run_all(panel(spark, d).cache(), "f", "ret", names=names))
    return rows.where("name <> 'p_value'").select("validation", "name", rounded("value", 5).alias("value"))


#: The two-sided p-value of t by the finite series for whole degrees of freedom, in the angle atan(t / sqrt(df)).
P_VALUE = (
    "tt AS (SELECT avg(ic) / (stddev_samp(ic) / sqrt(count(ic))) AS t, count(ic) - 1 AS df FROM ic), th AS (SELECT df, atan(abs(t) / sqrt(df)) AS a FROM tt), "
    "ser AS (SELECT df, a, list_reduce(list_transform(range(0, CAST(floor((df + df % 2) / 2) AS BIGINT)), lambda j: {'s': 1.0::DOUBLE, 't': 1.0::DOUBLE, 'c': cos(a) * cos(a), 'j': j, 'o': df % 2}), "
    "lambda p, x: {'s': p.s + p.t * x.c * CASE WHEN x.o = 1 THEN 2.0 * x.j / (2 * x.j + 1) ELSE (2.0 * x.j - 1) / (2 * x.j) END, 't': p.t * x.c * CASE WHEN x.o = 1 THEN 2.0 * x.j / (2 * x.j + 1) ELSE (2.0 * x.j - 1) / (2 * x.j) END, 'c': x.c, 'j': x.j, 'o': x.o}) AS f, "
    "list_reduce(list_transform(range(0, CAST(floor((df - 1) / 2) AS BIGINT)), lambda j: {'s': 1.0::DOUBLE, 't': 1.0::DOUBLE, 'c': cos(a) * cos(a), 'j': j}), lambda p, x: {'s': p.s + p.t * x.c * 2.0 * x.j / (2 * x.j + 1), 't': p.t * x.c * 2.0 * x.j / (2 * x.j + 1), 'c': x.c, 'j': x.j}) AS g FROM th), "
    "pv AS (SELECT 1 - CASE WHEN df % 2 = 0 THEN sin(a) * f.s ELSE 2 / pi() * (a + sin(a) * cos(a) * coalesce(g.s, 0)) END AS p FROM ser)"
)
STABILITY = (
    "sv AS (SELECT date, ic, CASE WHEN count(ic) OVER w = 60 THEN stddev_samp(ic) OVER w END AS sd, product(1 + ic) OVER u AS c, lag(ic, 1) OVER o AS l1, lag(ic, 2) OVER o AS l2, lag(ic, 3) OVER o AS l3, lag(ic, 4) OVER o AS l4, lag(ic, 5) OVER o AS l5 "
    "FROM ic WINDOW w AS (ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW), u AS (ORDER BY date ROWS UNBOUNDED PRECEDING), o AS (ORDER BY date)), st AS (SELECT *, max(c) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS pk FROM sv)"
)
_ALL = ORACLES["validation_run"].replace(" SELECT validation, name,", f", {P_VALUE}, {STABILITY} SELECT validation, name,").removesuffix(")")


@query(
    "validation_plan",
    _ALL + " UNION ALL SELECT 'information_coefficient', 'p_value', p FROM pv UNION ALL SELECT 'stability', 'mean_rolling_std', avg(sd) FROM st UNION ALL SELECT 'stability', 'max_ic_drawdown', min((c - pk) / pk) FROM st"
    + "".join(f" UNION ALL SELECT 'stability', 'autocorr_{k}', corr(ic, l{k}) FROM st" for k in range(1, 6)) + ")",
)
def validation_plan(spark, d):
    """All validations, with the p-value and the stability of the correlation, as one plan."""
    rows = validation.validation_plan(panel(spark, d), "f", "ret")
    return rows.select("validation", "name", rounded("value", 5).alias("value"))
