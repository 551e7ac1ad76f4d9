"""Timing signals: each adds one column to a table of bars.

Undefined ratios are spelled out case by case, since division by zero is an error in ANSI mode.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions import scans
from tidewater.functions.windows import Series, with_overlap

BARS = Series(["symbol", "frequency"], ["eob"])


def ma_cross(df: DataFrame, short: int = 5, long: int = 20, price: str = "close", out: str = "ma", s: Series = BARS) -> DataFrame:
    """Short over long moving average, less one; null until the long one is full."""
    slow = s.mean(price, long)
    return df.withColumn(out, F.try_divide(s.mean(price, short) - slow, slow))


def macd(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, price: str = "close", out: str = "macd", s: Series = BARS) -> DataFrame:
    """Difference of two exponential means, less its own exponential mean."""
    d = df.withColumn("_dif", s.ewm(price, span=fast) - s.ewm(price, span=slow))
    return d.withColumn(out, F.col("_dif") - s.ewm("_dif", span=signal)).drop("_dif")


def rsi(df: DataFrame, period: int = 14, price: str = "close", out: str = "rsi", s: Series = BARS) -> DataFrame:
    """Relative strength with simple means of gains and losses, centred at zero."""
    d = df.withColumn("_d", s.diff(price))
    gain = F.when(F.col("_d") > 0, F.col("_d")).otherwise(0.0)
    loss = F.when(F.col("_d") < 0, -F.col("_d")).otherwise(0.0)
    d = d.withColumns({"_g": s.mean(gain, period), "_l": s.mean(loss, period)})
    value = F.when(F.col("_g").isNull() | ((F.col("_l") == 0) & (F.col("_g") == 0)), 50.0).when(F.col("_l") == 0, 100.0).otherwise(100.0 - F.lit(100.0) / (1.0 + F.try_divide("_g", "_l")))
    return d.withColumn(out, value - 50.0).drop("_d", "_g", "_l")


def kdj(df: DataFrame, n: int = 9, m1: int = 3, m2: int = 3, out: str = "kdj", s: Series = BARS) -> DataFrame:
    """K less D of the stochastic oscillator."""
    d = df.withColumns({"_lo": s.min("low", n), "_hi": s.max("high", n)})
    d = d.withColumn("_rsv", F.coalesce(F.try_divide(F.col("close") - F.col("_lo"), F.col("_hi") - F.col("_lo")) * 100.0, F.lit(50.0)))
    d = d.withColumn("_k", s.ewm("_rsv", com=m1 - 1))
    return d.withColumn(out, F.col("_k") - s.ewm("_k", com=m2 - 1)).drop("_lo", "_hi", "_rsv", "_k")


def boll(df: DataFrame, n: int = 20, width: float = 2.0, price: str = "close", out: str = "boll", s: Series = BARS) -> DataFrame:
    """Place within the Bollinger band, centred at zero; zero where there is no band."""
    mid, dev = s.mean(price, n), s.std(price, n)
    return df.withColumn(out, F.coalesce(F.try_divide(F.col(price) - (mid - width * dev), 2 * width * dev) - 0.5, F.lit(0.0)))


def volume_ratio(df: DataFrame, n: int = 5, volume: str = "volume", out: str = "vol", s: Series = BARS) -> DataFrame:
    return df.withColumn(out, F.try_divide(F.col(volume), s.mean(volume, n)) - 1)


def rsrs(df: DataFrame, n: int = 18, m: int = 600, out: str = "rsrs", s: Series = BARS) -> DataFrame:
    """Z-score, over ``m`` rows, of the sample covariance of high and low over the population variance of low.

    A series with fewer than ``m`` slopes gives the slopes themselves; nulls become zero.
    """
    w = s.last(n)
    full = F.count(F.when(F.col("high").isNotNull() & F.col("low").isNotNull(), 1)).over(w) == n
    slope = F.try_divide(F.covar_samp("high", "low").over(w), F.var_pop("low").over(w))
    d = df.withColumn("_b", F.when(full, slope))
    z = F.try_divide(F.col("_b") - s.mean("_b", m), s.std("_b", m))
    return d.withColumn(out, F.coalesce(F.when(F.count("_b").over(s.whole) < m, F.col("_b")).otherwise(z), F.lit(0.0))).drop("_b")


def momentum(df: DataFrame, n: int = 20, price: str = "close", out: str = "momentum", s: Series = BARS) -> DataFrame:
    return df.withColumn(out, s.pct_change(price, n))


def volatility(df: DataFrame, n: int = 20, price: str = "close", out: str = "volatility", s: Series = BARS) -> DataFrame:
    """Two deviations over the mean."""
    return df.withColumn(out, F.try_divide(2 * s.std(price, n), s.mean(price, n)))


def row_mean(names: list[str]) -> Column:
    """Mean of the columns that are not null."""
    return F.try_divide(sum((F.coalesce(F.col(c), F.lit(0.0)) for c in names), F.lit(0.0)), sum((F.col(c).isNotNull().cast("double") for c in names), F.lit(0.0)))


def composite(df: DataFrame, names: list[str], out: str = "composite") -> DataFrame:
    return df.withColumn(out, row_mean(names))


def custom(df: DataFrame, make: Callable[[DataFrame], Column], out: str) -> DataFrame:
    return df.withColumn(out, make(df))


def in_chunks(df: DataFrame, make: Callable[[DataFrame, Series], DataFrame], rows: int, chunk: int = 1_000_000, s: Series = BARS) -> DataFrame:
    """A signal over series too long for one task: cut into chunks that carry the ``rows`` bars before them.

    ``make(bars, series)`` adds the signal; ``rows`` must cover all that its windows look back on.
    """
    d = with_overlap(df, s.by, s.order[0], rows, chunk)
    return make(d, Series([*s.by, "_chunk"], s.order)).where(~F.col("_warm")).drop("_own", "_chunk", "_warm")


def latest_direction(df: DataFrame, name: str, s: Series = BARS) -> DataFrame:
    """The newest value of each series and its sign; null counts as neutral."""
    return df.groupBy(*s.by).agg(F.max_by(name, s.order[0]).alias("value")).withColumn("direction", F.coalesce(F.signum("value"), F.lit(0.0)).cast("int"))


# Fusion ---------------------------------------------------------------------------------------------


def fuse_vote(df: DataFrame, names: list[str], out: str = "fused") -> DataFrame:
    """Sign of the sum of signs."""
    return df.withColumn(out, F.signum(sum((F.coalesce(F.signum(c), F.lit(0.0)) for c in names), F.lit(0.0))))


def vote_with_strength(df: DataFrame, names: list[str]) -> DataFrame:
    """The majority's direction and its share of the signals; a tie is neutral."""
    up, down = (sum(((F.coalesce(F.col(c), F.lit(0.0)) > 0 if k else F.coalesce(F.col(c), F.lit(0.0)) < 0).cast("int") for c in names), F.lit(0)) for k in (1, 0))
    way = F.when(up > down, 1).when(down > up, -1).otherwise(0)
    return df.withColumns({"direction": way, "strength": F.when(way == 1, up).when(way == -1, down).otherwise(len(names) - up - down) / F.lit(float(len(names)))})


def fuse_score(df: DataFrame, names: list[str], weights: dict[str, float] | None = None, out: str = "fused", s: Series = BARS) -> DataFrame:
    """Weighted sum of hyperbolic tangents over the largest absolute sum of the whole series (which looks ahead)."""
    total = sum((F.lit(float((weights or {}).get(c, 1.0))) * F.tanh(F.coalesce(F.col(c), F.lit(0.0))) for c in names), F.lit(0.0))
    d = df.withColumn("_t", total)
    top = F.max(F.abs("_t")).over(s.whole)
    return d.withColumn(out, F.when(top > 0, F.col("_t") / top).otherwise(F.col("_t"))).drop("_t")


def score_rows(df: DataFrame, names: list[str], weights: dict[str, float] | None = None) -> DataFrame:
    """Row by row the weighted mean of hyperbolic tangents of the signals that are known: its sign and its size."""
    w = {c: float((weights or {}).get(c, 1.0)) for c in names}
    known = lambda c, x: F.when(F.col(c).isNotNull(), x).otherwise(0.0)
    score = F.coalesce(F.try_divide(sum((known(c, w[c] * F.tanh(F.col(c))) for c in names), F.lit(0.0)), sum((known(c, F.lit(w[c])) for c in names), F.lit(0.0))), F.lit(0.0))
    return with_strength_rule(df.withColumns({"direction": F.signum(score).cast("int"), "strength": F.abs(score)}), names)


def with_strength_rule(df: DataFrame, names: list[str], least: float = 0.5) -> DataFrame:
    """A strength of exactly 1, unless neutral, becomes the mean size of the signals; ``actionable`` from ``least`` on."""
    sizes = F.try_divide(sum((F.coalesce(F.abs(c), F.lit(0.0)) for c in names), F.lit(0.0)), sum((F.col(c).isNotNull().cast("double") for c in names), F.lit(0.0)))
    d = df.withColumn("strength", F.when(F.col("direction") == 0, 0.0).when(F.col("strength") == 1.0, sizes).otherwise(F.col("strength")))
    return d.withColumn("actionable", F.coalesce(F.col("strength") >= least, F.lit(False)))


def fuse_weighted(df: DataFrame, names: list[str], weights: dict[str, float], out: str = "fused", unlisted: float = 1.0) -> DataFrame:
    """Weighted sum; a row-wise combination gives unlisted signals weight 0, a series-wise one keeps them at 1. Listed weights are normalized."""
    total = sum(weights.values()) or 1.0
    return df.withColumn(out, sum((F.lit(weights[c] / total if c in weights else unlisted) * F.coalesce(F.col(c), F.lit(0.0)) for c in names), F.lit(0.0)))


def fuse_adaptive(df: DataFrame, names: list[str], returns: str, out: str = "fused", s: Series = BARS) -> DataFrame:
    """Signals weighted by the absolute correlation of their previous value with returns, over each whole series; equal weights where all are zero."""
    d = df.withColumns({f"_p{i}": s.lag(c) for i, c in enumerate(names)})
    for i in range(len(names)):
        known = F.col(f"_p{i}").isNotNull() & F.col(returns).isNotNull()
        x, y = F.when(known, F.col(f"_p{i}")), F.when(known, F.col(returns))
        corr = F.try_divide(F.covar_pop(x, y).over(s.whole), F.stddev_pop(x).over(s.whole) * F.stddev_pop(y).over(s.whole))
        d = d.withColumn(f"_w{i}", F.abs(F.coalesce(corr, F.lit(0.0))))
    total = sum((F.col(f"_w{i}") for i in range(len(names))), F.lit(0.0))
    parts = [F.when(total > 0, F.col(f"_w{i}") / total).otherwise(1.0 / len(names)) * F.coalesce(F.col(c), F.lit(0.0)) for i, c in enumerate(names)]
    return d.withColumn(out, sum(parts, F.lit(0.0))).drop(*(f"_{k}{i}" for k in "pw" for i in range(len(names))))


def fuse_equal(df: DataFrame, names: list[str], out: str = "fused") -> DataFrame:
    return df.withColumn(out, row_mean(names))


# Thresholds -----------------------------------------------------------------------------------------

# The named thresholds, upper and lower bound.
PRESETS = {
    "conservative": (0.5, -0.5),
    "moderate": (0.2, -0.2),
    "aggressive": (0.0, 0.0),
    "macd": (0.0, 0.0),
    "rsi": (20.0, -20.0),
    "boll": (0.2, -0.2),
}


def thr_preset(df: DataFrame, x: str, name: str, out: str = "position") -> DataFrame:
    upper, lower = PRESETS[name]
    return thr_simple(df, x, upper, lower, symmetric=False, out=out)


def _side(x: Column, upper: Column, lower: Column) -> Column:
    return F.when(x > upper, 1).when(x < lower, -1).otherwise(0)


def thr_simple(df: DataFrame, x: str, upper: float, lower: float = 0.0, symmetric: bool = True, out: str = "position") -> DataFrame:
    """Beyond fixed bounds; a symmetric threshold takes its lower bound from the upper one."""
    return df.withColumn(out, _side(F.col(x), F.lit(upper), F.lit(-upper if symmetric else lower)))


def thr_percentile(df: DataFrame, x: str, upper: float = 75, lower: float = 25, out: str = "position", s: Series = BARS) -> DataFrame:
    """Beyond interpolated percentiles of the whole series."""
    bounds = df.groupBy(*s.by).agg(F.percentile(x, F.lit(upper / 100)).alias("_u"), F.percentile(x, F.lit(lower / 100)).alias("_l"))
    return df.join(bounds, s.by).withColumn(out, _side(F.col(x), F.col("_u"), F.col("_l"))).drop("_u", "_l")


def thr_zscore(df: DataFrame, x: str, z: float = 1.0, out: str = "position", s: Series = BARS) -> DataFrame:
    """Beyond ``z`` sample deviations from the mean of the whole series; a constant series is neutral."""
    facts = df.groupBy(*s.by).agg(F.avg(x).alias("_m"), F.stddev_samp(x).alias("_s"))
    score = F.try_divide(F.col(x) - F.col("_m"), F.col("_s"))
    return df.join(facts, s.by).withColumn(out, _side(score, F.lit(z), F.lit(-z))).drop("_m", "_s")


def thr_moving(df: DataFrame, x: str, n: int = 20, buffer: float = 0.0, out: str = "position", s: Series = BARS) -> DataFrame:
    """Beyond the signal's own moving average, plus or minus a buffer."""
    d = df.withColumn("_m", s.mean(x, n))
    return d.withColumn(out, _side(F.col(x), F.col("_m") + buffer, F.col("_m") - buffer)).drop("_m")


def thr_dual(df: DataFrame, x: str, entry_long: float, entry_short: float, exit_long: float, exit_short: float, out: str = "position", s: Series = BARS) -> DataFrame:
    """Sticky position: flat until an entry; long turns short below ``exit_short``, short turns long above ``exit_long``; null holds.

    A row maps the position before it to the one after. Once a position is held, such a map sends both sides to one side,
    turns them round (both exits hold at once), or keeps them; so the position is the side it was last sent to, turned by
    the parity of the turns since.
    """
    v = F.col(x)
    if exit_short <= exit_long:
        d = df.withColumn("_e", F.when(v > entry_long, 1).when(v < entry_short, -1))
        d = d.withColumn("_e0", F.first("_e", ignorenulls=True).over(s.so_far)).withColumn("_was", s.lag("_e0"))
        d = d.withColumn("_ev", F.when(F.col("_was").isNull(), F.col("_e0")).when(v > exit_long, 1).when(v < exit_short, -1))
        return d.withColumn(out, F.coalesce(s.ffill("_ev"), F.lit(0))).drop("_e", "_e0", "_was", "_ev")
    d = df.withColumn("_e", F.when(v > entry_long, 1).when(v < entry_short, -1))
    d = d.withColumn("_held", F.coalesce(s.lag(F.count("_e").over(s.so_far)) > 0, F.lit(False)))
    turn, sent = _dual_maps(v, exit_long, exit_short)
    d = d.withColumn("_t", F.sum(turn).over(s.so_far) % 2)
    d = d.withColumn("_ev", sent * (1 - 2 * F.col("_t")))
    return d.withColumn(out, F.coalesce(s.ffill("_ev") * (1 - 2 * F.col("_t")), F.lit(0)).cast("int")).drop("_e", "_held", "_t", "_ev")


def _dual_maps(v: Column, exit_long: float, exit_short: float) -> tuple[Column, Column]:
    """Of a row with ``_e`` (its entry) and ``_held`` (a position is held before it): 1 if it turns both sides round, and the side it sends both to."""
    up, down = v > exit_long, v < exit_short
    turn = F.when(F.col("_held") & up & down, 1).otherwise(0)
    sent = F.when(~F.col("_held"), F.col("_e")).when(up & down, F.lit(None)).when(up, 1).when(down, -1)
    return turn, sent


def thr_dual_scanned(df: DataFrame, x: str, entry_long: float, entry_short: float, exit_long: float, exit_short: float, out: str = "position", unit: str | float = "month", s: Series = BARS) -> DataFrame:
    """:func:`thr_dual` over series too long for one task. ``s`` is ordered by one column without ties."""
    v, at = F.col(x), F.col(s.order[0])
    d = df.withColumn("_e", F.when(v > entry_long, 1).when(v < entry_short, -1))
    d = scans.running(d, s, {"_first": ("min", F.when(F.col("_e").isNotNull(), at))}, unit)
    d = d.withColumn("_held", F.coalesce(F.col("_first") < at, F.lit(False)))
    turn, sent = _dual_maps(v, exit_long, exit_short)
    d = scans.running(d, s, {"_t": ("sum", turn)}, unit).withColumn("_t", F.col("_t") % 2)
    d = scans.running(d, s, {"_ev": ("last", sent * (1 - 2 * F.col("_t")))}, unit)
    return d.withColumn(out, F.coalesce(F.col("_ev") * (1 - 2 * F.col("_t")), F.lit(0)).cast("int")).drop("_e", "_first", "_held", "_t", "_ev")


def macd_scanned(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, price: str = "close", out: str = "macd", unit: str | float = "month", s: Series = BARS) -> DataFrame:
    """:func:`macd` over series too long for one task."""
    d = scans.ewm(df, s, {"_fast": (F.col(price), scans.keep_of(span=fast)), "_slow": (F.col(price), scans.keep_of(span=slow))}, unit)
    d = d.withColumn("_dif", F.col("_fast") - F.col("_slow"))
    d = scans.ewm(d, s, {"_dea": (F.col("_dif"), scans.keep_of(span=signal))}, unit)
    return d.withColumn(out, F.col("_dif") - F.col("_dea")).drop("_fast", "_slow", "_dif", "_dea")


def kdj_scanned(df: DataFrame, n: int = 9, m1: int = 3, m2: int = 3, out: str = "kdj", unit: str | float = "month", chunk: int = 1_000_000, s: Series = BARS) -> DataFrame:
    """:func:`kdj` over series too long for one task: the range of ``n`` rows by chunks that overlap, the means by scans."""
    def rsv(d: DataFrame, t: Series) -> DataFrame:
        d = d.withColumns({"_lo": t.min("low", n), "_hi": t.max("high", n)})
        return d.withColumn("_rsv", F.coalesce(F.try_divide(F.col("close") - F.col("_lo"), F.col("_hi") - F.col("_lo")) * 100.0, F.lit(50.0))).drop("_lo", "_hi")

    d = scans.ewm(in_chunks(df, rsv, n - 1, chunk, s), s, {"_k": (F.col("_rsv"), scans.keep_of(com=m1 - 1))}, unit)
    d = scans.ewm(d, s, {"_d": (F.col("_k"), scans.keep_of(com=m2 - 1))}, unit)
    return d.withColumn(out, F.col("_k") - F.col("_d")).drop("_rsv", "_k", "_d")


def strategy_returns_scanned(df: DataFrame, position: str, price: str = "close", unit: str | float = "month", chunk: int = 1_000_000, s: Series = BARS) -> DataFrame:
    """:func:`strategy_returns` over series too long for one task, and ``drawdown``, the fall of growth below its maximum so far."""
    def held(d: DataFrame, t: Series) -> DataFrame:
        return d.withColumn("ret", t.pct_change(price)).withColumn("strategy", F.col("ret") * t.lag(position))

    d = scans.running(in_chunks(df, held, 1, chunk, s), s, {"growth": ("product", 1 + F.coalesce(F.col("strategy"), F.lit(0.0)))}, unit)
    d = scans.running(d, s, {"_top": ("max", F.col("growth"))}, unit)
    return d.withColumns({"drawdown": F.try_divide(F.col("_top") - F.col("growth"), "_top"), "growth": F.col("growth") - 1}).drop("_top")


def strategy_returns(df: DataFrame, position: str, price: str = "close", s: Series = BARS) -> DataFrame:
    """Each bar's return times the position held into it, and the compounded result so far."""
    d = df.withColumn("ret", s.pct_change(price)).withColumn("strategy", F.col("ret") * s.lag(position))
    return d.withColumn("growth", s.cum_prod(1 + F.coalesce(F.col("strategy"), F.lit(0.0))) - 1)


#: Signals by name; users add their own with :func:`register`.
REGISTRY: dict[str, Callable[..., DataFrame]] = {"ma": ma_cross, "macd": macd, "rsi": rsi, "kdj": kdj, "boll": boll, "vol": volume_ratio, "rsrs": rsrs, "momentum": momentum, "volatility": volatility}

# The templates' signals and parameters.
TEMPLATES = {
    "ma_short": ("ma", {"short": 5, "long": 20}),
    "ma_medium": ("ma", {"short": 10, "long": 60}),
    "ma_long": ("ma", {"short": 20, "long": 120}),
    "macd_standard": ("macd", {"fast": 12, "slow": 26, "signal": 9}),
    "macd_fast": ("macd", {"fast": 6, "slow": 13, "signal": 5}),
    "macd_slow": ("macd", {"fast": 19, "slow": 39, "signal": 9}),
    "rsi_fast": ("rsi", {"period": 6}),
    "rsi_standard": ("rsi", {"period": 14}),
    "rsi_slow": ("rsi", {"period": 28}),
    "kdj_standard": ("kdj", {"n": 9, "m1": 3, "m2": 3}),
    "kdj_fast": ("kdj", {"n": 5, "m1": 2, "m2": 2}),
    "boll_standard": ("boll", {"n": 20, "width": 2.0}),
    "boll_narrow": ("boll", {"n": 20, "width": 1.0}),
    "boll_wide": ("boll", {"n": 20, "width": 3.0}),
    "vol_short": ("vol", {"n": 5}),
    "vol_medium": ("vol", {"n": 10}),
    "rsrs_standard": ("rsrs", {"n": 18, "m": 600}),
}


def register(name: str, make: Callable[..., DataFrame]) -> None:
    REGISTRY[name] = make


def apply_signal(df: DataFrame, name: str, out: str | None = None, **params) -> DataFrame:
    """Add the signal or template ``name``; parameters override a template's."""
    kind, fixed = TEMPLATES.get(name, (name, {}))
    if kind not in REGISTRY:
        raise ValueError(f"unknown signal {name!r}; known: {sorted({*REGISTRY, *TEMPLATES})}")
    return REGISTRY[kind](df, out=out or name, **{**fixed, **params})


def signal_set(df: DataFrame, names: list[str]) -> DataFrame:
    """One column for each named signal or template."""
    for n in names:
        df = apply_signal(df, n)
    return df


def position_window(df: DataFrame, start: str, end: str) -> DataFrame:
    """Rows of a period, bounds included; windows are to be computed before."""
    return df.where(F.col("eob").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))
