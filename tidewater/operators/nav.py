"""Return and risk metrics of daily assets, their periods, and benchmarks.

Every function takes many portfolios at once: rows are keyed by ``by`` (default ``portfolio``), so that one
portfolio's days are ordered in one task and portfolios are spread over tasks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.windows import Series

RISK_FREE = 0.02
YEAR_DAYS = 252

#: Months that a named period goes back.
PERIODS = {"1m": 1, "3m": 3, "6m": 6, "1y": 12, "3y": 36, "5y": 60}


def daily_assets(snapshots: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The last snapshot of each day; of equal times the one appended last (``seq``)."""
    return snapshots.groupBy(*(by or []), F.to_date("created_at").alias("date")).agg(F.max_by("nav", F.struct("created_at", "seq")).alias("assets"))


def with_portfolio(nav: DataFrame, name: str = "all") -> DataFrame:
    return nav.withColumn("portfolio", F.lit(name))


def slices(nav: DataFrame, periods: list[str], by: str = "portfolio") -> DataFrame:
    """Rows of each named period, from the base day on: adds ``period`` and ``base`` (true on the base day).

    A period starts on the latest day that is not after the last day less its months, or on the second day
    of all if there is none, and its base is the day before. ``ytd`` starts on the first day of the last
    day's year. Names that are not known, such as ``all``, start on the second day.
    """
    facts = nav.groupBy(by).agg(F.max("date").alias("_last"), F.min("date").alias("_first"))
    names = F.explode(F.array(*(F.lit(p) for p in periods))).alias("period")
    months = F.create_map(*(F.lit(x) for p, n in PERIODS.items() for x in (p, n)))
    wanted = facts.select(by, "_last", "_first", names).withColumn("_from", F.expr("null").cast("date"))
    wanted = wanted.withColumn("_from", F.when(F.col("period") == "ytd", F.trunc("_last", "year")).otherwise(F.add_months("_last", -F.try_element_at(months, F.col("period")))))
    rows = nav.join(wanted, by)
    second = F.min(F.when(F.col("date") > F.col("_first"), F.col("date")))
    at = F.when(F.first("period") == "ytd", F.min(F.when(F.col("date") >= F.col("_from"), F.col("date")))).otherwise(F.max(F.when((F.col("date") <= F.col("_from")) & (F.col("date") > F.col("_first")), F.col("date"))))
    starts = rows.groupBy(by, "period").agg(F.coalesce(at, second).alias("_start"))
    rows = rows.join(starts, [by, "period"]).withColumn("_base", F.max(F.when(F.col("date") < F.col("_start"), F.col("date"))).over(Window.partitionBy(by, "period")))
    rows = rows.withColumn("_base", F.coalesce("_base", "_first"))
    return rows.where(F.col("date") >= F.col("_base")).withColumn("base", F.col("date") == F.col("_base")).drop("_last", "_first", "_from", "_start", "_base")


def between(nav: DataFrame, start: str | None, end: str | None, by: str = "portfolio") -> DataFrame:
    """Rows from the base day of ``start`` (the latest day before it, else the first of all) to ``end``."""
    d = nav if end is None else nav.where(F.col("date") <= F.lit(end).cast("date"))
    before = F.max(F.when(F.col("date") < F.lit(start).cast("date"), F.col("date"))) if start else F.min("date")
    base = F.coalesce(before.over(Window.partitionBy(by)), F.min("date").over(Window.partitionBy(by)))
    return d.withColumn("_base", base).where(F.col("date") >= F.col("_base")).withColumn("period", F.lit("custom")).withColumn("base", F.col("date") == F.col("_base")).drop("_base")


def returns(nav: DataFrame, keys: list[str]) -> DataFrame:
    """Daily returns ``r``, the running maximum ``peak``, its day, and the drawdown ``dd`` as a share of it."""
    s = Series(keys, "date")
    d = nav.withColumns({"r": s.pct_change("assets"), "peak": s.cum_max("assets")})
    d = d.withColumn("_new", F.when((F.col("assets") == F.col("peak")) & ~F.coalesce(s.lag("peak") >= F.col("assets"), F.lit(False)), F.col("date")))
    return d.withColumns({"dd": F.try_divide(F.col("peak") - F.col("assets"), "peak"), "peak_date": s.ffill("_new")}).drop("_new")


def metrics(nav: DataFrame, keys: list[str], risk_free: float = RISK_FREE, confidence: float = 0.95) -> DataFrame:
    """One row of return and risk metrics for each slice.

    Null where there are fewer than two days, and those of single returns (volatility, tail values, Sortino) where there
    are fewer than two returns; a slice that ends on the day it begins has an annualized return of 0 if it has a return.
    """
    d = returns(nav, keys)
    tail = Window.partitionBy(*keys).orderBy(F.col("r").asc_nulls_last(), "date")
    d = d.withColumns({"_n": F.count("r").over(Window.partitionBy(*keys)), "_k": F.row_number().over(tail)})
    worst = (F.col("_k") <= F.greatest(F.lit(1), F.floor(F.col("_n") * F.lit(1 - confidence) + 1e-9))) & F.col("r").isNotNull()
    down = F.when(F.col("r") < 0, F.col("r") * F.col("r")).when(F.col("r").isNotNull(), 0.0)
    trough = F.struct("dd", -F.unix_date("date"))
    g = d.groupBy(*keys).agg(
        F.min_by("assets", "date").alias("_a"), F.max_by("assets", "date").alias("_z"), F.datediff(F.max("date"), F.min("date")).alias("days"), F.count("*").alias("n_days"),
        F.when(F.count("r") >= 2, F.stddev_pop("r") * F.sqrt(F.lit(float(YEAR_DAYS)))).alias("volatility"),
        F.max("dd").alias("_dd"), F.max_by("date", trough).alias("_trough"), F.max_by("peak_date", trough).alias("_peak"),
        F.count("r").alias("_returns"), F.when(F.count("r") >= 2, -F.percentile("r", F.lit(1 - confidence))).alias("var"), F.when(F.count("r") >= 2, -F.avg(F.when(worst, F.col("r")))).alias("cvar"),
        F.when(F.count("*") >= 2, F.sqrt(F.avg(F.pow(F.col("dd") * 100, F.lit(2.0))))).alias("ulcer_index"), F.sqrt(F.avg(down)).alias("_down"), F.count(F.when(F.col("r") < 0, 1)).alias("_losses"),
    )
    g = g.withColumn("return_rate", F.when(F.col("n_days") >= 2, F.try_divide(F.col("_z") - F.col("_a"), "_a")))
    year = F.when(F.col("return_rate").isNull(), F.lit(None)).when(F.col("days") == 0, 0.0).when(F.col("return_rate") > -1, F.pow(1 + F.col("return_rate"), F.lit(365.0) / F.col("days")) - 1)
    g = g.withColumn("annualized_return", year)
    over = F.col("annualized_return") - risk_free
    return g.select(
        *keys, "n_days", "return_rate", "annualized_return", "volatility", F.try_divide(over, "volatility").alias("sharpe_ratio"),
        F.when(F.col("_dd") > 0, F.col("_dd")).alias("max_drawdown"), F.when(F.col("_dd") > 0, F.col("_peak")).alias("peak_date"), F.when(F.col("_dd") > 0, F.col("_trough")).alias("trough_date"),
        "var", "cvar", "ulcer_index",
        F.when((F.col("_returns") < 2) | over.isNull(), F.lit(None)).when(F.col("_losses") == 0, F.lit(float("inf"))).otherwise(F.try_divide(over, F.col("_down") * F.sqrt(F.lit(float(YEAR_DAYS))))).alias("sortino_ratio"),
        F.try_divide(over, F.col("ulcer_index") / 100).alias("upi"),
    )


def intervals(nav: DataFrame, names: list[str], by: str = "portfolio") -> DataFrame:
    """Rows of each interval of the older report, by ``interval``: from the first day not before the last one less the interval.

    An interval is a number of months or years (``3m``, ``1y``); any other name means all days. Its first day is its base.
    """
    months = {n: int(n[:-1]) * (12 if n[-1] == "y" else 1) for n in names if n[-1] in "my" and n[:-1].isdigit()}
    lasts = nav.groupBy(by).agg(F.max("date").alias("_last"))
    wanted = F.explode(F.array(*(F.struct(F.lit(n).alias("interval"), F.lit(months.get(n)).cast("int").alias("m")) for n in names)))
    d = nav.join(lasts.select(by, "_last", wanted.alias("_w")), by)
    return d.where(F.col("_w.m").isNull() | (F.col("date") >= F.add_months("_last", -F.col("_w.m")))).withColumn("interval", F.col("_w.interval")).drop("_w", "_last")


def legacy_metrics(nav: DataFrame, keys: list[str], risk_free: float = RISK_FREE, confidence: float = 0.95) -> DataFrame:
    """The metrics of the older report, one row for each slice.

    Value at risk goes by position in the sorted returns; the largest drawdown is a percentage, zero or below, with the days
    it fell from and to; an undefined Sharpe ratio is 0; days are those of the slice, its first one is the base of all.
    """
    d = returns(nav, keys)
    tail = Window.partitionBy(*keys).orderBy(F.col("r").asc_nulls_last(), "date")
    d = d.withColumns({"_n": F.count("r").over(Window.partitionBy(*keys)), "_k": F.row_number().over(tail) - 1})
    at = F.when((F.col("_n") >= 2) & (F.col("_k") == F.floor(F.lit(1 - confidence) * F.col("_n"))), -F.col("r"))
    g = d.groupBy(*keys).agg(F.max(at).alias("var_position"), F.min_by("assets", "date").alias("first_assets"), F.max_by("assets", "date").alias("last_assets"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))
    m = metrics(nav, keys, risk_free, confidence).join(g, keys)
    return m.select(
        *keys, "first_date", "last_date", "first_assets", "last_assets", "return_rate", "annualized_return", "volatility", F.coalesce("sharpe_ratio", F.lit(0.0)).alias("sharpe_ratio"), "sortino_ratio",
        F.coalesce(-100 * F.col("max_drawdown"), F.lit(0.0)).alias("max_drawdown_pct"), "peak_date", "trough_date", F.col("var_position").alias("var"), "cvar", "ulcer_index", "upi",
    )


def drawdowns(nav: DataFrame, keys: list[str]) -> DataFrame:
    """Drawdown of each day in percent, zero or below."""
    return returns(nav, keys).select(*keys, "date", (-100 * F.col("dd")).alias("drawdown"))


def align_benchmark(nav: DataFrame, benchmark: DataFrame, by: str = "portfolio") -> DataFrame:
    """Assets with the benchmark's close of the day, or the last one before among the days of the assets; closes of 0 do not count."""
    d = nav.join(benchmark.select("date", F.nullif(F.col("close"), F.lit(0.0)).alias("_c")), "date", "left")
    return d.withColumn("benchmark", Series(by, "date").ffill("_c")).drop("_c")


def excess(aligned: DataFrame, keys: list[str]) -> DataFrame:
    """Cumulative percent of strategy and benchmark since the base day, their difference, and its fall from its own maximum."""
    s = Series(keys, "date")
    base = lambda x: F.first(x, ignorenulls=True).over(s.so_far)
    d = aligned.withColumns({"strategy_pct": 100 * (F.try_divide("assets", base("assets")) - 1), "benchmark_pct": 100 * (F.try_divide("benchmark", base("benchmark")) - 1)})
    d = d.withColumn("excess_pct", F.col("strategy_pct") - F.col("benchmark_pct"))
    return d.withColumn("excess_drawdown", F.col("excess_pct") - s.cum_max("excess_pct")).select(*keys, "date", "strategy_pct", "benchmark_pct", "excess_pct", "excess_drawdown")


def client_metrics(nav: DataFrame, keys: list[str], risk_free: float = RISK_FREE, confidence: float = 0.95) -> DataFrame:
    """The metrics of the browser report, one row for each slice.

    Only the return rate knows the base day (the first, or those marked in ``base``); the tail value goes by
    position, the ulcer index is a fraction, and what is undefined is 0. With a column ``benchmark``, its return
    and drawdown, and the return over it.
    """
    d = nav if "base" in nav.columns else nav.withColumn("base", F.row_number().over(Window.partitionBy(*keys).orderBy("date")) == 1)
    has_benchmark = "benchmark" in d.columns
    if not has_benchmark:
        d = d.withColumn("benchmark", F.lit(None).cast("double"))
    ends = d.groupBy(*keys).agg(*(f(c, "date").alias(f"_{n}{c[0]}") for c in ("assets", "benchmark") for f, n in ((F.min_by, "a"), (F.max_by, "z"))))
    x = returns(d.where(~F.col("base")), keys)
    s = Series(keys, "date")
    x = x.withColumn("_bp", s.cum_max("benchmark")).withColumn("_bd", F.try_divide(F.col("_bp") - F.col("benchmark"), "_bp"))
    x = x.withColumns({"_n": F.count("r").over(Window.partitionBy(*keys)), "_k": F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("r").asc_nulls_last(), "date"))})
    at = F.floor(F.col("_n") * F.lit(1 - confidence) + 1e-9)
    worst = F.col("r").isNotNull() & (F.col("_k") <= F.greatest(F.lit(1).cast("bigint"), at))
    trough = F.struct("dd", -F.unix_date("date"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    year = F.sqrt(F.lit(float(YEAR_DAYS)))
    g = x.groupBy(*keys).agg(
        F.count("*").alias("n_days"), F.datediff(F.max("date"), F.min("date")).alias("_days"), F.count("r").alias("_m"), F.count(F.when(F.col("r") < 0, 1)).alias("_losses"),
        zero(F.max("dd")).alias("max_drawdown"), F.max_by("date", trough).alias("drawdown_end"), F.max("_bd").alias("benchmark_max_drawdown"),
        zero(F.when(F.count("r") >= 2, F.stddev_pop("r") * year)).alias("volatility"), F.sqrt(F.avg(F.when(F.col("r") < 0, F.col("r") * F.col("r")).when(F.col("r").isNotNull(), 0.0))).alias("_down"),
        zero(F.when(F.count("r") >= 2, -F.max(F.when(F.col("_k") - 1 == at, F.col("r"))))).alias("var"), zero(F.when(F.count("r") >= 2, -F.avg(F.when(worst, F.col("r"))))).alias("cvar"),
        zero(F.sqrt(F.avg(F.col("dd") * F.col("dd")))).alias("ulcer_index"),
    ).join(ends, keys)
    g = g.withColumn("return_rate", zero(F.try_divide(F.col("_za") - F.col("_aa"), "_aa")))
    g = g.withColumn("annualized_return", F.when((F.col("_days") == 0) | (F.col("return_rate") <= -1), 0.0).otherwise(F.pow(1 + F.col("return_rate"), F.try_divide(F.lit(365.0), "_days")) - 1))
    over, inf = F.col("annualized_return") - risk_free, F.lit(float("inf"))
    sortino = F.when(F.col("_m") < 2, 0.0).when(F.col("_losses") == 0, inf).otherwise(F.coalesce(F.try_divide(over, F.col("_down") * year), inf))
    out = ["n_days", "return_rate", "annualized_return", "volatility", "max_drawdown", "drawdown_end", zero(F.try_divide(over, "volatility")).alias("sharpe_ratio"), sortino.alias("sortino_ratio"), "var", "cvar", "ulcer_index", zero(F.try_divide(over, "ulcer_index")).alias("upi")]
    if has_benchmark:
        bench = F.try_divide(F.col("_zb") - F.col("_ab"), "_ab")
        out += [bench.alias("benchmark_return"), zero(F.col("benchmark_max_drawdown")).alias("benchmark_max_drawdown"), (F.col("return_rate") - zero(bench)).alias("relative_return")]
    return g.select(*keys, *out)


def client_series(aligned: DataFrame, keys: list[str]) -> DataFrame:
    """Day by day what the browser report draws: cumulative percent, drawdowns and excess over the benchmark."""
    fall = drawdowns(aligned.select(*keys, "date", "assets"), keys).withColumnRenamed("drawdown", "strategy_drawdown")
    bench = drawdowns(aligned.where("benchmark is not null").select(*keys, "date", F.col("benchmark").alias("assets")), keys).withColumnRenamed("drawdown", "benchmark_drawdown")
    return excess(aligned, keys).join(fall, [*keys, "date"], "left").join(bench, [*keys, "date"], "left")


def index_range(nav: DataFrame, keys: list[str], first: int, last: int) -> DataFrame:
    """Return (in percent) and largest drawdown of the days from one place to another, counted from 0, both included."""
    w = Window.partitionBy(*keys).orderBy("date")
    part = nav.withColumn("_i", F.row_number().over(w) - 1).where(F.col("_i").between(first, last))
    g = returns(part, keys).groupBy(*keys).agg(F.min_by("assets", "date").alias("_a"), F.max_by("assets", "date").alias("_z"), (100 * F.max("dd")).alias("max_drawdown_pct"))
    return g.select(*keys, (100 * F.try_divide(F.col("_z") - F.col("_a"), "_a")).alias("period_return_pct"), "max_drawdown_pct")


#: Metrics in the order of reports; users add columns of :func:`metrics` by name.
METRICS = {"return_rate": 10, "annualized_return": 11, "volatility": 20, "max_drawdown": 21, "var": 22, "cvar": 23, "ulcer_index": 24, "sharpe_ratio": 30, "sortino_ratio": 31, "upi": 32}


def register_metric(name: str, order: int = 99) -> None:
    METRICS[name] = order


#: User metrics: name -> (place in reports, what it is, function that builds an aggregate over the rows of :func:`returns`).
BUILDERS: dict[str, tuple[int, str, Callable[[], Column]]] = {}


def metric(name: str, order: int = 99, about: str = "") -> Callable:
    """Decorator: register a metric, a function that returns an aggregate over a slice's days.

    It may use ``date``, ``assets``, ``r`` (the day's return), ``peak`` and ``dd`` (the fall below it as a share).
    """

    def add(f: Callable[[], Column]) -> Callable[[], Column]:
        BUILDERS[name] = (order, about, f)
        return f

    return add


def collected_metrics(nav: DataFrame, keys: list[str], names: list[str] | None = None) -> DataFrame:
    """All metrics of each slice as rows ``name, place, value, error``, those of :func:`metrics` and the registered ones.

    A registered metric that cannot be built (whatever its function raises, or an expression that does not fit the columns)
    is a row with its error and no value, beside the others. What is undefined should be null: with ``try_divide`` and the
    like, since an error while the query runs fails it as a whole.
    """
    wide = metrics(nav, keys)
    days = returns(nav, keys)
    made: dict[str, Column] = {}
    errors: dict[str, str] = {}
    for n, (_, _, build) in BUILDERS.items():
        if names is not None and n not in names:
            continue
        try:
            column = build().cast("double").alias(n)
            days.groupBy(*keys).agg(column)  # analysed, not run
            made[n] = column
        except Exception as e:  # noqa: BLE001  whatever a user's metric raises
            errors[n] = str(e) or type(e).__name__
    if made:
        wide = wide.join(days.groupBy(*keys).agg(*made.values()), keys)
    places = {**METRICS, **{n: o for n, (o, _, _) in BUILDERS.items()}}
    chosen = sorted((n for n in places if (names is None or n in names) and (n in wide.columns or n in errors)), key=lambda n: (places[n], n))
    rows = [F.struct(F.lit(n).alias("name"), F.lit(i).alias("place"), (F.lit(None) if n in errors else F.col(n)).cast("double").alias("value"), F.lit(errors.get(n)).cast("string").alias("error")) for i, n in enumerate(chosen)]
    return wide.select(*keys, F.explode(F.array(*rows)).alias("_m")).select(*keys, "_m.*")


def metric_rows(wide: DataFrame, keys: list[str], names: list[str] | None = None) -> DataFrame:
    """Metrics as rows ``name, place, value`` in their registered order; metrics that ``wide`` lacks are left out."""
    chosen = sorted((n for n in names or METRICS if n in wide.columns), key=lambda n: (METRICS.get(n, 99), n))
    rows = wide.select(*keys, *(F.col(n).cast("double").alias(n) for n in chosen)).unpivot(keys, chosen, "name", "value")
    places = F.create_map(*(F.lit(x) for i, n in enumerate(chosen) for x in (n, i)))
    return rows.select(*keys, "name", F.element_at(places, F.col("name")).alias("place"), "value")
