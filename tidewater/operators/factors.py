"""Factors over long panels (``date, symbol, fields``) and their validation by date.

A factor is a function from a panel to a panel with one more column. Cross-sections are partitioned by date,
histories by symbol.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.functions.stats import safe_corr
from tidewater.functions.windows import Series, avg_rank, quantile_bucket

PANEL = Series("symbol", "date")
MIN_PAIRS = 10

Factor = Callable[[DataFrame], DataFrame]


def ln_close(panel: DataFrame, out: str = "ln_close") -> DataFrame:
    return panel.withColumn(out, F.when(F.col("close") > 0, F.ln("close")))


def momentum(panel: DataFrame, n: int = 20, out: str = "momentum") -> DataFrame:
    return panel.withColumn(out, PANEL.pct_change("close", n))


def volume(panel: DataFrame, n: int = 20, out: str = "volume_factor") -> DataFrame:
    return panel.withColumn(out, F.try_divide(F.col("volume"), PANEL.mean("volume", n)) - 1)


def volatility(panel: DataFrame, n: int = 20, out: str = "volatility") -> DataFrame:
    d = panel.withColumn("_r", PANEL.pct_change("close"))
    return d.withColumn(out, PANEL.std("_r", n)).drop("_r")


def future_return(panel: DataFrame, out: str = "future_return") -> DataFrame:
    return panel.withColumn(out, F.try_divide(PANEL.lead("close"), F.col("close")) - 1)


class FactorGraph:
    """Factors by name, with those they are computed from."""

    def __init__(self):
        self.factors: dict[str, tuple[Factor, tuple[str, ...]]] = {}
        #: What went wrong in the last calculation, by factor.
        self.errors: dict[str, str] = {}
        self.counts = {"calculated": 0, "failed": 0}

    def register(self, name: str, factor: Factor, depends: tuple[str, ...] = ()) -> None:
        self.factors[name] = (factor, tuple(depends))

    def levels(self, names: list[str] | None = None) -> list[list[str]]:
        """Names in batches, each after what it depends on."""
        want, seen = list(names or self.factors), set()
        while want:
            n = want.pop()
            if n not in seen:
                if n not in self.factors:
                    raise ValueError(f"unknown factor {n!r}, or a cycle through it")
                seen.add(n)
                want += self.factors[n][1]
        out: list[list[str]] = []
        done: set[str] = set()
        while len(done) < len(seen):
            ready = sorted(n for n in seen - done if set(self.factors[n][1]) <= done)
            if not ready:
                raise ValueError(f"cycle among factors {sorted(seen - done)}")
            out.append(ready)
            done.update(ready)
        return out

    def calculate(self, panel: DataFrame, names: list[str] | None = None) -> DataFrame:
        """The panel with all named factors, and those they need, as columns: one plan, evaluated together.

        A factor whose plan cannot be made, or lacks its column, is null throughout and named in ``errors``.
        """
        self.errors = {}
        for level in self.levels(names):
            for n in level:
                try:
                    got = self.factors[n][0](panel)
                    if n not in got.columns:
                        raise ValueError(f"no column {n!r} came back")
                    panel, kind = got, "calculated"
                except Exception as e:  # noqa: BLE001  whatever a user's factor raises
                    panel, kind = panel.withColumn(n, F.lit(None).cast("double")), "failed"
                    self.errors[n] = str(e)
                self.counts[kind] += 1
        return panel

    def factor(self, name: str, depends: tuple[str, ...] = ()) -> Callable[[Factor], Factor]:
        """Decorator: register a function as a factor."""

        def add(f: Factor) -> Factor:
            self.register(name, f, depends)
            return f

        return add

    def statistics(self) -> dict[str, int]:
        return {"registered": len(self.factors), **self.counts}


def dated(panel: DataFrame) -> DataFrame:
    """Adds ``date_idx``, from 0 over all dates of the panel, and ``n_dates``."""
    dates = panel.select("date").distinct()
    # One row per date: the calendar, not the data, is ordered in one task.
    n = dates.withColumn("date_idx", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("date")) - 1).withColumn("n_dates", F.count("*").over(Window.partitionBy(F.lit(0))))
    return panel.join(n, "date")


def aligned(panel: DataFrame, factor: str, ret: str, k: int = 1, align: str = "label") -> DataFrame:
    """Rows that pair a factor with a return: ``label`` takes those of one date and leaves out the first and last ``k`` dates; ``shifted`` takes the return ``k`` rows later."""
    k = max(1, k)
    if align == "shifted":
        return panel.withColumn("_r", PANEL.lead(ret, k)).drop(ret).withColumnRenamed("_r", ret)
    return dated(panel).where(F.col("date_idx").between(F.lit(k), F.col("n_dates") - 1 - k)).drop("date_idx", "n_dates")


def ic_by_date(panel: DataFrame, factor: str, ret: str, method: str = "spearman", min_pairs: int = MIN_PAIRS) -> DataFrame:
    """The correlation of factor and return on each date with enough pairs; dates on which one is constant drop out."""
    d = panel.where(F.col(factor).isNotNull() & F.col(ret).isNotNull()).select("date", F.col(factor).cast("double").alias("x"), F.col(ret).cast("double").alias("y"))
    if method == "spearman":
        d = d.select("date", avg_rank("x", ["date"]).alias("x"), avg_rank("y", ["date"]).alias("y"))
    return d.groupBy("date").agg(safe_corr("x", "y").alias("ic"), F.count("*").alias("n")).where((F.col("n") >= min_pairs) & F.col("ic").isNotNull()).drop("n")


def ic_summary(ics: DataFrame) -> DataFrame:
    """Mean, population deviation, their ratio, the positive share, the t statistic and the number of dates."""
    mean, std = F.avg("ic"), F.stddev_pop("ic")
    return ics.agg(mean.alias("ic_mean"), std.alias("ic_std"), F.try_divide(mean, std).alias("ic_ir"), F.avg((F.col("ic") > 0).cast("double")).alias("positive_ratio"), F.try_divide(mean, F.stddev_samp("ic") / F.sqrt(F.count("ic"))).alias("t_stat"), F.count("ic").alias("n"))


def buckets(panel: DataFrame, factor: str, q: int = 10, out: str = "bucket") -> DataFrame:
    """Equal-frequency buckets by date; null factors have none."""
    return panel.withColumn(out, quantile_bucket(factor, "symbol", ["date"], q))


def turnover(panel: DataFrame, factor: str, q: int = 10, k: int = 1) -> DataFrame:
    """Share of symbols that change bucket over ``k`` dates: by date, all, top and bottom."""
    b = dated(buckets(panel, factor, q)).where("bucket is not null").select("date", "date_idx", "symbol", "bucket")
    before = b.select((F.col("date_idx") + k).alias("date_idx"), "symbol", F.col("bucket").alias("was"))
    m = b.join(before, ["date_idx", "symbol"])
    moved = (F.col("bucket") != F.col("was")).cast("double")
    return m.groupBy("date").agg(F.avg(moved).alias("turnover"), F.avg(F.when(F.col("was") == q, moved)).alias("top"), F.avg(F.when(F.col("was") == 1, moved)).alias("bottom"))


def group_returns(panel: DataFrame, factor: str, ret: str, q: int = 10, k: int = 1, weight: str | None = None, align: str = "label") -> DataFrame:
    """Mean return of each bucket: by date first (weighted if asked for), then over dates. Buckets are made before null returns drop out."""
    d = aligned(buckets(panel, factor, q), factor, ret, k, align).where(F.col("bucket").isNotNull() & F.col(ret).isNotNull())
    one = F.avg(ret) if weight is None else F.try_divide(F.sum(F.col(ret) * F.col(weight)), F.sum(weight))
    return d.groupBy("date", "bucket").agg(one.alias("_r")).groupBy("bucket").agg(F.avg("_r").alias("mean_return"), F.count("_r").alias("n_dates"))


def monotonicity(groups: DataFrame) -> DataFrame:
    """Spread between last and first bucket, and the absolute rank correlation of bucket and return (null under three buckets)."""
    r = groups.withColumns({"_b": F.rank().over(Window.partitionBy(F.lit(0)).orderBy("bucket")), "_r": F.rank().over(Window.partitionBy(F.lit(0)).orderBy("mean_return"))})  # as many rows as buckets
    return r.agg((F.max_by("mean_return", "bucket") - F.min_by("mean_return", "bucket")).alias("spread"), F.when(F.count("*") >= 3, F.abs(safe_corr("_b", "_r"))).alias("monotonicity"))


def ic_decay(panel: DataFrame, factor: str, ret: str, max_k: int = 20, align: str = "label") -> DataFrame:
    """Mean correlation for each distance ``k``. With label alignment it is a mean over fewer and fewer dates."""
    if align == "label":
        ics = dated(panel.select("date").distinct()).join(ic_by_date(panel, factor, ret), "date")
        d = ics.withColumn("k", F.explode(F.sequence(F.lit(1), F.least(F.lit(max_k), F.floor(F.col("n_dates") / 2).cast("int") - 1))))
        d = d.where(F.col("date_idx").between(F.col("k"), F.col("n_dates") - 1 - F.col("k")))
        return d.groupBy("k").agg(F.avg("ic").alias("ic_mean"), F.count("ic").alias("n"))
    parts = [ic_by_date(aligned(panel, factor, ret, k, align), factor, ret).agg(F.lit(k).alias("k"), F.avg("ic").alias("ic_mean"), F.count("ic").alias("n")) for k in range(1, max_k + 1)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def half_life(decay: DataFrame) -> DataFrame:
    """Of an exponential fitted to the absolute means; infinite if they do not fall, null under three points."""
    x = F.when(F.abs("ic_mean") > 0, F.ln(F.abs("ic_mean")))
    d = decay.select("k", x.alias("y")).where("y is not null").agg(F.regr_slope("y", "k").alias("_s"), F.count("*").alias("_n"))
    rate = -F.col("_s")
    return d.select(F.when(F.col("_n") >= 3, rate).alias("decay_rate"), F.when(F.col("_n") >= 3, F.when(rate > 0, F.ln(F.lit(2.0)) / rate).otherwise(F.lit(float("inf")))).alias("half_life"))


def hit_rate(panel: DataFrame, factor: str, ret: str, k: int = 1, min_pairs: int = MIN_PAIRS, align: str = "label") -> DataFrame:
    """Share of pairs, over all dates, in which factor and return are on the same side of the date's medians."""
    d = aligned(panel, factor, ret, k, align).where(F.col(factor).isNotNull() & F.col(ret).isNotNull())
    meds = d.groupBy("date").agg(F.percentile(factor, F.lit(0.5)).alias("_f"), F.percentile(ret, F.lit(0.5)).alias("_r"), F.count("*").alias("_n")).where(F.col("_n") >= min_pairs)
    hit = ((F.col(factor) > F.col("_f")) == (F.col(ret) > F.col("_r"))).cast("long")
    return d.join(meds, "date").agg(F.sum(hit).alias("hits"), F.count("*").alias("n")).withColumn("hit_rate", F.try_divide("hits", "n"))


def stability(ics: DataFrame, window: int = 60) -> DataFrame:
    """Mean rolling deviation of the correlations, the largest fall of their compounded series, and autocorrelations of lags 1 to 5."""
    s = Series("_one", "date")
    d = ics.withColumn("_one", F.lit(0))  # one row per date
    d = d.withColumns({"_s": s.std("ic", window), "_c": s.cum_prod(1 + F.col("ic")), **{f"_l{k}": s.lag("ic", k) for k in range(1, 6)}})
    d = d.withColumn("_p", s.cum_max("_c"))
    enough = F.count("ic") >= window
    acs = [F.when(F.count("ic") >= 10, safe_corr("ic", f"_l{k}")).alias(f"autocorr_{k}") for k in range(1, 6)]
    return d.agg(F.when(enough, F.avg("_s")).alias("mean_rolling_std"), F.when(enough, F.min(F.try_divide(F.col("_c") - F.col("_p"), "_p"))).alias("max_ic_drawdown"), *acs)


def ic_by_factor(panel: DataFrame, names: list[str], ret: str, k: int = 1, min_pairs: int = MIN_PAIRS) -> DataFrame:
    """:func:`ic_summary` of rank correlations for each of several factors, by ``factor``: one pass over the panel."""
    long = aligned(panel.select("date", "symbol", ret, *names), names[0], ret, k).select("date", F.col(ret).cast("double").alias("y"), F.explode(F.array(*(F.struct(F.lit(n).alias("factor"), F.col(n).cast("double").alias("x")) for n in names))).alias("_f"))
    d = long.select("date", "y", "_f.factor", "_f.x").where("x is not null and y is not null")
    d = d.select("date", "factor", avg_rank("x", ["date", "factor"]).alias("x"), avg_rank("y", ["date", "factor"]).alias("y"))
    ics = d.groupBy("date", "factor").agg(safe_corr("x", "y").alias("ic"), F.count("*").alias("n")).where((F.col("n") >= min_pairs) & F.col("ic").isNotNull())
    return ics.groupBy("factor").agg(F.avg("ic").alias("ic_mean"), F.stddev_pop("ic").alias("ic_std"), F.try_divide(F.avg("ic"), F.stddev_pop("ic")).alias("ic_ir"), F.count("ic").alias("n"))


def shape(panel: DataFrame, fields: list[str]) -> DataFrame:
    """For each field: rows, values, dates and symbols, and whether there is a row for every date and symbol."""
    facts = panel.agg(F.count_distinct("date").alias("n_dates"), F.count_distinct("symbol").alias("n_symbols"), F.count("*").alias("n_rows"), F.array(*(F.struct(F.lit(f).alias("field"), F.count(f).alias("n_values")) for f in fields)).alias("_f"))
    d = facts.select("n_dates", "n_symbols", "n_rows", F.explode("_f").alias("_f")).select("_f.field", "n_dates", "n_symbols", "n_rows", "_f.n_values")
    return d.withColumn("complete", (F.col("n_rows") > 0) & (F.col("n_rows") == F.col("n_dates") * F.col("n_symbols")))


def export_results(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write a panel: ``parquet`` and ``csv`` as folders by Spark, ``feather`` as one file (of a result that fits the driver)."""
    if fmt == "parquet":
        df.write.parquet(path)
    elif fmt == "csv":
        df.write.csv(path, header=True)
    elif fmt == "feather":
        from pyarrow import feather

        feather.write_feather(df.toArrow(), path)
    else:
        raise ValueError(f"unknown format {fmt!r}")


def sample_panel(spark: SparkSession, symbols: int = 50, days: int = 262, start: str = "2024-01-01", seed: int = 42) -> DataFrame:
    """A made-up daily panel, the same for the same seed: a return a day from a hash, compounded, and the fields around it."""
    grid = spark.range(symbols).select(F.format_string("S%04d", "id").alias("symbol")).withColumn("_d", F.explode(F.sequence(F.lit(0), F.lit(days - 1))))
    u = lambda k: (F.pmod(F.xxhash64("symbol", "_d", F.lit(seed + k)), F.lit(1_000_003)) / F.lit(1_000_003.0))
    d = grid.withColumn("date", F.date_add(F.lit(start).cast("date"), F.col("_d")).cast("timestamp")).withColumn("_r", (u(0) + u(1) + u(2) - 1.5) * 0.04)
    d = d.withColumn("close", 100 * PANEL.cum_prod(1 + F.col("_r")))
    d = d.withColumns({"open": F.col("close") * (1 + (u(3) - 0.5) * 0.01), "volume": F.floor(1_000_000 * (0.5 + u(4))).cast("double")})
    return d.select("date", "symbol", "open", (F.greatest("open", "close") * (1 + u(5) * 0.01)).alias("high"), (F.least("open", "close") * (1 - u(6) * 0.01)).alias("low"), "close", "volume", (F.col("close") * F.col("volume")).alias("amount"))


def valid_ratio(panel: DataFrame, factor: str) -> DataFrame:
    return panel.agg(F.count(factor).alias("valid"), F.count("*").alias("cells")).withColumn("valid_ratio", F.try_divide("valid", "cells"))
