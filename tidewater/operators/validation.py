"""All validations of a factor in turn. Each is a small aggregate of the panel; what goes wrong in one is kept beside the others."""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.functions.stats import array_corr, array_ranks, p_value, safe_corr, t_p_value
from tidewater.functions.windows import Series, quantile_bucket
from tidewater.operators import factors

#: Below this share of values a factor is called sparse.
LEAST_VALID = 0.7

#: Name -> (order, what it is, function of panel, factor, return, distance and buckets that gives one row of numbers).
CHECKS: dict[str, tuple[int, str, Callable[..., DataFrame]]] = {}


def check(name: str, order: int = 99, about: str = "") -> Callable:
    """Decorator: register a validation."""

    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        CHECKS[name] = (order, about, f)
        return f

    return add


def _ics(panel: DataFrame, factor: str, ret: str, k: int) -> DataFrame:
    return factors.ic_by_date(factors.aligned(panel, factor, ret, k), factor, ret)


@check("validity", 1, "share of dates and symbols that have a value")
def _validity(panel, factor, ret, k, q):
    return factors.valid_ratio(panel, factor).withColumn("sparse", (F.col("valid_ratio") < LEAST_VALID).cast("int"))


@check("information_coefficient", 2, "rank correlation with returns, date by date")
def _ic(panel, factor, ret, k, q):
    return factors.ic_summary(_ics(panel, factor, ret, k))


@check("ic_decay", 3, "how fast the correlation falls with the distance")
def _decay(panel, factor, ret, k, q):
    return factors.half_life(factors.ic_decay(panel, factor, ret))


@check("group_returns", 4, "mean returns of the buckets")
def _groups(panel, factor, ret, k, q):
    return factors.monotonicity(factors.group_returns(panel, factor, ret, q, k))


@check("turnover", 5, "share of symbols that change their bucket")
def _turnover(panel, factor, ret, k, q):
    return factors.turnover(panel, factor, q, k).agg(*(F.avg(c).alias(c) for c in ("turnover", "top", "bottom")))


@check("hit_rate", 6, "share of pairs on the same side of the medians")
def _hits(panel, factor, ret, k, q):
    return factors.hit_rate(panel, factor, ret, k)


@check("stability", 7, "how steady the correlation is")
def _stability(panel, factor, ret, k, q):
    return factors.stability(_ics(panel, factor, ret, k))


def run_all(panel: DataFrame, factor: str, ret: str, k: int = 1, q: int = 10, names: list[str] | None = None) -> dict[str, dict]:
    """Results by validation, in order: ``order, about, value`` (numbers by name, null where undefined), and ``error`` where one failed.

    Nothing is run on a panel in which the factor has no value at all. Each result is one row.
    """
    if panel.where(F.col(factor).isNotNull()).isEmpty():
        return {}
    out: dict[str, dict] = {}
    for name, (order, about, make) in sorted(CHECKS.items(), key=lambda x: (x[1][0], x[0])):
        if names and name not in names:
            continue
        entry = {"order": order, "about": about, "value": None}
        try:
            row = make(panel, factor, ret, k, q).first()
            entry["value"] = {n: None if v is None else float(v) for n, v in row.asDict().items()}
            if name == "information_coefficient" and entry["value"]["t_stat"] is not None:
                entry["value"]["p_value"] = t_p_value(entry["value"]["t_stat"], int(entry["value"]["n"]))
        except Exception as e:  # noqa: BLE001  kept beside the others' results
            entry["error"] = str(e)
        out[name] = entry
    return out


def validation_plan(panel: DataFrame, factor: str, ret: str, k: int = 1, q: int = 10, max_k: int = 20, window: int = 60, min_pairs: int = factors.MIN_PAIRS) -> DataFrame:
    """All of the validations above as rows ``place, validation, name, value``: one plan, and nothing runs while it is made.

    The panel is bucketed and ranked once, by date; one aggregate by date holds what all checks need of it, one row each;
    windows and one more aggregate over these few rows give every result.
    """
    k = max(1, k)
    day = Window.partitionBy("date")
    x, y = F.col("_x"), F.col("_y")
    d = factors.dated(panel.select("date", "symbol", F.col(factor).cast("double").alias("_x"), F.col(ret).cast("double").alias("_y")))
    d = d.withColumn("_b", quantile_bucket("_x", "symbol", ["date"], q)).withColumn("_pair", x.isNotNull() & y.isNotNull())
    # Ranks among the pairs of a date; a pair's own side of the medians; the bucket k dates before.
    pairs = Window.partitionBy("date", "_pair")
    shared = lambda c: F.count(F.lit(1)).over(Window.partitionBy("date", "_pair", c))
    rank = lambda c: F.when(F.col("_pair"), F.rank().over(pairs.orderBy(c)) + (shared(c) - 1) / F.lit(2.0))
    half = lambda c: F.percentile(F.when(F.col("_pair"), F.col(c)), F.lit(0.5)).over(day)
    d = d.withColumns({"_rx": rank("_x"), "_ry": rank("_y"), "_hit": F.when(F.col("_pair"), ((x > half("_x")) == (y > half("_y"))).cast("long"))})
    d = d.withColumn("_was", F.max("_b").over(Window.partitionBy("symbol").orderBy("date_idx").rangeBetween(-k, -k)))
    moved = F.when(F.col("_b").isNotNull() & F.col("_was").isNotNull(), (F.col("_b") != F.col("_was")).cast("double"))
    days = d.groupBy("date", "date_idx", "n_dates").agg(
        F.count("_x").alias("valid"), F.count("*").alias("cells"), F.count("_rx").alias("pairs"), safe_corr("_rx", "_ry").alias("ic"), F.sum("_hit").alias("hits"),
        F.avg(moved).alias("turnover"), F.avg(F.when(F.col("_was") == q, moved)).alias("top"), F.avg(F.when(F.col("_was") == 1, moved)).alias("bottom"),
        *(F.avg(F.when(F.col("_b") == b, y)).alias(f"g{b}") for b in range(1, q + 1)),
    )

    inside = F.col("date_idx").between(F.lit(k), F.col("n_dates") - 1 - k)
    known = F.when(F.col("pairs") >= min_pairs, F.col("ic"))
    days = days.withColumns({"_in": inside, "ic": known, "_ok": inside & known.isNotNull()})
    s = Series("_ok", "date")  # one row a date
    days = days.withColumns({"_s": s.std("ic", window), "_c": s.cum_prod(1 + F.col("ic")), **{f"_l{j}": s.lag("ic", j) for j in range(1, 6)}})
    days = days.withColumn("_fall", F.try_divide(F.col("_c") - s.cum_max("_c"), s.cum_max("_c")))

    of = lambda c: F.when(F.col("_ok"), F.col(c))
    ic, n = of("ic"), F.count(of("ic"))
    at = lambda j: F.when(F.lit(j) <= F.floor(F.col("n_dates") / 2) - 1, F.when(F.col("date_idx").between(F.lit(j), F.col("n_dates") - 1 - j), F.col("ic")))
    enough = F.col("pairs") >= min_pairs
    one = days.agg(
        F.sum("valid").alias("valid"), F.sum("cells").alias("cells"), F.avg(ic).alias("ic_mean"), F.stddev_pop(ic).alias("ic_std"), F.stddev_samp(ic).alias("_sd"), F.avg(F.when(F.col("_ok"), (F.col("ic") > 0).cast("double"))).alias("positive_ratio"), n.alias("n"),
        F.sum(F.when(F.col("_in") & enough, F.col("hits"))).alias("hits"), F.sum(F.when(F.col("_in") & enough, F.col("pairs"))).alias("_hn"),
        F.avg("turnover").alias("turnover"), F.avg("top").alias("top"), F.avg("bottom").alias("bottom"),
        F.when(n >= window, F.avg(of("_s"))).alias("mean_rolling_std"), F.when(n >= window, F.min(of("_fall"))).alias("max_ic_drawdown"),
        *(F.when(n >= 10, safe_corr(ic, of(f"_l{j}"))).alias(f"autocorr_{j}") for j in range(1, 6)),
        F.array(*(F.struct(F.lit(float(j)).alias("k"), F.avg(at(j)).alias("m")) for j in range(1, max_k + 1))).alias("_decay"),
        F.array(*(F.struct(F.lit(float(b)).alias("b"), F.avg(F.when(F.col("_in"), F.col(f"g{b}"))).alias("m")) for b in range(1, q + 1))).alias("_groups"),
    )

    # The fit of the decay and the order of the buckets, on arrays of a few numbers.
    one = one.withColumns({"_decay": F.filter("_decay", lambda p: F.abs(p["m"]) > 0), "_groups": F.filter("_groups", lambda p: p["m"].isNotNull())})
    ks, ls = F.transform("_decay", lambda p: p["k"]), F.transform("_decay", lambda p: F.ln(F.abs(p["m"])))
    mean = lambda c: F.try_divide(F.aggregate(c, F.lit(0.0), lambda a, v: a + v), F.size(c))
    slope = F.try_divide(F.aggregate(F.zip_with(ks, ls, lambda a, b: (a - mean(ks)) * (b - mean(ls))), F.lit(0.0), lambda a, v: a + v), F.aggregate(F.transform(ks, lambda a: (a - mean(ks)) * (a - mean(ks))), F.lit(0.0), lambda a, v: a + v))
    means = F.transform("_groups", lambda p: p["m"])
    one = one.withColumn("decay_rate", F.when(F.size(ks) >= 3, -slope))
    t = F.try_divide(F.col("ic_mean"), F.col("_sd") / F.sqrt("n"))
    results = {
        "validity": {"valid": F.col("valid"), "cells": F.col("cells"), "valid_ratio": F.try_divide("valid", "cells"), "sparse": F.try_divide("valid", "cells") < LEAST_VALID},
        "information_coefficient": {**{c: F.col(c) for c in ("ic_mean", "ic_std", "positive_ratio", "n")}, "ic_ir": F.try_divide("ic_mean", "ic_std"), "t_stat": t, "p_value": p_value(t, F.col("n"))},
        "ic_decay": {"decay_rate": F.col("decay_rate"), "half_life": F.when(F.col("decay_rate") > 0, math.log(2.0) / F.col("decay_rate")).when(F.col("decay_rate").isNotNull(), float("inf"))},
        "group_returns": {"spread": F.when(F.size("_groups") > 0, F.element_at(means, -1) - F.element_at(means, 1)), "monotonicity": F.when(F.size("_groups") >= 3, F.abs(array_corr(F.transform("_groups", lambda p: p["b"]), array_ranks(means))))},
        "turnover": {c: F.col(c) for c in ("turnover", "top", "bottom")},
        "hit_rate": {"hits": F.col("hits"), "n": F.col("_hn"), "hit_rate": F.try_divide("hits", "_hn")},
        "stability": {c: F.col(c) for c in ("mean_rolling_std", "max_ic_drawdown", *(f"autocorr_{j}" for j in range(1, 6)))},
    }
    rows = [F.struct(F.lit(CHECKS[v][0]).alias("place"), F.lit(v).alias("validation"), F.lit(name).alias("name"), c.cast("double").alias("value")) for v, named in results.items() for name, c in named.items()]
    return one.select(F.explode(F.array(*rows)).alias("_r")).select("_r.*")


def result_rows(spark: SparkSession, results: dict[str, dict]) -> DataFrame:
    """Results as rows ``place, validation, name, value, error``."""
    rows = []
    for name, r in results.items():
        for k, v in (r["value"] or {None: None}).items():
            rows.append((r["order"], name, k, v, r.get("error")))
    return spark.createDataFrame(rows, "place int, validation string, name string, value double, error string")


def write_report(results: dict[str, dict], path: str) -> None:
    """The results that did not fail, as a JSON file."""
    Path(path).write_text(json.dumps({k: v for k, v in results.items() if "error" not in v}, ensure_ascii=False, indent=1, allow_nan=True))
