"""Scans over series too long for one task, in two levels.

A series is cut into chunks of its order (units of time, or widths of a number), so that its rows are spread over as many
tasks as it has chunks. What a scan carries is summed up for each chunk; a window over one row a chunk turns the sums into
what each chunk starts with; rows combine that with the scan inside their chunk. Any associative step scans so: sums,
products, extremes, the last known value, exponential means as pairs of a weighted sum and a weight, and, by way of these,
maps between the states of a position (:func:`tidewater.operators.signals.thr_dual`).

Null keys are a key of their own, and rows without an order come first. Rows of one time are taken in any order, as in
windows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.windows import Series


def _either(f):
    """``f`` of two columns, or the one that is not null."""
    return lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(f(a, b))


#: The aggregate of each kind of scan, the one that combines its sums, and the step that joins two of them.
KINDS = {
    "sum": (F.sum, F.sum, _either(lambda a, b: a + b)),
    "count": (F.count, F.sum, _either(lambda a, b: a + b)),
    "product": (F.product, F.product, _either(lambda a, b: a * b)),
    "max": (F.max, F.max, lambda a, b: F.greatest(a, b)),
    "min": (F.min, F.min, lambda a, b: F.least(a, b)),
}


def chunked(df: DataFrame, s: Series, unit: str | float) -> DataFrame:
    """Add ``_s``, the series, and ``_g``, the series and the chunk of its order."""
    order = s.order[0]
    timed = dict(df.dtypes)[order].startswith(("timestamp", "date"))
    chunk = F.date_trunc(unit, F.col(order)) if timed else F.floor(F.col(order) / unit)
    return df.withColumns({"_s": F.struct(*s.by), "_g": F.struct(*s.by, chunk.alias("_chunk"))})


def running(df: DataFrame, s: Series, outs: dict[str, tuple[str, Column]], unit: str | float = "month") -> DataFrame:
    """Add a running value for each of ``outs`` (name to kind and column): ``sum``, ``count``, ``product``, ``max``, ``min`` or ``last``.

    All kinds skip nulls; ``last`` is the last value that is not null.
    """
    names = [f"_x{i}" for i in range(len(outs))]
    kinds = [k for k, _ in outs.values()]
    d = chunked(df, s, unit).withColumns({n: c for n, (_, c) in zip(names, outs.values())})
    at = F.struct(*s.order)
    totals = d.groupBy("_g").agg(F.first("_s").alias("_s"), *((F.max_by(n, F.when(F.col(n).isNotNull(), at)) if k == "last" else KINDS[k][0](n)).alias(n) for n, k in zip(names, kinds)))
    before = Window.partitionBy("_s").orderBy(F.col("_g._chunk").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)  # a row for each chunk
    carried = totals.select("_g", *((F.last(n, True) if k == "last" else KINDS[k][1](n)).over(before).alias(f"_c{n}") for n, k in zip(names, kinds)))
    w = Window.partitionBy("_g").orderBy(*s.order).rowsBetween(Window.unboundedPreceding, 0)
    local = d.withColumns({f"_l{n}": (F.last(n, True) if k == "last" else KINDS[k][0](n)).over(w) for n, k in zip(names, kinds)}).join(carried, "_g")
    both = {out: F.coalesce(f"_l{n}", f"_c{n}") if k == "last" else KINDS[k][2](F.col(f"_c{n}"), F.col(f"_l{n}")) for out, n, k in zip(outs, names, kinds)}
    return local.withColumns(both).drop("_s", "_g", *names, *(f"_{k}{n}" for k in "cl" for n in names))


def ewm(df: DataFrame, s: Series, outs: dict[str, tuple[Column, float]], unit: str | float = "month", eps: float = 1e-16) -> DataFrame:
    """Add exponentially weighted means with finite-history weights (name to column without nulls, and what a step keeps of a weight).

    Inside a chunk, rows are numbered and taken in blocks so short that the oldest weight does not underflow; there the
    weighted sum is one running sum of scaled values. A block's sum and its number of rows are all that is carried.
    """
    keeps = {n: k for n, (_, k) in outs.items() if k > 0}
    d = df.withColumns({n: c.cast("double") for n, (c, k) in outs.items() if k <= 0})
    if not keeps:
        return d
    size = max(1, math.floor(500 / -math.log(min(keeps.values()))))
    reach = {n: max(1, math.ceil(math.log(eps) / math.log(k))) for n, k in keeps.items()}
    names = {n: f"_x{i}" for i, n in enumerate(keeps)}
    d = chunked(d, s, unit).withColumn("_i", F.row_number().over(Window.partitionBy("_g").orderBy(*s.order)) - 1)
    d = d.withColumns({"_b": F.floor(F.col("_i") / size), "_j": (F.col("_i") % size).cast("double")})
    inside = Window.partitionBy("_g", "_b").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    power = lambda k, e: F.pow(F.lit(k), e)
    d = d.withColumns({x: power(keeps[n], F.col("_j")) * F.sum(outs[n][0].cast("double") * power(1 / keeps[n], F.col("_j"))).over(inside) for n, x in names.items()})
    blocks = d.groupBy("_g", "_b").agg(F.first("_s").alias("_s"), F.count("*").alias("_m"), *(F.max_by(x, "_i").alias(x) for x in names.values()))
    up = Window.partitionBy("_s").orderBy(F.col("_g._chunk").asc_nulls_first(), "_b")  # a row for each block

    def sum_before(n: str, x: str) -> Column:
        told = F.collect_list(F.struct(F.col(x).alias("n"), F.col("_m").cast("double").alias("m"))).over(up.rowsBetween(-reach[n], -1))
        return F.aggregate(told, F.lit(0.0), lambda a, b: a * power(keeps[n], b["m"]) + b["n"])

    rows_before = F.coalesce(F.sum("_m").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("double")
    carried = blocks.select("_g", "_b", rows_before.alias("_r"), *(sum_before(n, x).alias(f"_c{x}") for n, x in names.items()))
    d = d.join(carried, ["_g", "_b"])
    place = F.col("_j") + 1
    for n, x in names.items():
        k = keeps[n]
        weight = (1 - power(k, F.col("_r") + place)) / (1 - k)
        d = d.withColumn(n, (F.col(f"_c{x}") * power(k, place) + F.col(x)) / weight)
    return d.drop("_s", "_g", "_b", "_i", "_j", "_r", *names.values(), *(f"_c{x}" for x in names.values()))


def keep_of(span: float | None = None, com: float | None = None) -> float:
    """What an exponential mean keeps of a weight from row to row, by its span or its centre of mass."""
    return 1.0 - (2.0 / (span + 1) if span is not None else 1.0 / (1 + com))
