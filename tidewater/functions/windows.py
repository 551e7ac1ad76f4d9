"""Rolling, weighted and cumulative functions over ordered series.

All rolling windows are counted in rows, trail, and are null until they hold ``n`` observations that are not
null. Functions of one :class:`Series` share its partitioning and order, hence one shuffle and one sort.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


class Series:
    """Rows of the same keys, in an order."""

    def __init__(self, by: list[str] | str, order: list[str] | str):
        self.by = [by] if isinstance(by, str) else by
        self.order = [order] if isinstance(order, str) else order

    @property
    def spec(self) -> WindowSpec:
        return Window.partitionBy(*self.by).orderBy(*self.order)

    @property
    def whole(self) -> WindowSpec:
        return Window.partitionBy(*self.by)

    @property
    def so_far(self) -> WindowSpec:
        return self.spec.rowsBetween(Window.unboundedPreceding, 0)

    def last(self, n: int) -> WindowSpec:
        return self.spec.rowsBetween(-(n - 1), 0)

    def roll(self, agg: Callable[[Column], Column], x: Column | str, n: int) -> Column:
        x = _c(x)
        return F.when(F.count(x).over(self.last(n)) == n, agg(x).over(self.last(n)))

    def mean(self, x: Column | str, n: int) -> Column:
        return self.roll(F.avg, x, n)

    def std(self, x: Column | str, n: int) -> Column:
        """Sample standard deviation."""
        return self.roll(F.stddev_samp, x, n)

    def min(self, x: Column | str, n: int) -> Column:
        return self.roll(F.min, x, n)

    def max(self, x: Column | str, n: int) -> Column:
        return self.roll(F.max, x, n)

    def lag(self, x: Column | str, n: int = 1) -> Column:
        return F.lag(_c(x), n).over(self.spec)

    def lead(self, x: Column | str, n: int = 1) -> Column:
        return F.lead(_c(x), n).over(self.spec)

    def diff(self, x: Column | str, n: int = 1) -> Column:
        return _c(x) - self.lag(x, n)

    def pct_change(self, x: Column | str, n: int = 1) -> Column:
        return F.try_divide(_c(x), self.lag(x, n)) - 1

    def ffill(self, x: Column | str) -> Column:
        return F.last(_c(x), ignorenulls=True).over(self.so_far)

    def cum_max(self, x: Column | str) -> Column:
        return F.max(_c(x)).over(self.so_far)

    def cum_prod(self, x: Column | str) -> Column:
        return F.product(_c(x)).over(self.so_far)

    def last_rows(self, fields: list[str], n: int) -> Column:
        """The last ``n`` rows up to this one, oldest first, as an array of structs."""
        return F.collect_list(F.struct(*fields)).over(self.last(n))

    def ewm(self, x: Column | str, span: float | None = None, com: float | None = None, eps: float = 1e-16) -> Column:
        """Exponentially weighted mean with finite-history weights; ``x`` must have no nulls.

        The frame is cut where a weight falls below ``eps`` of the newest, so state does not grow with the series.
        """
        a = 2.0 / (span + 1) if span is not None else 1.0 / (1 + com)
        rows = 1 if a >= 1 else max(1, math.ceil(math.log(eps) / math.log(1 - a)))
        keep = F.lit(1.0 - a)
        zero = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("d"))
        return F.aggregate(
            F.collect_list(_c(x).cast("double")).over(self.last(rows)),
            zero,
            lambda s, v: F.struct((s["n"] * keep + v).alias("n"), (s["d"] * keep + 1.0).alias("d")),
            lambda s: F.try_divide(s["n"], s["d"]),
        )


def avg_rank(x: str, by: list[str]) -> Column:
    """Ascending rank among rows of the same keys, ties sharing the mean of their places."""
    return F.rank().over(Window.partitionBy(*by).orderBy(x)) + (F.count(F.lit(1)).over(Window.partitionBy(*by, x)) - 1) / F.lit(2.0)


def quantile_bucket(x: str, tie: str, by: list[str], q: int) -> Column:
    """Equal-frequency bucket 1..q of ``x`` among rows of the same keys, or null where those are fewer than ``q``.

    Edges lie at interpolated ranks, so remainders spread over the buckets; ties are taken in the order of ``tie``.
    """
    m = F.count(x).over(Window.partitionBy(*by))
    r = F.row_number().over(Window.partitionBy(*by).orderBy(F.col(x).asc_nulls_last(), tie))
    return F.when(F.col(x).isNotNull() & (m >= q), F.greatest(F.lit(1), F.ceil(F.lit(q) * (r - 1) / (m - 1)))).cast("int")


def with_overlap(df: DataFrame, by: list[str], order: str, rows: int, chunk: int = 1_000_000) -> DataFrame:
    """Cut very long series into chunks of ``chunk`` rows that each carry the ``rows`` rows before them.

    Adds ``_chunk`` and ``_warm`` (true for carried rows). A trailing window of up to ``rows + 1`` rows may then be
    partitioned by ``(*by, _chunk)``, so that one series is spread over tasks; drop the warm rows afterwards.
    Positions come from bucketed counts, not from one window over a series.
    """
    timed = dict(df.dtypes)[order].startswith(("timestamp", "date"))
    part = F.xxhash64(F.date_trunc("month", F.col(order))) if timed else F.floor(F.col(order) / chunk)
    # Keys as structures, which join where a part of them is null.
    parts = df.withColumns({"_series": F.struct(*by), "_part": F.struct(*by, part.alias("_n"))})
    span = Window.partitionBy("_part").orderBy(order)
    sizes = parts.groupBy("_part").agg(F.first("_series").alias("_series"), F.min(order).alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy("_series").orderBy("_first").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    at = parts.withColumn("_nth", F.row_number().over(span)).join(starts, "_part").withColumn("_at", F.col("_before") + F.col("_nth") - 1)
    own = F.floor(F.col("_at") / chunk)
    also = F.floor((F.col("_at") + rows) / chunk)
    return at.withColumn("_own", own).withColumn("_chunk", F.explode(F.sequence(own, also))).withColumn("_warm", F.col("_chunk") > F.col("_own")).drop("_series", "_part", "_before", "_nth", "_at", "_own")
