"""As-of joins: the latest right row at or before each left row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, fields: list[str], keep_time: str | None = None, bucket: str = "month", each: bool = False) -> DataFrame:
    """``left`` with ``fields`` of the latest ``right`` row of the same keys whose time is not later, null where there is none.

    With ``each``, every field comes from the latest row in which it is not null. Both sides are laid in one time
    order within buckets of time (``bucket``, a unit of ``date_trunc``), and what a bucket starts with is carried
    over from the buckets before it by a window over one row for each bucket. So no pair of rows is ever formed,
    and a key with very many rows is spread over as many tasks as it has buckets. Of right rows of equal time one
    is taken.
    """
    l_cols = left.columns
    names = [f"_f{i}" for i in range(len(fields) + bool(keep_time))]
    values = [F.col(f) for f in fields] + [F.col(right_time)] * bool(keep_time)
    groups = [F.struct(*(v.alias(n) for n, v in zip(names, values)))] if not each else values
    parts = [f"_r{i}" for i in range(len(groups))]
    at = lambda c: F.date_trunc(bucket, F.col(c)).alias("_b")
    a = left.select(*by, F.col(left_time).cast("timestamp").alias("_at"), at(left_time), F.lit(1).alias("_side"), F.struct(*l_cols).alias("_l"))
    b = right.where(F.col(right_time).isNotNull()).select(*by, F.col(right_time).cast("timestamp").alias("_at"), at(right_time), F.lit(0).alias("_side"), *(g.alias(p) for g, p in zip(groups, parts)))

    def known(p: str) -> Column:
        return F.col(p).isNotNull()

    ends = b.groupBy(*by, "_b").agg(*(F.max_by(p, F.when(known(p), F.col("_at"))).alias(p) for p in parts))
    every = ends.unionByName(a.select(*by, "_b").distinct(), allowMissingColumns=True).groupBy(*by, "_b").agg(*(F.first(p, ignorenulls=True).alias(p) for p in parts))
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # a row for each bucket
    carried = every.select(*by, "_b", *(F.last(p, ignorenulls=True).over(before).alias(p) for p in parts)).withColumns({"_at": F.col("_b"), "_side": F.lit(-1)})
    w = Window.partitionBy(*by, "_b").orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    rows = a.unionByName(b, allowMissingColumns=True).unionByName(carried, allowMissingColumns=True)
    out = rows.withColumns({p: F.last(p, ignorenulls=True).over(w) for p in parts}).where("_side = 1")
    got = [F.col(f"_r0.{n}") if not each else F.col(p) for n, p in zip(names, parts if each else names)]
    return out.select(*(F.col(f"_l.{c}").alias(c) for c in l_cols), *(g.alias(n) for g, n in zip(got, [*fields, *([keep_time] if keep_time else [])])))


# The frequencies that prices are looked up in, finest first.
FREQUENCIES = ("1m", "60s", "5m", "300s", "15m", "900s", "30m", "1800s", "60m", "3600s", "1d")


def latest_price(requests: DataFrame, bars: DataFrame, frequencies: tuple[str, ...] = FREQUENCIES, price: str = "close") -> DataFrame:
    """Requests ``(symbol, at)`` with the price known then; all frequencies in one pass.

    Frequencies are asked from the finest on. In each the latest bar at or before the time decides: a price that is null or
    not positive there sends the request to the next frequency, and not to an older bar. Of bars of one time the largest
    price counts.
    """
    names = [f"_p{i}" for i in range(len(frequencies))]
    some = bars.where(F.col("frequency").isin(*frequencies)).groupBy("symbol", "eob")
    # A bar without a price is a bar: it is kept as a structure that is not null.
    wide = some.agg(*(F.max(F.when(F.col("frequency") == f, F.struct(F.col(price).alias("x")))).alias(n) for n, f in zip(names, frequencies)))
    out = asof_join(requests, wide, ["symbol"], "at", "eob", names, bucket="day", each=True)
    return out.withColumn("price", F.coalesce(*(F.when(F.col(f"{n}.x") > 0, F.col(f"{n}.x")) for n in names))).drop(*names)


def snapshot_at(snapshots: DataFrame, at: str, value: str = "nav", by: list[str] | None = None) -> DataFrame:
    """The latest snapshot's value at or before a time."""
    last = [F.max_by(value, "created_at").alias(value), F.max("created_at").alias("created_at")]
    d = snapshots.where(F.col("created_at") <= F.lit(at).cast("timestamp"))
    return d.groupBy(*by).agg(*last) if by else d.agg(*last)
