"""Reading and merging bars, and the adapters that give the test tables the shape of market data."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _money(x: str) -> Column:
    """Summed as decimals, so that the sum does not depend on the order."""
    return F.sum(F.col(x).cast("decimal(18,2)")).cast("double")


def load_bars(df: DataFrame, symbol: str, frequency: str) -> DataFrame:
    """Bars stamped with symbol and frequency; those without a time are dropped."""
    return df.where(F.col("eob").isNotNull()).withColumns({"symbol": F.lit(symbol), "frequency": F.lit(frequency)})


def merge_bars(loads: DataFrame, seq: str, fields: list[str]) -> DataFrame:
    """One bar for each symbol, frequency and time: of each field, the value of the latest load that carries it."""
    last = [F.max_by(f, F.when(F.col(f).isNotNull(), F.col(seq))).alias(f) for f in fields]
    return loads.where(F.col("eob").isNotNull()).groupBy("symbol", "frequency", "eob").agg(*last)


def first_bars(bars: DataFrame, seq: str) -> DataFrame:
    """One bar for each symbol, frequency and time: the first that came, as the replay cache keeps it."""
    rest = [c for c in bars.columns if c not in ("symbol", "frequency", "eob", seq)]
    first = F.min_by(F.struct(*rest), seq).alias("_b")
    return bars.groupBy("symbol", "frequency", "eob").agg(first).select("symbol", "frequency", "eob", *(F.col(f"_b.{c}").alias(c) for c in rest))


def backfill(live: DataFrame, history: DataFrame, count: int | None = None) -> DataFrame:
    """Live bars, with the history of each symbol and frequency that is older than its earliest live bar.

    With ``count``, a series that has fewer live bars gets as many older ones as it lacks, and one more; others get none.
    """
    facts = live.groupBy("symbol", "frequency").agg(F.min("eob").alias("_earliest"), F.count("*").alias("_n"))
    older = history.join(facts, ["symbol", "frequency"]).where(F.col("eob") < F.col("_earliest"))
    if count is not None:
        place = F.row_number().over(Window.partitionBy("symbol", "frequency").orderBy(F.desc("eob")))
        older = older.where(F.col("_n") < count).withColumn("_k", place).where(F.col("_k") <= count - F.col("_n") + 1)
    return live.unionByName(older.select(live.columns))


def at_close(bars: DataFrame, now: str | None = None) -> DataFrame:
    """Daily bars stamped one second after the close of their day (15:00:01), and none that lie after ``now``."""
    stamp = F.date_trunc("day", "eob") + F.expr("interval '15:00:01' hour to second")
    d = bars.withColumn("eob", F.when(F.col("frequency") == "1d", stamp).otherwise(F.col("eob")))
    return d.where(F.col("eob") <= F.lit(now).cast("timestamp")) if now else d


class Subscriptions:
    """Which bars are wanted: fields and depth by symbol and frequency."""

    def __init__(self, depth: int = 100):
        self.depth = depth
        self.params: dict[tuple[str, str], tuple[list[str] | None, int]] = {}

    def subscribe(self, symbols: str | list[str], frequency: str, fields: list[str] | None = None, count: int | None = None) -> None:
        for s in symbols.split(",") if isinstance(symbols, str) else symbols:
            self.params[s.strip(), frequency] = (fields, count or self.depth)

    def unsubscribe(self, symbols: str | list[str], frequency: str) -> None:
        for s in symbols.split(",") if isinstance(symbols, str) else symbols:
            self.params.pop((s.strip(), frequency), None)

    def apply(self, bars: DataFrame) -> DataFrame:
        """The last bars of every subscription; fields that one did not ask for are null."""
        keys = ["symbol", "frequency", "eob"]
        if not self.params:
            return bars.limit(0)
        rows = [(s, f, n, fields) for (s, f), (fields, n) in self.params.items()]
        wanted = bars.sparkSession.createDataFrame(rows, "symbol string, frequency string, _count int, _fields array<string>")
        d = bars.join(F.broadcast(wanted), ["symbol", "frequency"])  # a row for each subscription
        d = d.withColumn("_n", F.row_number().over(Window.partitionBy("symbol", "frequency").orderBy(F.desc("eob")))).where("_n <= _count")
        asked = lambda c: F.col("_fields").isNull() | F.array_contains("_fields", c)
        return d.select(*keys, *(F.when(asked(c), F.col(c)).alias(c) for c in bars.columns if c not in keys))


def last_n(bars: DataFrame, n: int, fields: list[str] | None = None) -> DataFrame:
    """The last ``n`` bars (at least one) of each symbol and frequency."""
    w = Window.partitionBy("symbol", "frequency").orderBy(F.desc("eob"))
    kept = bars.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= max(1, n)).drop("_n")
    return kept.select("symbol", "frequency", "eob", *[f for f in fields if f not in ("symbol", "frequency", "eob")]) if fields else kept


def complete_field(panel: DataFrame, dates: DataFrame, symbols: DataFrame, field: str) -> DataFrame:
    """A field for every requested date and symbol; all null unless the panel has every requested date and every requested symbol.

    ``dates`` and ``symbols`` are distinct requests; their grid is the result itself.
    """
    have_d, have_s = panel.select("date").distinct(), panel.select("symbol").distinct()
    lacking = dates.join(have_d, "date", "left_anti").select(F.lit(1).alias("x")).unionByName(symbols.join(have_s, "symbol", "left_anti").select(F.lit(1).alias("x"))).agg(F.count("*").alias("_lacking"))
    grid = dates.crossJoin(symbols).join(panel.select("date", "symbol", field), ["date", "symbol"], "left")
    return grid.crossJoin(F.broadcast(lacking)).select("date", "symbol", F.when(F.col("_lacking") == 0, F.col(field)).alias(field))  # one row


def event_bars(spark: SparkSession, sf_dir: str, unit: str = "hour") -> DataFrame:
    """Bars of ``events``: symbol is the event type."""
    e = read(spark, sf_dir, "events")
    names = {"hour": "60m", "day": "1d", "minute": "1m"}
    return e.groupBy(F.col("event_type").alias("symbol"), F.lit(names[unit]).alias("frequency"), F.date_trunc(unit, "ts").alias("eob")).agg(
        F.min_by("value", "ts").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "ts").alias("close"), F.count("*").cast("double").alias("volume"), _money("value").alias("amount")
    )


def supplier_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A monthly panel of ``lineitem``: symbol is the supplier."""
    x = F.col("l_extendedprice") / F.col("l_quantity")
    li = read(spark, sf_dir, "lineitem")
    return li.groupBy(F.date_trunc("month", "l_shipdate").alias("date"), F.col("l_suppkey").alias("symbol")).agg(
        (_money("l_extendedprice") / F.sum("l_quantity")).alias("close"), F.max(x).alias("high"), F.min(x).alias("low"), F.sum("l_quantity").alias("volume"), _money("l_extendedprice").alias("amount")
    )


def order_nav(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily assets of ``orders``."""
    return read(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(_money("o_totalprice").alias("assets"))


def ship_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily closes of ``lineitem``."""
    return read(spark, sf_dir, "lineitem").groupBy(F.to_date("l_shipdate").alias("date")).agg((_money("l_extendedprice") / F.sum("l_quantity")).alias("close"))


def event_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades of ``events``: symbol is the user; side 1 buys and 2 sells."""
    lots = (F.lit(1) + F.col("event_id") % 5) * 100
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), F.col("ts").alias("created_at"), F.col("user_id").alias("symbol"), F.col("value").alias("price"), lots.cast("double").alias("volume"),
        F.when(F.col("event_type").isin("purchase", "view", "signup"), 1).otherwise(2).alias("side"),
        F.greatest(F.round(F.col("value").cast("decimal(18,2)") * lots.cast("int") * F.lit(Decimal("0.0003")), 2).cast("double"), F.lit(5.0)).alias("fee"),
    )
