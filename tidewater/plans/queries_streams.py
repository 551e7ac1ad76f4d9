"""Queries that replay a table's files as a stream, by keyed state, and give what the stream gave."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.plans.catalog import query
from tidewater.sources import bars
from tidewater.streaming import replay

#: Depth of the histories, and the day from which bars are live; older ones fill them in on the left.
DEPTH, LIVE = 660, "2024-01-03 00:00:00"


def _hourly(spark, d, *more: Column) -> DataFrame:
    e = replay.file_stream(spark, d, "events")
    return e.select(F.col("event_type").alias("symbol"), F.lit("60m").alias("frequency"), F.date_trunc("hour", "ts").alias("eob"), F.col("event_id").alias("seq"), F.col("value").alias("close"), *more)


@query("stream_timer_bars", "WITH {bars} SELECT symbol, frequency, eob, open, high, low, close, volume FROM bars WHERE eob + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE")
def stream_timer_bars(spark, d):
    """Hourly bars of a stream, each closed by a timer; those that the watermark has not passed stay open."""
    ticks = replay.file_stream(spark, d, "events").select(F.col("event_type").alias("symbol"), "ts", "value")
    return replay.result(spark, replay.run(replay.bars_by_timer(ticks))).drop("batch_id")


@query("stream_first_bars", "SELECT event_type AS symbol, '60m' AS frequency, date_trunc('hour', ts) AS eob, min(event_id) AS seq, arg_min(value, event_id) AS close FROM events GROUP BY ALL")
def stream_first_bars(spark, d):
    """The first bar that came for each hour of a symbol; a day after it came it is forgotten."""
    run = replay.run(replay.first_by_state(_hourly(spark, d), ttl_ms=86_400_000), idle_batches=False)
    return replay.result(spark, run).drop("batch_id")


_HISTORY = f"""WITH e AS (SELECT event_type AS symbol, date_trunc('hour', ts) AS eob, event_id AS seq, value AS close, event_id % 3 = 0 AS bare FROM events),
f AS (SELECT symbol, eob, min(seq) AS seq, arg_min(close, seq) AS close, arg_min(bare, seq) AS bare FROM e WHERE eob >= TIMESTAMP '{LIVE}' GROUP BY symbol, eob),
n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY eob DESC) AS k, count(*) OVER (PARTITION BY symbol) AS live FROM f),
o AS (SELECT e.*, row_number() OVER (PARTITION BY e.symbol ORDER BY e.eob DESC, e.seq) AS k, g.live FROM e JOIN (SELECT symbol, max(live) AS live FROM n GROUP BY symbol) g ON g.symbol = e.symbol WHERE e.eob < TIMESTAMP '{LIVE}'),
u AS (SELECT symbol, eob, seq, close, bare, 1 AS side, -seq AS tie FROM n WHERE k <= {DEPTH} UNION ALL SELECT symbol, eob, seq, close, bare, 0, -seq FROM o WHERE k <= greatest({DEPTH} - live, 0))
SELECT symbol, '60m' AS frequency, CAST(row_number() OVER (PARTITION BY symbol ORDER BY side, eob, tie) - 1 AS INT) AS place, eob, close, CASE WHEN NOT bare THEN close - 0.5 END AS bid_p, CASE WHEN NOT bare THEN 100.0::DOUBLE END AS bid_v,
  CASE WHEN NOT bare THEN close + 0.5 END AS ask_p, CASE WHEN NOT bare THEN 200.0::DOUBLE END AS ask_v FROM u"""


@query("stream_history", _HISTORY)
def stream_history(spark, d):
    """What a subscription holds at the end of a stream of bars with quotes, filled in on the left; every third bar has no quotes."""
    level = lambda step, size: F.struct((F.col("value") - step).alias("bid_p"), F.lit(size).alias("bid_v"), (F.col("value") + step).alias("ask_p"), F.lit(2 * size).alias("ask_v"))
    quotes = F.when(F.col("event_id") % 3 != 0, F.array(level(0.5, 100.0), level(1.5, 300.0))).alias("quotes")
    left = (F.date_trunc("hour", "ts") < F.lit(LIVE).cast("timestamp")).alias("left")
    held = replay.latest(replay.result(spark, replay.run(replay.histories(_hourly(spark, d, quotes, left), DEPTH))), ["symbol", "frequency"])
    return replay.as_rows(held)
