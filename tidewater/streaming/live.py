"""Structured Streaming over live events and bars.

State is bounded: bars wait for a watermark, repeated bars are known only as long as the watermark allows,
a symbol's indicator state is two numbers per mean, and its history is a buffer of fixed length.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream_bars(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Bars of an event stream ``symbol, ts, value``; a bar comes out once no event of it can come any more."""
    g = events.withWatermark("ts", late).groupBy(F.window("ts", width), "symbol")
    bars = g.agg(F.min_by("value", "ts").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "ts").alias("close"), F.count("*").cast("double").alias("volume"))
    return bars.select("symbol", F.col("window.start").alias("eob"), "open", "high", "low", "close", "volume")


def first_bars(bars: DataFrame, late: str = "1 day") -> DataFrame:
    """Bars without repeats of a symbol, frequency and time; the first that came counts."""
    return bars.withWatermark("eob", late).dropDuplicatesWithinWatermark(["symbol", "frequency", "eob"])


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Events and value of each stretch of activity of a symbol."""
    g = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "symbol")
    return g.agg(F.count("*").alias("n"), F.sum("value").alias("value")).select("symbol", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n", "value")


def ewm_cross(bars: DataFrame, fast: int = 12, slow: int = 26) -> DataFrame:
    """Difference of two exponential means of the close, bar by bar; a symbol's state is a sum and a weight for each.

    Bars of one symbol are taken in the order of their times within a batch.
    """
    keep = [1 - 2 / (fast + 1), 1 - 2 / (slow + 1)]

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        sums = list(state.get) if state.exists else [0.0, 0.0, 0.0, 0.0]
        rows = pd.concat(list(batches)).sort_values("eob")
        out = []
        for at, x in zip(rows["eob"], rows["close"]):
            for i, k in enumerate(keep):
                sums[2 * i], sums[2 * i + 1] = sums[2 * i] * k + x, sums[2 * i + 1] * k + 1
            out.append((key[0], at, x, sums[0] / sums[1] - sums[2] / sums[3]))
        state.update(tuple(sums))
        yield pd.DataFrame(out, columns=["symbol", "eob", "close", "dif"])

    return bars.groupBy("symbol").applyInPandasWithState(step, "symbol string, eob timestamp, close double, dif double", "n1 double, d1 double, n2 double, d2 double", "append", GroupStateTimeout.NoTimeout)


def last_closes(bars: DataFrame, count: int = 100) -> DataFrame:
    """The last ``count`` closes of each symbol after each batch. A bar older than the oldest kept is taken only while the buffer is not full."""

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times, closes = (list(x) for x in state.get) if state.exists else ([], [])
        known = dict(zip(times, closes))
        rows = pd.concat(list(batches)).sort_values("eob")
        for at, x in zip(rows["eob"].astype("int64"), rows["close"]):
            if at not in known and (len(known) < count or at > min(known)):
                known[at] = x
        kept = sorted(known.items())[-count:]
        state.update(([t for t, _ in kept], [x for _, x in kept]))
        yield pd.DataFrame({"symbol": [key[0]], "closes": [[x for _, x in kept]]})

    return bars.groupBy("symbol").applyInPandasWithState(step, "symbol string, closes array<double>", "times array<long>, closes array<double>", "update", GroupStateTimeout.NoTimeout)
