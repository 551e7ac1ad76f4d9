"""Replay on live streams by keyed state: bars closed by timers, first bars, and histories in rows and columns.

Each operator is a stateful processor of Structured Streaming. State is keyed by series, kept by the state store (it must be
RocksDB, which :func:`run` sees to), and bounded: open bars by the watermark, known bars by their time to live, histories by
their depth. A stream may be stopped and started again from its checkpoint at any time without another result.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from tempfile import TemporaryFile

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from tidewater.session import ship_package
from tidewater.sources.scratch import scratch_folder

_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Times of a batch that a history remembers to have looked up; beyond that it forgets them and looks again.
_SEEN = 100_000
BAR = "symbol string, frequency string, eob timestamp, open double, high double, low double, close double, volume double"


class TimedBars(StatefulProcessor):
    """Bars of ticks ``symbol, at, value`` (microseconds), open in a map by their start, closed by a timer at their end.

    ``open`` and ``close`` go by time and, at one time, by the smaller and the larger value. A tick that the watermark has
    passed comes too late.
    """

    FIELDS = "first long, open double, high double, low double, last long, close double, volume double"

    def __init__(self, width: int, frequency: str):
        self.width, self.frequency = width, frequency

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "start long", self.FIELDS)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        held: dict[int, tuple] = {}
        for r in rows:
            start = r.at - r.at % self.width
            if (start + self.width) // 1000 <= now:
                continue
            b = held.get(start)
            if b is None:
                b = tuple(self.open.getValue((start,))) if self.open.containsKey((start,)) else None
                if b is None:
                    self.handle.registerTimer((start + self.width) // 1000)
            x, at = r.value, r.at
            if b is None:
                held[start] = (at, x, x, x, at, x, 1.0)
            else:
                first, last = min((b[0], b[1]), (at, x)), max((b[4], b[5]), (at, x))
                held[start] = (*first, max(b[2], x), min(b[3], x), *last, b[6] + 1)
        for start, b in held.items():
            self.open.updateValue((start,), b)
        return iter([])

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        start = expiredTimerInfo.getExpiryTimeInMs() * 1000 - self.width
        if not self.open.containsKey((start,)):
            return
        b = self.open.getValue((start,))
        self.open.removeKey((start,))
        yield Row(symbol=key[0], frequency=self.frequency, eob=start, open=b[1], high=b[2], low=b[3], close=b[5], volume=b[6])

    def close(self) -> None:
        pass


class FirstBars(StatefulProcessor):
    """The first bar that came for each time of a series; a time is known for as long as the state lives."""

    def __init__(self, ttl_ms: int | None):
        self.ttl = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getMapState("known", "eob long", "seq long", self.ttl)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        first: dict[int, Row] = {}
        for r in rows:
            if r.eob not in first or r.seq < first[r.eob].seq:
                first[r.eob] = r
        for eob, r in sorted(first.items()):
            if not self.known.containsKey((eob,)):
                self.known.updateValue((eob,), (r.seq,))
                yield Row(symbol=key[0], frequency=key[1], eob=eob, seq=r.seq, close=r.close)

    def close(self) -> None:
        pass


class History(StatefulProcessor):
    """The last ``depth`` bars of a series as they came; the first that came counts where one comes again.

    Bars come in batches, and within a batch by their times. ``left`` bars (history that is filled in) are taken, newest
    first, only while there is room, and only if they are older than the earliest time the series began with, which stays
    the one it was when a bar came first. Gives what is held after each batch, oldest first: as rows, or as columns in which
    ``bid_p, bid_v, ask_p, ask_v`` are those of the first level of the bar's quotes.

    A batch is never held: of its rows, what memory keeps is bounded by the depth. Bars on the left of a series that begins
    with the batch wait in a file of the task.
    """

    def __init__(self, depth: int):
        self.depth = depth
        self.most = 2 * depth + 1000  # bars kept of a batch before they are cut to ``depth`` again

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.bars = handle.getListState("bars", "eob long, close double, bid_p double, bid_v double, ask_p double, ask_v double")
        self.start = handle.getValueState("earliest", "eob long")
        self.known = handle.getMapState("known", "eob long", "held boolean")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        held = [tuple(b) for b in self.bars.get()] if self.bars.exists() else []
        began = earliest = self.start.get()[0] if self.start.exists() else None
        live: dict[int, tuple] = {}  # by time: order of coming and bar, of the latest times
        seen: set[int] = set()
        with TemporaryFile() as waiting:  # bars on the left of a series whose first batch this is: how early it begins is known at the end
            left: list[tuple] = []
            newest: tuple | None = None
            for r in rows:
                bar = (r.eob, r.close, r.bid_p, r.bid_v, r.ask_p, r.ask_v)
                if r.left:
                    if earliest is None or r.eob < earliest:
                        if began is None:
                            pickle.dump((r.seq, bar), waiting)
                            if newest is None or r.eob > newest[1][0] or (r.eob == newest[1][0] and r.seq < newest[0]):
                                newest = (r.seq, bar)
                        else:
                            left = self._nearest(left, r.seq, bar)
                elif r.eob in live:
                    if r.seq < live[r.eob][0]:
                        live[r.eob] = (r.seq, bar)
                elif r.eob not in seen:
                    if len(seen) >= _SEEN:
                        seen.clear()
                    seen.add(r.eob)
                    if not self.known.containsKey((r.eob,)):
                        self.known.updateValue((r.eob,), (True,))
                        live[r.eob] = (r.seq, bar)
                        if len(live) > self.most:
                            live = dict(sorted(live.items())[len(live) - self.depth :])
                    if began is None:
                        earliest = r.eob if earliest is None else min(earliest, r.eob)
            held = [*held, *(bar for _, (_, bar) in sorted(live.items()))]
            held = held[max(0, len(held) - self.depth) :]
            if earliest is None and newest is not None and self.depth > 0:
                held, earliest = [newest[1]], newest[1][0]
            waiting.seek(0)
            for seq, bar in _unpickled(waiting):
                if bar[0] < earliest:
                    left = self._nearest(left, seq, bar)
        if began is None and earliest is not None:
            self.start.update((earliest,))
        held = [*(bar for _, bar in reversed(sorted(left, key=_from_right)[: self.depth - len(held)])), *held]
        if not held:
            return
        self.bars.put(held)
        columns = list(zip(*held))
        yield Row(symbol=key[0], frequency=key[1], n=len(held), eobs=list(columns[0]), closes=list(columns[1]), bid_p=list(columns[2]), bid_v=list(columns[3]), ask_p=list(columns[4]), ask_v=list(columns[5]))

    def _nearest(self, left: list[tuple], seq, bar: tuple) -> list[tuple]:
        """``left`` with one bar more; only those that there could be room for."""
        left.append((seq, bar))
        return left if len(left) <= self.most else sorted(left, key=_from_right)[: self.depth]

    def close(self) -> None:
        pass


def _from_right(x: tuple) -> tuple:
    """Order in which bars on the left are taken."""
    return -x[1][0], x[0]


def _unpickled(file) -> Iterator[tuple]:
    while True:
        try:
            yield pickle.load(file)
        except EOFError:
            return


def _timed(d: DataFrame, *names: str) -> DataFrame:
    """Microseconds as times again."""
    for n in names:
        kind = dict(d.dtypes)[n]
        d = d.withColumn(n, F.timestamp_micros(n) if kind == "bigint" else F.transform(n, F.timestamp_micros))
    return d


def bars_by_timer(ticks: DataFrame, minutes: int = 60, frequency: str = "60m", late: str = "10 minutes") -> DataFrame:
    """Bars of a stream ``symbol, ts, value``; each comes out when its timer goes off, once the watermark has passed its end."""
    d = ticks.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).select("symbol", F.unix_micros("ts").alias("at"), "value", "ts").where("at is not null and value is not null")
    schema = T.StructType.fromDDL(BAR.replace("eob timestamp", "eob long"))
    return _timed(d.groupBy("symbol").transformWithState(TimedBars(minutes * 60_000_000, frequency), schema, "append", "eventTime"), "eob")


def first_by_state(bars: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """The first bar of each ``symbol, frequency, eob`` of a stream with ``seq`` and ``close``; in a batch the smallest ``seq``.

    Known times are forgotten ``ttl_ms`` after they came, if that is given.
    """
    d = bars.where("eob is not null").select("symbol", "frequency", F.unix_micros(F.col("eob").cast("timestamp")).alias("eob"), "seq", "close")
    out = d.groupBy("symbol", "frequency").transformWithState(FirstBars(ttl_ms), T.StructType.fromDDL("symbol string, frequency string, eob long, seq long, close double"), "append", "processingTime")
    return _timed(out, "eob")


def histories(bars: DataFrame, depth: int = 100) -> DataFrame:
    """What each series holds after each batch of a stream ``symbol, frequency, eob, seq, close, quotes, left``, as columns."""
    level = F.try_element_at("quotes", F.lit(1))  # null where there are no quotes
    best = [level[c].cast("double").alias(c) for c in ("bid_p", "bid_v", "ask_p", "ask_v")]
    d = bars.where("eob is not null").select("symbol", "frequency", F.unix_micros(F.col("eob").cast("timestamp")).alias("eob"), "seq", "close", *best, F.coalesce("left", F.lit(False)).alias("left"))
    lists = ", ".join(f"{c} array<double>" for c in ("closes", "bid_p", "bid_v", "ask_p", "ask_v"))
    out = d.groupBy("symbol", "frequency").transformWithState(History(depth), T.StructType.fromDDL(f"symbol string, frequency string, n int, eobs array<long>, {lists}"), "append", "none")
    return _timed(out, "eobs")


def as_rows(history: DataFrame) -> DataFrame:
    """A history in columns as one row for each bar, ``place`` counted from 0, the oldest."""
    zipped = F.arrays_zip("eobs", "closes", "bid_p", "bid_v", "ask_p", "ask_v")
    d = history.select("symbol", "frequency", F.posexplode(zipped).alias("place", "_b"))
    return d.select("symbol", "frequency", "place", F.col("_b.eobs").alias("eob"), F.col("_b.closes").alias("close"), *(F.col(f"_b.{c}").alias(c) for c in ("bid_p", "bid_v", "ask_p", "ask_v")))


def run(stream: DataFrame, folder: str | None = None, idle_batches: bool = True) -> str:
    """Run a stream over all that its source holds now, then stop: the folder that holds its table and its checkpoint.

    Given the folder of an earlier run, it goes on from there. Each row carries ``batch_id``, the batch it came from.
    Batches without data fire the timers that the last data's watermark has passed; with processing time, which always
    passes, they would never end, so operators whose state lives by it (:func:`first_by_state`) go without (``idle_batches``).
    """
    spark = stream.sparkSession
    ship_package(spark)
    folder = folder or scratch_folder(spark)
    conf = {"spark.sql.streaming.stateStore.providerClass": _STORE, "spark.sql.streaming.noDataMicroBatches.enabled": str(idle_batches).lower()}
    before = {k: spark.conf.get(k, None) for k in conf}
    # A batch that is done again after a failure writes its own folder anew.
    write = lambda batch, n: batch.withColumn("batch_id", F.lit(n).cast("long")).write.mode("overwrite").parquet(f"{folder}/table/b={n}")
    try:  # a stream takes the settings that hold when it starts
        for k, v in conf.items():
            spark.conf.set(k, v)
        q = stream.writeStream.outputMode("append").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(write).start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    q.awaitTermination()
    return folder


def result(spark: SparkSession, folder: str) -> DataFrame:
    """All rows that the runs in a folder have given."""
    return spark.read.parquet(f"{folder}/table").drop("b")


def latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of each key, the row of the latest batch."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("_l")).select(*keys, *(F.col(f"_l.{c}").alias(c) for c in rest if c != "batch_id"))


def file_stream(spark: SparkSession, sf_dir: str, name: str, files_per_batch: int | None = None) -> DataFrame:
    """A table's files as a stream. The path is given as a pattern, since a stream reads a folder or what a pattern matches."""
    path = f"{sf_dir.rstrip('/')}/{name}.parque[t]"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(path)
