"""Replay on streams by keyed state: restarts, timers, first bars, histories."""

import random
import weakref
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewater.streaming import replay

T0 = datetime(2024, 1, 1)
TICKS = "symbol string, ts timestamp, value double"
BARS = "symbol string, frequency string, eob timestamp, seq long, close double, quotes array<struct<bid_p: double, bid_v: double, ask_p: double, ask_v: double>>, left boolean"


def _add(spark, rows, schema, folder):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))


def _stream(spark, schema, folder):
    return spark.readStream.schema(schema).parquet(str(folder))


def test_timers_close_bars_across_a_restart(spark, tmp_path):
    tick = lambda m, v: ("s", T0 + timedelta(minutes=m), v)
    _add(spark, [tick(5, 2.0), tick(1, 1.0), tick(59, 3.0), tick(61, 9.0)], TICKS, tmp_path / "in")
    folder = replay.run(replay.bars_by_timer(_stream(spark, TICKS, tmp_path / "in")), str(tmp_path / "run"))
    assert replay.result(spark, folder).count() == 0 if (tmp_path / "run" / "table").exists() else True
    _add(spark, [tick(30, 70.0), tick(55, 7.0), tick(90, 4.0), tick(135, 5.0)], TICKS, tmp_path / "in")
    replay.run(replay.bars_by_timer(_stream(spark, TICKS, tmp_path / "in")), folder)
    _add(spark, [tick(20, 100.0), tick(200, 1.0), ("r", T0 + timedelta(minutes=170), 1.0), (None, T0 + timedelta(minutes=171), 2.0), ("s", None, 1.0)], TICKS, tmp_path / "in")
    replay.run(replay.bars_by_timer(_stream(spark, TICKS, tmp_path / "in")), folder)
    got = {(r["symbol"], r["eob"]): (r["open"], r["high"], r["low"], r["close"], r["volume"]) for r in replay.result(spark, folder).collect()}
    at = lambda h: T0 + timedelta(hours=h)
    # The tick of minute 55 came before the watermark (minute 51 then) passed it; those of minutes 30 and 20 came too late.
    assert got == {("s", at(0)): (1.0, 7.0, 1.0, 3.0, 4.0), ("s", at(1)): (9.0, 9.0, 4.0, 4.0, 2.0), ("s", at(2)): (5.0, 5.0, 5.0, 5.0, 1.0), ("r", at(2)): (1.0, 1.0, 1.0, 1.0, 1.0), (None, at(2)): (2.0, 2.0, 2.0, 2.0, 1.0)}


def test_first_bars_across_a_restart(spark, tmp_path):
    bar = lambda i, seq, x, s="s": (s, "1d", T0 + timedelta(days=i), seq, x)
    schema = "symbol string, frequency string, eob timestamp, seq long, close double"
    _add(spark, [bar(0, 2, 2.0), bar(0, 1, 1.0), bar(1, 3, 3.0)], schema, tmp_path / "in")
    folder = replay.run(replay.first_by_state(_stream(spark, schema, tmp_path / "in"), 86_400_000), str(tmp_path / "run"), idle_batches=False)
    _add(spark, [bar(0, 0, 9.0), bar(2, 5, 5.0), bar(0, 6, 6.0, "t")], schema, tmp_path / "in")
    replay.run(replay.first_by_state(_stream(spark, schema, tmp_path / "in"), 86_400_000), folder, idle_batches=False)
    rows = replay.result(spark, folder).collect()
    assert sorted((r["symbol"], r["eob"], r["close"]) for r in rows) == [("s", T0, 1.0), ("s", T0 + timedelta(days=1), 3.0), ("s", T0 + timedelta(days=2), 5.0), ("t", T0, 6.0)]


def _plain_history(batches, depth):
    """The same by definition, for one series: live bars right, history left."""
    held, known, earliest = [], set(), None
    for batch in batches:
        for _, _, eob, _, close, quotes, left in sorted(batch, key=lambda b: (b[6], b[2].timestamp() * (-1 if b[6] else 1), b[3])):
            bar = (eob, close, quotes[0][0] if quotes else None)
            if left:
                if len(held) < depth and (earliest is None or eob < earliest):
                    held.insert(0, bar)
                    earliest = earliest or eob
            elif eob not in known:
                known.add(eob)
                held = (held + [bar])[-depth:]
                earliest = earliest or eob
    return held


@pytest.mark.parametrize("depth", [3, 6, 50])
def test_history_in_rows_and_columns(spark, tmp_path, depth):
    bar = lambda i, seq, x, q=True, left=False: ("s", "1d", T0 + timedelta(days=i), seq, x, [(x - 1, 1.0, x + 1, 1.0), (0.0, 0.0, 0.0, 0.0)] if q else None, left)
    batches = [[bar(10, 1, 1.0), bar(11, 2, 2.0, False)], [bar(9, 3, 3.0), bar(11, 4, 4.0), bar(12, 5, 5.0), bar(5, 6, 6.0, left=True), bar(4, 7, 7.0, left=True), bar(10, 8, 8.0, left=True)], [bar(13, 9, 9.0), bar(3, 10, 10.0, left=True)]]
    folder = str(tmp_path / "run")
    for i, b in enumerate(batches):
        _add(spark, b, BARS, tmp_path / "in")
        replay.run(replay.histories(_stream(spark, BARS, tmp_path / "in"), depth), folder)
        held = replay.latest(replay.result(spark, folder), ["symbol", "frequency"])
        want = _plain_history(batches[: i + 1], depth)
        columns = held.first()
        assert (columns["n"], columns["closes"], columns["bid_p"]) == (len(want), [x for _, x, _ in want], [p for _, _, p in want])
        rows = replay.as_rows(held).orderBy("place").collect()
        assert [(r["eob"], r["close"], r["bid_p"]) for r in rows] == want


def test_settings_of_the_session_are_left_alone(spark, tmp_path):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    _add(spark, [("s", T0, 1.0)], TICKS, tmp_path / "in")
    replay.run(replay.bars_by_timer(_stream(spark, TICKS, tmp_path / "in")).withColumn("x", F.lit(1)), str(tmp_path / "run"))
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before


class _State:
    """A processor's state in memory, of any of the three kinds."""

    def __init__(self):
        self.map, self.value = {}, None

    def getListState(self, *_):
        return _State()

    getValueState = getMapState = getListState

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def put(self, value):
        self.value = list(value)

    update = put

    def containsKey(self, key):
        return key in self.map

    def updateValue(self, key, value):
        self.map[key] = value


class _Bar:
    def __init__(self, eob, seq, close, left):
        self.eob, self.seq, self.close, self.left = eob, seq, close, left
        self.bid_p = self.bid_v = self.ask_p = self.ask_v = None


@pytest.mark.parametrize("depth", [1, 4, 30])
def test_histories_of_shuffled_batches(monkeypatch, depth):
    monkeypatch.setattr(replay, "_SEEN", 3)
    rng = random.Random(depth)
    for trial in range(150):
        history, batches = replay.History(depth), []
        history.most = depth + 2
        history.init(_State())
        for b in range(3):
            share = rng.choice([0.0, 0.5, 1.0])
            batches.append([("s", "1d", T0 + timedelta(days=rng.randrange(25)), i, float(100 * b + i), None, rng.random() < share) for i in rng.sample(range(60), rng.choice([0, 5, 60]))])
            bars = [_Bar((x[2] - T0).days, x[3], x[4], x[6]) for x in batches[-1]]
            got = list(history.handleInputRows(("s", "1d"), iter(bars), None)) if bars else []
            if got:
                want = _plain_history(batches, depth)
                assert list(zip(got[0]["eobs"], got[0]["closes"])) == [((t - T0).days, x) for t, x, _ in want]


@pytest.mark.parametrize("left", [False, True])
def test_a_batch_is_not_held(left):
    """However many rows of a series a batch has, few of them are alive at a time."""
    alive, most = weakref.WeakSet(), [0]

    def rows():
        for i in range(20_000):
            r = _Bar(i, i, float(i), left)
            alive.add(r)
            most[0] = max(most[0], len(alive))
            yield r

    history = replay.History(5)
    history.init(_State())
    (got,) = history.handleInputRows(("s", "1d"), rows(), None)
    assert got["eobs"] == list(range(19_995, 20_000)) and most[0] < 100
