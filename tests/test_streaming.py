from datetime import datetime, timedelta

import pandas as pd

from tidewater.streaming import live


def _run(spark, df, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.table(name)


def test_bars_and_sessions(spark, tmp_path):
    t = datetime.fromisoformat
    rows = [("s", t("2024-01-01 10:05"), 1.0), ("s", t("2024-01-01 10:55"), 3.0), ("s", t("2024-01-01 12:30"), 2.0)]
    spark.createDataFrame(rows, "symbol string, ts timestamp, value double").coalesce(1).write.parquet(str(tmp_path / "e"))
    read = lambda: spark.readStream.schema("symbol string, ts timestamp, value double").parquet(str(tmp_path / "e"))
    got = _run(spark, live.stream_bars(read()), "bars").collect()
    assert [(r["open"], r["high"], r["close"], r["volume"]) for r in got] == [(1.0, 3.0, 3.0, 2.0)]
    assert _run(spark, live.sessions(read(), "1 hour"), "sess").count() == 1


def test_keyed_state(spark, tmp_path):
    schema = "symbol string, frequency string, eob timestamp, close double"
    t = datetime.fromisoformat("2024-01-01")
    rows = [("s", "1d", t + timedelta(days=i), float(i * i % 7)) for i in range(20)]
    for k in range(2):
        spark.createDataFrame(rows[k * 10 : k * 10 + 10], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "b"))
    read = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "b"))
    got = _run(spark, live.ewm_cross(read(), 3, 6), "dif").toPandas().sort_values("eob")
    x = pd.Series([r[3] for r in rows])
    want = x.ewm(span=3).mean() - x.ewm(span=6).mean()
    assert abs(got["dif"].to_numpy() - want.to_numpy()).max() < 1e-12
    last = _run(spark, live.last_closes(read(), 5), "buf", "update").collect()[-1]
    assert list(last["closes"]) == [r[3] for r in rows[-5:]]
    assert _run(spark, live.first_bars(read()), "dd").count() == 20
