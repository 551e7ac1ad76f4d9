"""Factor graphs, validation runs, strategies, and what the SQL builder refuses."""

import datetime as dt
import json
import random

import pytest
from pyarrow import feather
from pyspark.sql import functions as F

from tidewater.functions.folds import folded
from tidewater.functions.stats import t_p_value
from tidewater.operators import asof, factors, ledger, signals, strategy, validation
from tidewater.plans import report
from tidewater.plans.sqlbuilder import Database, sorted_page
from tidewater.sources.tables import json_table, page_of


@pytest.fixture(scope="module")
def panel(spark):
    return factors.future_return(factors.momentum(factors.sample_panel(spark, 15, 60), 5), "ret").cache()


def test_sample_panel(panel):
    r = panel.agg(F.count("*").alias("n"), F.min(F.col("high") - F.col("low")).alias("w"), F.min("close").alias("c")).first()
    assert r["n"] == 900 and r["w"] >= 0 and r["c"] > 0


def test_failing_factors_are_null(panel):
    g = factors.FactorGraph()

    @g.factor("good")
    def good(p):
        return p.withColumn("good", F.col("close") * 2)

    @g.factor("bad")
    def bad(p):
        return p.withColumn("bad", F.col("no such column"))

    @g.factor("after", ("bad", "good"))
    def after(p):
        return p.withColumn("after", F.coalesce("bad", "good"))

    out = g.calculate(panel)
    assert out.where("bad is not null or after <> good").count() == 0 and set(g.errors) == {"bad"}
    assert g.statistics() == {"registered": 3, "calculated": 2, "failed": 1}
    with pytest.raises(ValueError):
        g.calculate(panel, ["none"])


def test_exports(panel, tmp_path, spark):
    d = panel.select("date", "symbol", "momentum")
    for fmt in ("parquet", "csv", "feather"):
        factors.export_results(d, str(tmp_path / fmt), fmt)
    assert spark.read.parquet(str(tmp_path / "parquet")).count() == spark.read.csv(str(tmp_path / "csv"), header=True).count() == len(feather.read_table(str(tmp_path / "feather"))) == 900
    with pytest.raises(ValueError):
        factors.export_results(d, str(tmp_path / "x"), "xlsx")


def test_validations_keep_errors_beside_results(panel, spark, tmp_path):
    validation.CHECKS["broken"] = (50, "", lambda *a: panel.select(F.raise_error(F.lit("no luck")).cast("double").alias("x")))
    try:
        got = validation.run_all(panel, "momentum", "ret")
    finally:
        del validation.CHECKS["broken"]
    assert list(got) == [*sorted(validation.CHECKS, key=lambda n: validation.CHECKS[n][0]), "broken"]
    assert "no luck" in got["broken"]["error"] and got["broken"]["value"] is None
    ic = got["information_coefficient"]["value"]
    assert 0 <= ic["p_value"] <= 1 and ic["p_value"] == t_p_value(ic["t_stat"], int(ic["n"]))
    rows = validation.result_rows(spark, got)
    assert rows.where("validation = 'broken' and error is not null").count() == 1
    validation.write_report(got, str(tmp_path / "r.json"))
    assert set(json.loads((tmp_path / "r.json").read_text())) == set(got) - {"broken"}
    assert validation.run_all(panel.withColumn("momentum", F.lit(None).cast("double")), "momentum", "ret") == {}


def test_p_values():
    for t, n, p in ((2.0, 11, 0.07338803), (0.0, 5, 1.0), (-3.5, 31, 0.00148), (12.0, 3, 0.00687)):
        assert t_p_value(t, n) == pytest.approx(p, abs=1e-4)


def _bars(spark, rows):
    return spark.createDataFrame([(s, "1d", dt.datetime(2024, 1, d), float(c)) for s, d, c in rows], "symbol string, frequency string, eob timestamp, close double")


def test_strategy_sees_history_and_is_snapshotted(spark):
    b = _bars(spark, [("a", d, 10 + d) for d in range(1, 8)] + [("b", d, 20) for d in range(2, 8)])
    seen = []

    def decide(c, now):
        h = c.history("a", 3)
        assert [x.close for x in h] == [10.0 + d for d in range(max(1, c.now.day - 2), c.now.day + 1)]
        assert {x.symbol for x in now} == {"a", "b"} and len(c.history("a", 99)) <= 4
        if c.step == 1:
            assert c.buy("a", percent=0.5) > 0 and c.buy("b", volume=10**9) == 0
        if c.step == 3:
            assert c.sell("a", percent=1.0) > 0

    got = strategy.backtest(b, decide, "2024-01-03", "2024-01-06", depth=4, cash=10_000.0)
    snaps = strategy.snapshots(got).orderBy("seq").collect()
    assert [s["created_at"].day for s in snaps] == [2, 3, 4, 5, 6] and snaps[0]["nav"] == 10_000.0 and not seen
    fills = strategy.fills(got).orderBy("seq").collect()
    volume = fills[0]["filled_volume"]
    assert [f["filled_volume"] for f in fills] == [volume, 0.0, volume] and fills[0]["price"] == 13.0 and fills[2]["price"] == 15.0
    assert snaps[2]["nav"] == pytest.approx(snaps[2]["cash"] + volume * 14.0)
    assert ledger.positions_at(strategy.fills(got), "2024-01-04 12:00:00").count() == 1 and ledger.positions_at(strategy.fills(got), "2024-01-06").count() == 0
    assert ledger.account_at(strategy.fills(got), "2024-01-04").first()["cash"] == snaps[2]["cash"]
    assert strategy.backtest(b.limit(0), decide, "2024-01-03", "2024-01-06").count() == 0


def test_folds_keep_null_keys_and_large_numbers(spark):
    d = spark.createDataFrame([(None, 1, 5), (None, 2, None), (2**53 + 1, 1, 7), (None, 3, 1), (2**53 + 1, 2, 2**60 + 1)], "k long, t int, v long")

    def step(s, x):
        s.append(x.v)
        return [(x.k, len(s), x.v)]

    got = folded(d, ["k"], ["t"], list, step, "k bigint, n int, v bigint", lambda s: [(None, -len(s), None)]).collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(None, 1, 5), (None, 2, None), (None, 3, 1), (2**53 + 1, 1, 7), (2**53 + 1, 2, 2**60 + 1), (None, -3, None), (None, -2, None)], key=repr)


def test_accounts_without_a_name(spark):
    rows = [(a, dt.datetime(2024, 1, 1), i, "x", "buy", 10.0, 100.0) for i in range(3) for a in (None, "n")]
    d = spark.createDataFrame(rows, "account string, created_at timestamp, seq int, symbol string, side string, price double, volume double")
    got = ledger.replay(d).collect()
    for a in (None, "n"):
        assert sorted(r["holding"] for r in got if r["account"] == a) == [100.0, 200.0, 300.0]


@pytest.mark.parametrize("each", [False, True])
def test_asof_over_buckets(spark, each):
    rng = random.Random(each)
    at = lambda: dt.datetime(2024, rng.randint(1, 12), rng.randint(1, 28), rng.randint(0, 23))
    right = [(rng.choice("abc"), at(), rng.choice([None, 1.0 * i]), float(i)) for i in range(120)]
    right = list({(r[0], r[1]): r for r in right}.values())
    left = [(i, rng.choice("abcd"), at()) for i in range(200)]
    got = asof.asof_join(spark.createDataFrame(left, "id int, k string, t timestamp"), spark.createDataFrame(right, "k string, u timestamp, x double, y double"), ["k"], "t", "u", ["x", "y"], "at", each=each)
    for r in got.collect():
        past = sorted((u, x, y) for k, u, x, y in right if k == r["k"] and u <= r["t"])
        want = (past[-1][1] if past else None) if not each else next((x for _, x, _ in reversed(past) if x is not None), None)
        assert (r["x"], r["y"], r["at"]) == ((want, past[-1][2], past[-1][0]) if past else (None, None, None))
    assert got.count() == 200


def test_sticky_positions_against_a_loop(spark):
    rng = random.Random(3)
    rows = [(s, "1d", dt.datetime(2024, 1, 1) + dt.timedelta(days=i), rng.choice([None, *(rng.uniform(-1, 1) for _ in range(5))])) for s in "ab" for i in range(150)]
    d = spark.createDataFrame(rows, "symbol string, frequency string, eob timestamp, x double")
    for levels in ((0.3, -0.3, -0.2, 0.2), (0.5, -0.5, 0.2, -0.2)):
        got = {(r["symbol"], r["eob"]): r["position"] for r in signals.thr_dual(d, "x", *levels).collect()}
        for s in "ab":
            p = 0
            for _, _, at, x in (r for r in rows if r[0] == s):
                if x is not None:
                    p = (1 if x > levels[0] else -1 if x < levels[1] else 0) if p == 0 else -1 if p == 1 and x < levels[3] else 1 if p == -1 and x > levels[2] else p
                assert got[s, at] == p


def test_conditions_hold_no_sql(spark):
    db = Database(spark)
    db.register("t", spark.createDataFrame([(1, "a"), (2, "b?'c"), (3, None)], "id int, s string"))
    assert db.table("t").where({"id": 1, "s": ("=", "b", "or 1=1 or")}).df().count() == 0
    assert db.table("t").where("id", 1).where("s", "zz", method="or 1=1 --").df().count() == 0
    for bad in (("in", "abc"), ("is", 3), ("between", [1])):
        with pytest.raises(ValueError):
            db.table("t").where("id", bad)
    assert db.table("t").where("s", ("is", "null")).df().count() == 1
    assert db.table("t").where("s", "b?'c").where("id", 2).update({"s": "?"}).where("s = '?'").count() == 1
    assert db.table("t").where({"s": "?"}).delete().count() == 2
    assert "`id`" in db.table("t").where("id", 1).explain()


def test_batches_without_an_order(spark):
    db = Database(spark)
    db.register("u", spark.createDataFrame([(1, "a")], "id int, s string"))
    batch = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z")], "id int, s string")
    assert {r["id"]: r["s"] for r in db.table("u").insert(batch, ["id"], "replace").collect()} == {1: "y", 2: "z"}
    db.register("u", spark.createDataFrame([(1, "a")], "id int, s string"))
    assert {r["id"]: r["s"] for r in db.table("u").insert(batch.unionByName(batch.where("id = 2")), ["id"], "ignore").collect()} == {1: "a", 2: "z"}


def test_views_go_with_their_database(spark):
    with Database(spark) as db:
        db.register("gone", spark.range(3))
        assert db.table("gone").fields("count(*)").value() == 3
    assert not spark.catalog.tableExists("gone")


def test_json_tables(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps([{"id": i, "a": {"b": str(i * 7 % 30)}, "c": "x" if i % 2 else ""} for i in range(12)]))
    d = json_table(spark, str(tmp_path / "t.json"), filters={"c": "x", "id": None, "a": ""})
    assert d.count() == 6
    rows = sorted_page(d, [("a.b", False)], 1, 6).collect()
    assert [r["a"]["b"] for r in rows] == sorted((r["a"]["b"] for r in rows), key=float)
    assert page_of(d, ["id", "a.b"]).columns == ["id", "a_b"] and page_of(d).columns == d.columns
    assert json_table(spark, ['{"x": {"y": 3}}', '{"x": null}'], "x struct<y int>", {"x.y": 3}).count() == 1


def test_documents(spark, panel):
    d = panel.where("symbol = 'S0001'")
    doc = report.Notebook("t").scatter(d, "close", ["volume"], 10).grid([{"type": "line"}, {"type": "bar"}], [3, 1])

    @report.cell_kind("note")
    def note(text):
        return {"text": text.upper()}

    doc.cell("note", text="hi").cell("other", a=1)
    cells = doc.to_dict()["cells"]
    assert [c["height"] for c in cells[1]["charts"]] == ["75%", "25%"] and len(cells[0]["series"][0]["data"]) == 10
    assert cells[2] == {"type": "note", "text": "HI"} and cells[3] == {"type": "other", "a": 1}
    metrics = spark.createDataFrame([("b", 1, 2.0), ("a", 0, 1.0)], "name string, place int, value double")
    trips = spark.createDataFrame([("x", 1.0), ("y", -1.0)], "symbol string, profit double")
    got = report.account_report("acc", metrics, d.select("date", "close"), trips).to_dict()["cells"]
    assert [i["name"] for i in got[0]["items"]] == ["a", "b"] and got[2]["cells"][0]["rows"][0][0] == "x"


def test_p_values(spark):
    from tidewater.functions import stats

    rows = [(t, n) for n in (2, 3, 4, 7, 30, 251, 5000) for t in (-8.0, -2.5, -1e-3, 0.0, 0.4, 1.0, 1.96, 3.3, 12.0)]
    d = spark.createDataFrame([*rows, (None, 9), (1.0, 1), (float("nan"), 9)], "t double, n long")
    got = [r["p"] for r in d.select(stats.p_value(F.col("t"), F.col("n")).alias("p")).collect()]
    for (t, n), p in zip(rows, got):
        assert p == pytest.approx(stats.t_p_value(t, n) if t else 1.0, rel=1e-9, abs=1e-300)
    assert got[-3:] == [None, None, None]


def test_all_validations_are_one_lazy_plan(spark, panel):
    sc = spark.sparkContext
    sc.setJobGroup("building", "no job while the plan is made")
    try:
        plan = validation.validation_plan(panel, "momentum", "ret", q=4, window=12)
        assert not sc.statusTracker().getJobIdsForGroup("building")
    finally:
        sc.setJobGroup("", "")
    got = {(r["validation"], r["name"]): r["value"] for r in plan.collect()}
    want = validation.run_all(panel, "momentum", "ret", q=4)
    for v, entry in want.items():
        for name, value in entry["value"].items():
            if v != "stability":
                assert got[v, name] == (None if value is None else pytest.approx(value, rel=1e-9, abs=1e-12)), (v, name)
    steady = factors.stability(factors.ic_by_date(factors.aligned(panel, "momentum", "ret"), "momentum", "ret"), 12).first().asDict()
    assert {n: got["stability", n] for n in steady} == {n: None if x is None else pytest.approx(x, rel=1e-9) for n, x in steady.items()}
    empty = validation.validation_plan(panel.where("false"), "momentum", "ret").collect()
    assert {r["value"] for r in empty if r["name"] in ("ic_mean", "p_value", "spread", "decay_rate", "autocorr_1")} == {None}
