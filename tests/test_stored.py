"""Tables that outlive a session, documents of unknown shape, report cells and colours."""

import pytest
from pyspark.sql import functions as F

from tidewater.operators import nav
from tidewater.plans import report
from tidewater.sources import tables
from tidewater.sources.stored import StoredTable

SCHEMA = "k int, g string, x double"


def _rows(t):
    return sorted(((r["k"], r["g"], r["x"]) for r in t.df().collect()), key=repr)


@pytest.fixture()
def table(spark, tmp_path):
    return StoredTable.create(spark.createDataFrame([(1, "a", 1.0), (2, "a", 2.0), (None, "b", 3.0)], SCHEMA), str(tmp_path / "t"), ["k", "g"])


def _batch(spark, rows):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], SCHEMA + ", seq int")


def test_a_batch_ends_at_the_first_error(spark, table):
    got = table.insert(_batch(spark, [(3, "a", 1.0), (4, "a", 1.0), (3, "a", 9.0), (5, "a", 1.0)]), seq="seq")
    assert (got["inserted"], got["errors"]) == (2, 1) and "'k': 3" in got["error_details"][0]["error"]
    assert _rows(table) == _rows(StoredTable(spark, table.path)) and len(_rows(table)) == 5
    assert table.insert(_batch(spark, [(None, "b", 0.0), (7, "a", 1.0)]), seq="seq")["inserted"] == 0
    assert table.insert(_batch(spark, [(8, "a", 0.0), (9, "a", 1.0)]), seq="seq") == {"inserted": 2, "errors": 0, "error_details": []}


def test_replace_and_ignore(spark, table):
    batch = [(1, "a", 10.0), (5, "c", 5.0), (1, "a", 11.0), (5, "c", 6.0), (None, "b", 30.0)]
    assert table.insert(_batch(spark, batch), "ignore", "seq")["inserted"] == 5
    assert _rows(table) == [(1, "a", 1.0), (2, "a", 2.0), (5, "c", 5.0), (None, "b", 3.0)]
    table.insert(_batch(spark, batch), "replace", "seq")
    assert _rows(table) == [(1, "a", 11.0), (2, "a", 2.0), (5, "c", 6.0), (None, "b", 30.0)]


def test_readers_keep_their_version_until_tidied(spark, table):
    before = table.df()
    table.insert(_batch(spark, [(9, "z", 9.0)]), seq="seq")
    assert before.count() == 3 and table.df().count() == 4
    assert table.tidy() == 1 and table.df().count() == 4 and table.keys == ["k", "g"]


def test_what_tables_refuse(spark, table, tmp_path):
    with pytest.raises(ValueError):
        StoredTable.create(spark.createDataFrame([(1, "a", 1.0)], SCHEMA), table.path, ["k"])
    with pytest.raises(ValueError):
        StoredTable.create(spark.createDataFrame([(1, "a", 1.0), (1, "b", 1.0)], SCHEMA), str(tmp_path / "u"), ["k"])
    with pytest.raises(ValueError):
        table.insert(spark.createDataFrame([(1,)], "k int"))
    with pytest.raises(ValueError):
        table.insert(_batch(spark, [(1, "a", 1.0)]), "merge", "seq")


def test_documents(spark):
    texts = ['{"2024-01-01": {"v": 1, "w": "x"}, "2024-02-30": {"v": 2}, "note": 1, "2024-01-03": {"v": "no number"}}', "[1, 2]", "no json", None, "{}", '{"2024-01-02": null}']
    d = tables.documents(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), "text")
    got = [tuple(r) for r in tables.by_date_keys(d, ["i"], "doc", {"v": ("$.v", "int"), "w": ("$.w", "string")}).orderBy("date").collect()]
    assert [(i, str(day), v, w) for i, day, v, w in got] == [(0, "2024-01-01", 1, "x"), (5, "2024-01-02", None, None), (0, "2024-01-03", None, None)]
    assert [r["a"] for r in tables.picked(d, "doc", {"a": ("$[1]", "int")}).orderBy("i").collect()] == [None, 2, None, None, None, None]


def test_cells_say_what_they_leave_out(spark):
    d = spark.range(10).select(F.col("id").alias("x"), (F.col("id") * 2).alias("y"))
    cells = report.Notebook("n").chart("line", d, "x", points=3).chart("line", d, "x").pie(d, "x", "y", 2).table(d.orderBy("x"), 4).scatter(d, "x", ["y"], 2).table(d, None).cells
    assert cells[0]["xAxis"] == ["7", "8", "9"] and cells[0]["left_out"] == 7 and "left_out" not in cells[1]
    assert cells[2]["data"] == [{"name": 9, "value": 18}, {"name": 8, "value": 16}, {"name": "other", "value": 56}] and cells[2]["left_out"] == 8
    assert cells[3]["left_out"] == 6 and cells[4]["left_out"] == 8 and len(cells[5]["rows"]) == 10


def test_colours(spark):
    d = spark.createDataFrame([("a", 0.0, 5.0), ("b", 10.0, 5.0), ("c", 5.0, None), ("d", 99.0, 5.0), ("e", 2.5, float("nan"))], "k string, x double, y double")
    got = {(r["k"], r["column"]): r["color"] for r in report.heat_colors(d, ["k"], ["x", "y"], skip=F.col("k") == "d").collect()}
    assert got == {("a", "x"): "#2196f3", ("b", "x"): "#f44336", ("c", "x"): "#ffffff", ("d", "x"): None, ("e", "x"): "#90cbf9", ("a", "y"): "#ffffff", ("b", "y"): "#ffffff", ("c", "y"): None, ("d", "y"): None, ("e", "y"): None}
    table = {(r["k"], r["column"]): r["color"] for r in report.heat_colors(d, ["k"], ["x", "y"], ("#000", "#0000ff"), "table").collect()}
    assert table["a", "x"] == "#000000" and table["d", "x"] == "#0000ff" and table["a", "y"] == "#00000d"
    with pytest.raises(ValueError):
        report.heat_colors(d, ["k"], ["x"], ("#000",)).collect()


def test_failing_metrics_stay_rows(spark):
    rows = [("p", f"2024-01-0{i}", float(i)) for i in range(1, 6)]
    d = spark.createDataFrame(rows, "portfolio string, date string, assets double").withColumn("date", F.to_date("date"))

    @nav.metric("raises", 70)
    def raises():
        raise RuntimeError("no luck")

    @nav.metric("best_day", 71)
    def best_day():
        return F.max("r")

    try:
        got = {r["name"]: r for r in nav.collected_metrics(d, ["portfolio"]).collect()}
    finally:
        del nav.BUILDERS["raises"], nav.BUILDERS["best_day"]
    assert got["raises"]["error"] == "no luck" and got["raises"]["value"] is None and got["best_day"]["value"] == 1.0
    assert [n for n, r in sorted(got.items(), key=lambda x: x[1]["place"])][:3] == ["return_rate", "annualized_return", "volatility"]


def test_rendered_report(spark, tmp_path):
    daily = spark.createDataFrame([(f"2024-01-{i:02d}", 100.0 + i) for i in range(1, 11)], "date string, assets double")
    trips = spark.createDataFrame([("a", 5.0), ("<b>", -3.0)], "symbol string, profit double")
    named = spark.createDataFrame([("return_rate", 0, 0.09), ("sharpe", 1, None)], "name string, place int, value double")
    report.account_report("Report & more", named, daily, trips, days=4).chart("bar", daily, "date").cell("tree", leaves=[1]).export_html(str(tmp_path / "r.html"))
    page = (tmp_path / "r.html").read_text()
    assert "<h1>Report &amp; more</h1>" in page and page.count("<polyline") == 1 and page.count("<rect") == 10
    assert "2024-01-07 to 2024-01-10" in page and "6 more are not shown" in page and "&lt;b&gt;" in page and '"leaves"' in page
