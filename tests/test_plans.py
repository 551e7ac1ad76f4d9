import datetime as dt

import pytest

from tidewater.operators import combine
from tidewater.operators.factors import FactorGraph
from tidewater.plans.library import FactorLibrary
from tidewater.plans.report import Notebook
from tidewater.plans.sqlbuilder import Database


@pytest.fixture()
def db(spark):
    d = Database(spark)
    d.register("t", spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, s string"))
    return d


def test_conditions(db):
    q = db.table("t").where({"id": (">", 1)}).where("s", None)
    assert q.get() == [{"id": 3, "s": None}]
    assert db.table("t").fields("count(*) as n").value() == 3
    assert db.table("t").where({"s": ("like", "A%")}).first() == {"id": 1, "s": "a"}
    assert db.table("t").order_by("id").limit(1, 1).get() == [{"id": 2, "s": "b"}]
    assert db.table("t").where({"id": 1, "s": ("=", "b", "or")}).df().count() == 2
    assert db.table("t").where({"id": ("in", [])}).df().count() == 0


def test_guards(db):
    with pytest.raises(PermissionError):
        db.query("drop table t")
    with pytest.raises(ValueError):
        db.table("t").where("s", None).delete()
    with pytest.raises(ValueError):
        db.table("t").join("u", "1 = 1", "right")


def test_upserts_take_last_or_first(db, spark):
    new = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (9, "z", 3)], "id int, s string, n int")
    got = {r["id"]: r["s"] for r in db.table("t").insert(new, ["id"], "replace", "n").collect()}
    assert got == {1: "y", 2: "b", 3: None, 9: "z"}
    got = {r["id"]: r["s"] for r in db.table("t").insert(spark.createDataFrame([(2, "q", 1), (8, "r", 1), (8, "s", 2)], "id int, s string, n int"), ["id"], "ignore", "n").collect()}
    assert got == {1: "y", 2: "b", 3: None, 9: "z", 8: "r"}


def test_changes(db):
    assert {r["s"] for r in db.table("t").where("id", (">=", 2)).update({"s": "it's"}).collect()} == {"a", "it's"}
    assert db.table("t").where("s", "it's").delete().count() == 1


def test_tables(db):
    db.create_table("made", {"a": "int", "b": "string"})
    assert db.table_exists("made") and [c["name"] for c in db.table_info("made")] == ["a", "b"]
    assert db.drop_table("made") and not db.table_exists("made")


def test_library(spark, tmp_path):
    lib = FactorLibrary(spark)
    at = dt.datetime(2024, 1, 1)
    assert lib.register("m", at=at, tags=["x"]) == "1.0.0"
    lib.register("m", "1.0.9", at=at)
    assert lib.register("m", at=at, description="Trend") == "1.0.10"
    assert lib.get("m")["version"] == "1.0.10"
    with pytest.raises(ValueError):
        lib.register("m", "1.0.9")
    lib.add_tags("m", ["y"])
    assert lib.list(tags=["y"]).count() == 1 and lib.search("TREND").count() == 1
    lib.set_status("m", "active", "1.0.10")
    lib.save(str(tmp_path / "l.json"))
    back = FactorLibrary.load(spark, str(tmp_path / "l.json"))
    assert back.entries.count() == 3 and back.list(status="active").count() == 1
    back.export_factor("m", str(tmp_path / "f.json"))
    back.delete("m", "1.0.10")
    assert back.import_factor(str(tmp_path / "f.json")) == "1.0.10"


def test_graph_order_and_cycles():
    g = FactorGraph()
    g.register("a", lambda p: p, ("b",))
    g.register("b", lambda p: p)
    assert g.levels(["a"]) == [["b"], ["a"]]
    g.register("b", lambda p: p, ("a",))
    with pytest.raises(ValueError):
        g.levels()


def test_weights_sum_to_one(spark):
    d = spark.range(50).selectExpr("cast(id as double) a", "cast(id * id as double) b", "cast(id % 7 as double) c")
    for w in (combine.min_variance(d, ["a", "b", "c"]), combine.risk_parity(d, ["a", "b", "c"]), combine.pca_weights(d, ["a", "b", "c"])):
        assert sum(w.values()) == pytest.approx(1) and min(w.values()) >= 0
    g = combine.gram_schmidt(d, ["a", "b", "c"]).selectExpr("sum(a*b) ab", "sum(a*c) ac", "sum(b*c) bc", "sum(c*c) cc").first()
    assert max(abs(g["ab"]), abs(g["ac"]), abs(g["bc"])) < 1e-8 and g["cc"] == pytest.approx(1)


def test_notebook(spark, tmp_path):
    n = Notebook("Report").section("One").markdown("text").metrics({"a": 1}).table(spark.range(3).toDF("x"))
    n.export_html(str(tmp_path / "r.html"))
    assert "Report" in (tmp_path / "r.html").read_text() and n.to_dict()["cells"][0]["cells"][2]["rows"] == [[0], [1], [2]]
