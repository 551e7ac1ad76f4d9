"""Queries made with the SQL builder, paging, and report data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.functions.stats import rounded
from tidewater.plans import report
from tidewater.plans.catalog import query, r
from tidewater.plans.library import STATUSES, FactorLibrary
from tidewater.plans.sqlbuilder import Database, page_count, sorted_page, top_per_key
from tidewater.sources import bars, tables
from tidewater.sources.scratch import scratch_folder
from tidewater.sources.stored import StoredTable


def _db(spark, d, *names: str) -> Database:
    db = Database(spark)
    for n in names:
        db.register(n, bars.read(spark, d, n))
    return db


@query(
    "sql_where_ops",
    "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_acctbal BETWEEN 0 AND 5000 AND c_nationkey IN (1, 2, 3, 7, 9) AND c_mktsegment IS NOT NULL AND c_name ILIKE 'cust%' AND c_mktsegment <> 'BUILDING' OR c_custkey <= 5",
)
def sql_where_ops(spark, d):
    q = _db(spark, d, "customer").table("customer").fields(["c_custkey", "c_name", "c_acctbal"])
    q.where({"c_acctbal": ("between", [0.0, 5000.0]), "c_nationkey": ("in", [1, 2, 3, 7, 9]), "c_mktsegment": ("is not", None), "c_name": ("like", "cust%")})
    return q.where("c_mktsegment", ("<>", "BUILDING")).where("c_custkey", ("<=", 5), method="or").df()


@query("sql_where_wrap", "SELECT c_custkey FROM customer WHERE c_nationkey = 1 AND (c_acctbal > 9000 OR c_acctbal < 0)")
def sql_where_wrap(spark, d):
    q = _db(spark, d, "customer").table("customer").fields("c_custkey").where("c_nationkey", 1)
    return q.where({"c_acctbal": (">", 9000.0)}, wrap="(").where("c_acctbal", ("<", 0.0), method="or", wrap=")").df()


@query("sql_join_left", "SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def sql_join_left(spark, d):
    q = _db(spark, d, "customer", "nation", "region").table("customer").fields("c_custkey, n_name, r_name")
    return q.left_join("nation", "c_nationkey = n_nationkey").left_join("region", "n_regionkey = r_regionkey").df()


@query("sql_join_theta", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey >= r_regionkey")
def sql_join_theta(spark, d):
    return _db(spark, d, "nation", "region").table("nation").fields(["n_name", "r_name"]).join("region", "n_regionkey >= r_regionkey").df()


@query("sql_group", "SELECT n_name, count(*) AS n, round(sum(CAST(c_acctbal AS DECIMAL(18,2))), 2)::DOUBLE AS total FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def sql_group(spark, d):
    q = _db(spark, d, "customer", "nation").table("customer").inner_join("nation", "c_nationkey = n_nationkey")
    return q.fields("n_name, count(*) as n, cast(sum(cast(c_acctbal as decimal(18,2))) as double) as total").group_by("n_name").df()


@query("sql_page", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20 OFFSET 40")
def sql_page(spark, d):
    return _db(spark, d, "customer").table("customer").fields(["c_custkey", "c_acctbal"]).order_by("c_acctbal desc, c_custkey").page(3, 20).df()


@query("sql_raw", "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_totalprice > 1000 GROUP BY o_orderpriority")
def sql_raw(spark, d):
    return _db(spark, d, "orders").query("select o_orderpriority, count(*) as n from orders where o_totalprice > ? group by o_orderpriority", [1000.0])


def _split(spark, d):
    c = bars.read(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    db = Database(spark)
    db.register("accounts", c.where("c_custkey % 3 <> 0"))
    return db, c.where("c_custkey % 3 <> 1").withColumn("c_acctbal", F.col("c_acctbal") + 1)


@query("sql_upsert_replace", "SELECT c_custkey, c_name, CASE WHEN c_custkey % 3 <> 1 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer")
def sql_upsert_replace(spark, d):
    db, new = _split(spark, d)
    return db.table("accounts").insert(new, ["c_custkey"], "replace")


@query("sql_upsert_ignore", "SELECT c_custkey, c_name, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer")
def sql_upsert_ignore(spark, d):
    db, new = _split(spark, d)
    return db.table("accounts").insert(new, ["c_custkey"], "ignore")


@query("sql_update", "SELECT c_custkey, CASE WHEN c_acctbal < 0 AND c_nationkey = 5 THEN 'frozen' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def sql_update(spark, d):
    return _db(spark, d, "customer").table("customer").where({"c_acctbal": ("<", 0.0), "c_nationkey": 5}).update({"c_mktsegment": "frozen"}).select("c_custkey", "c_mktsegment")


@query("sql_delete", "SELECT c_custkey FROM customer WHERE NOT coalesce(c_mktsegment = 'MACHINERY' AND c_acctbal > 100, false)")
def sql_delete(spark, d):
    return _db(spark, d, "customer").table("customer").where("c_mktsegment", "MACHINERY").where("c_acctbal", (">", 100.0)).delete().select("c_custkey")


@query("sort_multi_page", "SELECT c_custkey, c_nationkey, c_acctbal FROM customer ORDER BY c_nationkey, c_acctbal DESC, c_custkey LIMIT 25 OFFSET 25")
def sort_multi_page(spark, d):
    c = bars.read(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    return sorted_page(c, [("c_nationkey", False), ("c_acctbal", True), ("c_custkey", False)], 2, 25)


@query("page_count", "SELECT CAST(ceil(count(*) / 25) AS BIGINT) AS pages FROM customer")
def pages(spark, d):
    return page_count(bars.read(spark, d, "customer"), 25)


@query("top_per_key", "SELECT event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS n FROM events) WHERE n <= 5")
def top_rows(spark, d):
    e = bars.read(spark, d, "events").select("event_type", "event_id", "value")
    return top_per_key(e, ["event_type"], [F.desc("value"), "event_id"], 5)


@query("set_difference", "SELECT s_suppkey FROM supplier EXCEPT SELECT l_suppkey FROM lineitem WHERE l_quantity > 49")
def set_difference(spark, d):
    return bars.read(spark, d, "supplier").select("s_suppkey").exceptAll(bars.read(spark, d, "lineitem").where("l_quantity > 49").select(F.col("l_suppkey").alias("s_suppkey")).distinct())


@query("set_intersection", "SELECT DISTINCT CAST(o_orderdate AS DATE)::TIMESTAMP AS date FROM orders WHERE CAST(o_orderdate AS DATE) IN (SELECT CAST(l_shipdate AS DATE) FROM lineitem)")
def set_intersection(spark, d):
    x = bars.order_nav(spark, d).select("date").intersect(bars.ship_benchmark(spark, d).select("date"))
    return x.select(F.col("date").cast("timestamp").alias("date"))


# Report data ------------------------------------------------------------------------------------------


@query("heat_scale", "WITH {days} SELECT symbol, eob, " + r("(close - min(close) OVER w) / (max(close) OVER w - min(close) OVER w)") + " AS scale FROM days WINDOW w AS (PARTITION BY symbol)")
def heat_scale(spark, d):
    return report.color_scale(bars.event_bars(spark, d, "day"), "close", ["symbol"]).select("symbol", "eob", rounded("scale").alias("scale"))


#: The colour between two stops, channel by channel.
_MIX = "printf('%02x', CAST(floor({a} + ({b} - {a}) * ({x}) + 0.5) AS BIGINT))"


def _hex(a: str, b: str, x: str) -> str:
    channels = [(int(a[i : i + 2], 16), int(b[i : i + 2], 16)) for i in (0, 2, 4)]
    return "'#' || " + " || ".join(_MIX.format(a=p, b=q, x=x) for p, q in channels)


@query(
    "heat_colors",
    "WITH {days}, u AS (SELECT symbol, eob, c.n AS name, c.s AS s, c.v AS v, CASE WHEN symbol <> 'error' AND NOT isnan(c.v) THEN c.v END AS k FROM days, unnest([{'n': 'open', 's': 'price', 'v': open}, {'n': 'close', 's': 'price', 'v': close}, {'n': 'volume', 's': 'volume', 'v': volume}]) t(c)), "
    "e AS (SELECT s, date_trunc('week', eob) AS p, min(k) AS lo, max(k) AS hi FROM u GROUP BY 1, 2), x AS (SELECT u.*, lo, hi, (k - lo) / nullif(hi - lo, 0) AS q FROM u JOIN e ON e.s = u.s AND e.p = date_trunc('week', u.eob)) "
    f"SELECT symbol, eob, name AS \"column\", v AS value, CASE WHEN k IS NULL THEN NULL WHEN lo = hi THEN CASE WHEN s = 'volume' THEN '#00ff80' ELSE '#ffffff' END WHEN s = 'volume' THEN {_hex('102030', '00ff80', 'q')} "
    f"WHEN q <= 0.5 THEN {_hex('2196f3', 'ffffff', 'q * 2')} ELSE {_hex('ffffff', 'f44336', '(q - 0.5) * 2')} END AS color FROM x",
)
def heat_colors(spark, d):
    """Colours of daily bars, week by week: prices on one scale of three colours, volumes on one of two, errors left out."""
    b = bars.event_bars(spark, d, "day").withColumn("week", F.date_trunc("week", "eob"))
    return report.heat_colors(b, ["symbol", "eob"], ["open", "close", "volume"], groups={"open": "price", "close": "price"}, group_colors={"volume": ("#102030", "#00ff80")}, skip=F.col("symbol") == "error", page=["week"])


@query("stack_percent", "WITH {days} SELECT symbol, eob, " + r("100 * volume / sum(volume) OVER (PARTITION BY eob)") + " AS percent FROM days")
def stack_percent(spark, d):
    return report.stack_percent(bars.event_bars(spark, d, "day"), "eob", "volume").select("symbol", "eob", rounded("percent").alias("percent"))


@query("kline_rows", "WITH {days} SELECT symbol, eob AS x, open AS o, close AS c, low AS l, high AS h FROM days")
def kline_rows(spark, d):
    k = report.kline(bars.event_bars(spark, d, "day"), "eob", ["symbol"])
    return k.select("symbol", "x", *(F.element_at("ohlc", i + 1).alias(n) for i, n in enumerate("oclh")))


@query("chart_series", "WITH {days} SELECT symbol, eob AS x, name, value FROM (UNPIVOT (SELECT symbol, eob, open, close FROM days) ON open, close INTO NAME name VALUE value)")
def chart_series(spark, d):
    return report.series(bars.event_bars(spark, d, "day"), "eob", ["open", "close"], ["symbol"])


@query(
    "visual_range",
    "WITH {days}, m AS (SELECT symbol, min(volume) AS lo, max(volume) AS hi FROM days GROUP BY symbol), s AS (SELECT *, CASE WHEN hi - lo >= 10 THEN 5.0 WHEN hi - lo >= 1 THEN 0.5 ELSE 0.01 END AS step FROM m) "
    "SELECT symbol, CAST(floor(lo / step) * step AS DOUBLE) AS low, CAST(ceil(hi / step) * step AS DOUBLE) AS high, CAST(step AS DOUBLE) AS step FROM s",
)
def visual_range(spark, d):
    return report.visual_range(bars.event_bars(spark, d, "day"), "volume", ["symbol"])


@query("heatmap_cells", "WITH {days} SELECT dense_rank() OVER (ORDER BY eob) - 1 AS xi, dense_rank() OVER (ORDER BY symbol) - 1 AS yi, volume AS value FROM days")
def heatmap_cells(spark, d):
    return report.heatmap(bars.event_bars(spark, d, "day"), "symbol", "eob", "volume").select(F.col("xi").cast("long").alias("xi"), F.col("yi").cast("long").alias("yi"), "value")


def _library(spark, d) -> FactorLibrary:
    """Parts as factor versions: every 300th part is another version of one factor."""
    version = F.concat(F.lit("1.0."), F.floor(F.col("p_partkey") / 300).cast("string"))
    status = F.element_at(F.array(*map(F.lit, STATUSES)), (F.col("p_size") % 4 + 1).cast("int"))
    at = F.lit("2024-01-01").cast("timestamp")
    return FactorLibrary(spark, bars.read(spark, d, "part").select(
        F.concat(F.lit("f"), (F.col("p_partkey") % 300).cast("string")).alias("factor_name"), version.alias("version"), F.col("p_type").alias("category"), F.col("p_name").alias("description"), F.col("p_brand").alias("author"),
        status.alias("status"), F.array(F.element_at(F.split("p_name", " "), 1)).alias("tags"), at.alias("created_at"), at.alias("updated_at"),
    ))


LATEST = "p AS (SELECT *, p_partkey % 300 AS name, row_number() OVER (PARTITION BY p_partkey % 300 ORDER BY p_partkey // 300 DESC) AS k FROM part)"


@query(
    "library_statistics",
    f"WITH {LATEST} SELECT 'category' AS kind, p_type AS value, count(*) AS n FROM p WHERE k = 1 GROUP BY p_type UNION ALL SELECT 'status', ['draft', 'testing', 'active', 'deprecated'][p_size % 4 + 1], count(*) FROM p GROUP BY 2 "
    "UNION ALL SELECT 'author', p_brand, count(*) FROM p GROUP BY 2",
)
def library_statistics(spark, d):
    return _library(spark, d).statistics()


@query("library_search", f"WITH {LATEST} SELECT 'f' || name AS factor_name, '1.0.' || (p_partkey // 300) AS version FROM p WHERE k = 1 AND (p_name ILIKE '%red%' OR 'f' || name ILIKE '%red%') AND p_size % 4 = 2")
def library_search(spark, d):
    lib = _library(spark, d)
    hits = lib.search("RED", ("factor_name", "description"))
    return hits.where("status = 'active'").select("factor_name", "version")


@query("sql_conditions", "SELECT c_custkey FROM customer WHERE c_nationkey = 3 AND c_acctbal > 0 OR c_mktsegment LIKE '%?%' OR c_custkey IN (7, 8) AND c_mktsegment IS NOT NULL")
def sql_conditions(spark, d):
    """Connectors that are not ``or`` count as ``and``, whatever they say; question marks in values are values."""
    q = _db(spark, d, "customer").table("customer").fields("c_custkey").where({"c_nationkey": 3, "c_acctbal": (">", 0.0, "AND 1 = 1 OR")})
    return q.where({"c_mktsegment": ("like", "%?%")}, method="OR").where({"c_custkey": ("in", [7, 8]), "c_mktsegment": ("is not", "NULL")}, method="or").df()


@query("sql_upsert_batch", "SELECT c_custkey, c_name, CASE WHEN c_custkey % 3 <> 1 THEN c_acctbal + 2 ELSE c_acctbal END AS c_acctbal FROM customer")
def sql_upsert_batch(spark, d):
    """A batch that has each key twice: the later row counts."""
    db, new = _split(spark, d)
    return db.table("accounts").insert(new.unionByName(new.withColumn("c_acctbal", F.col("c_acctbal") + 1)), ["c_custkey"], "replace")


@query("sort_numbers_in_text", "SELECT c_custkey, CAST(c_custkey % 500 AS VARCHAR) AS code FROM customer ORDER BY c_custkey % 500 DESC, c_custkey LIMIT 30 OFFSET 30")
def sort_numbers_in_text(spark, d):
    c = bars.read(spark, d, "customer").select("c_custkey", (F.col("c_custkey") % 500).cast("string").alias("code"))
    return sorted_page(c, [("code", True), ("c_custkey", False)], 2, 30)


# Stored tables and documents ----------------------------------------------------------------------------

def _stored(spark, d) -> tuple[StoredTable, DataFrame]:
    """Two thirds of the customers as a stored table, and a batch in which every customer of two thirds comes twice."""
    c = bars.read(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    table = StoredTable.create(c.where("c_custkey % 3 <> 0"), scratch_folder(spark), ["c_custkey"])
    new = c.where("c_custkey % 3 <> 1").withColumn("c_acctbal", F.col("c_acctbal") + 1).withColumn("seq", F.col("c_custkey") * 2)
    return table, new.unionByName(new.withColumns({"c_acctbal": F.col("c_acctbal") + 1, "seq": F.col("seq") + 1}))


@query("stored_replace", "SELECT c_custkey, c_name, CASE WHEN c_custkey % 3 <> 1 THEN c_acctbal + 2 ELSE c_acctbal END AS c_acctbal FROM customer")
def stored_replace(spark, d):
    """A table written, changed by a batch, tidied and opened anew."""
    table, batch = _stored(spark, d)
    table.insert(batch, "replace", "seq")
    table.tidy()
    return StoredTable(spark, table.path).df()


@query(
    "stored_insert_stops",
    "SELECT c_custkey, c_acctbal + CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END AS c_acctbal, "
    "(SELECT count(*) FROM customer WHERE c_custkey % 3 = 0 AND c_custkey < 60) AS inserted, 1 AS errors FROM customer WHERE c_custkey % 3 <> 0 OR c_custkey < 60",
)
def stored_insert_stops(spark, d):
    """Without a rule for conflicts a batch ends at the first row whose key exists; what came before it stays."""
    table, batch = _stored(spark, d)
    once = batch.where("seq % 2 = 0 and (c_custkey % 3 = 0 or c_custkey > 60)").withColumn("c_custkey", F.when(F.col("c_custkey") == 60, 1).otherwise(F.col("c_custkey")))
    counts = table.insert(once, None, "seq")
    rows = StoredTable(spark, table.path).df()
    return rows.select("c_custkey", "c_acctbal", F.lit(counts["inserted"]).cast("long").alias("inserted"), F.lit(counts["errors"]).alias("errors"))


@query("json_properties", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.missing') AS missing FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) > 50")
def json_properties(spark, d):
    """Fields of JSON texts of unknown shape."""
    x = tables.picked(tables.documents(bars.read(spark, d, "events"), "props"), "doc", {"k": ("$.k", "bigint"), "missing": ("$.missing", "string")})
    return x.where("k > 50").select("event_id", "k", "missing")


@query("json_date_keys", "WITH {days} SELECT symbol, eob AS date, close, CAST(volume AS BIGINT) AS n FROM days", dates=("date",))
def json_date_keys(spark, d):
    """Documents with dates as keys, made of daily bars, as rows again."""
    b = bars.event_bars(spark, d, "day")
    entry = F.struct(F.date_format("eob", "yyyy-MM-dd").alias("k"), F.struct("close", F.col("volume").cast("bigint").alias("n")).alias("v"))
    texts = b.groupBy("symbol").agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("text"))  # a symbol's days
    return tables.by_date_keys(tables.documents(texts, "text"), ["symbol"], "doc", {"close": ("$.close", "double"), "n": ("$.n", "bigint")})
