"""Named queries over the test tables, each with the SQL that gives the same rows where there is such SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Adapters, as DuckDB reads them.
CTES = {
    "bars": """bars AS (SELECT event_type AS symbol, '60m' AS frequency, date_trunc('hour', ts) AS eob, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low,
        arg_max(value, ts) AS close, CAST(count(*) AS DOUBLE) AS volume, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS amount FROM events GROUP BY event_type, date_trunc('hour', ts))""",
    "days": """days AS (SELECT event_type AS symbol, '1d' AS frequency, date_trunc('day', ts) AS eob, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low,
        arg_max(value, ts) AS close, CAST(count(*) AS DOUBLE) AS volume, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS amount FROM events GROUP BY event_type, date_trunc('day', ts))""",
    "panel": """panel AS (SELECT date_trunc('month', l_shipdate) AS date, l_suppkey AS symbol, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / sum(l_quantity) AS close,
        max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low, sum(l_quantity) AS volume,
        CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS amount FROM lineitem GROUP BY date_trunc('month', l_shipdate), l_suppkey)""",
    "nav": """nav AS (SELECT CAST(o_orderdate AS DATE) AS date, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS assets FROM orders GROUP BY CAST(o_orderdate AS DATE))""",
    "bench": """bench AS (SELECT CAST(l_shipdate AS DATE) AS date, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / sum(l_quantity) AS close FROM lineitem GROUP BY CAST(l_shipdate AS DATE))""",
    "trades": """trades AS (SELECT event_id AS seq, ts AS created_at, user_id AS symbol, value AS price, CAST(100 * (1 + event_id % 5) AS DOUBLE) AS volume,
        CASE WHEN event_type IN ('purchase','view','signup') THEN 1 ELSE 2 END AS side, greatest(CAST(round(CAST(value AS DECIMAL(18,2)) * CAST(100 * (1 + event_id % 5) AS INT) * 0.0003, 2) AS DOUBLE), 5.0) AS fee FROM events)""",
}


def query(name: str, sql: str | None = None, dates: tuple[str, ...] = ()) -> Callable[[Query], Query]:
    """Register a query; in its SQL, ``{bars}`` and the like stand for the adapters' common table expressions.

    Columns named in ``dates`` are returned as timestamps, which all readers show alike.
    """

    def add(f: Query) -> Query:
        QUERIES[name] = f if not dates else lambda spark, d: f(spark, d).withColumns({c: F.col(c).cast("timestamp") for c in dates})
        if sql:
            text = sql
            for k, v in CTES.items():
                text = text.replace("{" + k + "}", v)
            if dates:
                text = f"SELECT * REPLACE ({', '.join(f'CAST({c} AS TIMESTAMP) AS {c}' for c in dates)}) FROM ({text})"
            ORACLES[name] = text
        return f

    return add


def r(x: str, digits: int = 6) -> str:
    """Rounded in SQL, as :func:`tidewater.functions.stats.rounded` does."""
    return f"(round({x}, {digits}) + 0.0)"


def load() -> None:
    """Import the modules that register queries."""
    from tidewater.plans import queries_bars, queries_factors, queries_nav, queries_sql, queries_streams  # noqa: F401
