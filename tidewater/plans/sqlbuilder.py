"""A fluent builder of read queries and table changes, run as parameterised Spark SQL.

Conditions are kept as text with ``?`` markers and a list of values, so values never become part of the SQL;
connectors other than ``or`` count as ``and``.
Tables are temporary views; changes make a new DataFrame and replace the view.
"""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The comparison operators of conditions; any other word means "=".
OPERATORS = ("=", "<>", "!=", ">", "<", ">=", "<=", "like", "not like", "in", "not in", "is", "is not", "between", "not between")

_READ_ONLY = re.compile(r"^\s*(select|with|pragma|explain)\b", re.IGNORECASE)


def _name(field: str) -> str:
    """A column's name in quotes, dots between parts kept; anything with a parenthesis, and ``*``, stays as it is."""
    field = field.strip()
    if "(" in field or field == "*":
        return field
    return ".".join(f"`{p.strip('`')}`" for p in field.split("."))


def _link(word: Any) -> str:
    return "or" if str(word).strip().lower() == "or" else "and"


def run(spark: SparkSession, text: str, params: list) -> DataFrame:
    """Run SQL with a value for each ``?`` outside quotes. Markers are given names, which bind whatever the parser's order."""
    n = iter(range(len(params) + 1))
    named = re.sub(r"('(?:[^'\\]|\\.)*'|`[^`]*`|\"[^\"]*\")|\?", lambda m: m[1] or f":p{next(n)}", text)
    if next(n) != len(params):
        raise ValueError("as many values as markers are needed")
    return spark.sql(named, args={f"p{i}": v for i, v in enumerate(params)} or None)


class Database:
    """Tables of a session, by name."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._made: set[str] = set()

    def __enter__(self) -> Database:
        return self

    def __exit__(self, *_: Any) -> None:
        self.close()

    def close(self) -> None:
        """Drop the views that were made here."""
        for name in self._made:
            self.spark.catalog.dropTempView(name)
        self._made.clear()

    def table(self, name: str) -> Query:
        return Query(self, name)

    def create_table(self, name: str, columns: str | dict[str, str]) -> DataFrame:
        """An empty table; ``columns`` is a DDL text, or types by name."""
        ddl = columns if isinstance(columns, str) else ", ".join(f"{c} {t}" for c, t in columns.items())
        return self._put(name, self.spark.createDataFrame([], T.StructType.fromDDL(ddl)))

    def register(self, name: str, df: DataFrame) -> DataFrame:
        return self._put(name, df)

    def _put(self, name: str, df: DataFrame) -> DataFrame:
        df.createOrReplaceTempView(name)
        self._made.add(name)
        return df

    def drop_table(self, name: str) -> bool:
        return self.spark.catalog.dropTempView(name)

    def table_exists(self, name: str) -> bool:
        return self.spark.catalog.tableExists(name)

    def tables(self) -> list[str]:
        return sorted(t.name for t in self.spark.catalog.listTables())

    def table_info(self, name: str) -> list[dict[str, Any]]:
        return [{"cid": i, "name": f.name, "type": f.dataType.simpleString(), "notnull": not f.nullable} for i, f in enumerate(self.spark.table(name).schema)]

    def query(self, sql: str, params: list | None = None) -> DataFrame:
        """A read-only statement; others raise ``PermissionError``."""
        if not _READ_ONLY.match(sql):
            raise PermissionError("only reading statements may be run here")
        return run(self.spark, sql, list(params or []))


class Query:
    """One statement in the making. Terminal methods leave the builder as it was; builders may be reused."""

    def __init__(self, db: Database, table: str):
        self.db, self.name = db, table
        self._fields, self._joins, self._where, self._params = "*", "", "", []
        self._group = self._order = ""
        self._limit: tuple[int, int] | None = None

    # Conditions -----------------------------------------------------------------------------------------

    def where(self, condition: dict | str, value: Any = None, method: str = "and", wrap: str = "") -> Query:
        """Add conditions: a dict of column to value, ``(operator, value)`` or ``(operator, value, connector)``, or one column and a value.

        ``method`` joins what this call adds to what is there. The first condition's connector does not count, and
        AND binds tighter than OR; ``wrap`` puts ``(``, ``)`` or both around what this call adds.
        """
        items = condition.items() if isinstance(condition, dict) else [(condition, value)]
        text, params, method = "", [], _link(method)
        for field, v in items:
            op, v, link = self._parts(v)
            one, some = self._condition(field, op, v)
            text += (f" {link} " if text else "") + one
            params += some
        if not text:
            return self
        text = ("(" if wrap in ("(", "()") else "") + text + (")" if wrap in (")", "()") else "")
        self._where += (f" {method} " if self._where else "") + text
        self._params += params
        return self

    @staticmethod
    def _parts(v: Any) -> tuple[str, Any, str]:
        if isinstance(v, (list, tuple)) and len(v) >= 2 and isinstance(v[0], str):
            op = v[0] if v[0] in OPERATORS else "="
            return op, v[1], _link(v[2]) if len(v) > 2 else "and"
        return ("is" if v is None else "="), v, "and"

    @staticmethod
    def _condition(field: str, op: str, v: Any) -> tuple[str, list]:
        name = _name(field)
        if op in ("in", "not in"):
            if not isinstance(v, (list, tuple)):
                raise ValueError(f"{op} needs a list of values")
            v = list(v)
            return (f"{name} {op} ({', '.join('?' * len(v))})", v) if v else (("1 = 0" if op == "in" else "1 = 1"), [])
        if op in ("between", "not between"):
            if not isinstance(v, (list, tuple)) or len(v) != 2:
                raise ValueError(f"{op} needs two values")
            return f"{name} {op} ? and ?", list(v)
        if op in ("is", "is not"):
            if v is not None and str(v).lower() != "null":
                raise ValueError(f"{op} needs None or 'null'")
            return f"{name} {op} null", []
        if op in ("like", "not like"):
            return f"{name} {op.replace('like', 'ilike')} ?", [v]  # without regard to case
        return f"{name} {op} ?", [v]

    # Clauses --------------------------------------------------------------------------------------------

    def fields(self, fields: str | list[str]) -> Query:
        """A list of names, or a text; a text with a parenthesis is taken as it stands."""
        if isinstance(fields, str) and "(" in fields:
            self._fields = fields
        else:
            self._fields = ", ".join(_name(f) for f in (fields.split(",") if isinstance(fields, str) else fields))
        return self

    def join(self, table: str, on: str, how: str = "inner") -> Query:
        if how.strip().lower().startswith("right"):
            raise ValueError("right joins are not offered; swap the tables")
        self._joins += f" {how} join {table} on {on}"
        return self

    def left_join(self, table: str, on: str) -> Query:
        return self.join(table, on, "left")

    def inner_join(self, table: str, on: str) -> Query:
        return self.join(table, on, "inner")

    def group_by(self, text: str) -> Query:
        self._group = text
        return self

    def order_by(self, text: str) -> Query:
        self._order = text
        return self

    def limit(self, a: int, b: int = 0) -> Query:
        """``limit(n)``, or ``limit(offset, n)``."""
        self._limit = (a, b) if b else (0, a)
        return self

    def page(self, number: int, rows: int) -> Query:
        """Pages count from 1."""
        self._limit = ((max(1, number) - 1) * rows, rows)
        return self

    # Results --------------------------------------------------------------------------------------------

    def sql(self) -> tuple[str, list]:
        text = f"select {self._fields} from {self.name}{self._joins}"
        for word, part in (("where", self._where), ("group by", self._group), ("order by", self._order)):
            text += f" {word} {part}" if part else ""
        if self._limit:
            text += f" limit {self._limit[1]}" + (f" offset {self._limit[0]}" if self._limit[0] else "")
        return text, list(self._params)

    def df(self) -> DataFrame:
        text, params = self.sql()
        return run(self.db.spark, text, params)

    def get(self) -> list[dict]:
        return [r.asDict() for r in self.df().collect()]

    def first(self) -> dict | None:
        r: Row | None = self.df().first()
        return r.asDict() if r else None

    def value(self) -> Any:
        r = self.df().first()
        return r[0] if r else None

    # Changes --------------------------------------------------------------------------------------------

    def insert(self, rows: DataFrame, keys: list[str] | None = None, on_conflict: str | None = None, seq: str | None = None) -> DataFrame:
        """Append rows; of rows whose ``keys`` exist, ``replace`` takes the new (the last of the batch by ``seq``), ``ignore`` keeps the old (or the first of the batch).

        Without ``seq`` the order of the batch is that of its partitions and of the rows in them.
        """
        old = self.db.spark.table(self.name)
        new = rows
        if on_conflict not in (None, "replace", "ignore"):
            raise ValueError(f"unknown conflict rule {on_conflict!r}")
        if on_conflict and not keys:
            raise ValueError("a conflict rule needs keys")
        if on_conflict and not seq:
            seq = "_seq"
            rows = rows.withColumn(seq, F.monotonically_increasing_id())
        if on_conflict:
            pick = F.max_by if on_conflict == "replace" else F.min_by
            new = rows.groupBy(*keys).agg(pick(F.struct(*[c for c in rows.columns if c not in keys]), seq).alias("_r")).select(*keys, *(F.col(f"_r.{c}").alias(c) for c in rows.columns if c not in (*keys, seq)), *([F.col(f"_r.{seq}").alias(seq)] if seq in old.columns else []))
        new = new.select(*old.columns)
        if on_conflict == "replace":
            old = old.join(new.select(*keys), keys, "left_anti")
        elif on_conflict == "ignore":
            new = new.join(old.select(*keys), keys, "left_anti")
        return self.db._put(self.name, old.select(*new.columns).unionByName(new))

    def _marked(self) -> tuple[DataFrame, str, list[str]]:
        """The table with a column that says which rows the condition meets, that column's name, and the table's own columns."""
        if not self._params:
            raise ValueError("a change needs a condition with a value")
        names = self.db.spark.table(self.name).columns
        hit = "_hit"
        while hit in names:
            hit += "_"
        return run(self.db.spark, f"select *, coalesce({self._where}, false) as {hit} from {self.name}", self._params), hit, names

    def update(self, values: dict[str, Any]) -> DataFrame:
        d, hit, names = self._marked()
        return self.db._put(self.name, d.withColumns({c: F.when(F.col(hit), F.lit(v)).otherwise(F.col(c)) for c, v in values.items()}).select(*names))

    def delete(self) -> DataFrame:
        d, hit, names = self._marked()
        return self.db._put(self.name, d.where(~F.col(hit)).select(*names))

    def explain(self) -> str:
        """The statement, its values, and the plan that Spark makes of it."""
        text, params = self.sql()
        return f"{text}\n{params}\n{self.df()._jdf.queryExecution().toString()}"


def sorted_page(df: DataFrame, keys: list[tuple[str, bool]], number: int, rows: int) -> DataFrame:
    """One page of rows by several keys ``(column, descending)``; nulls come first rising and last falling.

    A key may be a path into a struct (``a.b``); texts are compared as numbers where all of them are numbers.
    """
    texts = [k for k, _ in keys if df.select(k).schema[0].dataType.simpleString() == "string"]
    numeric = df.agg(*(F.every(F.col(k).isNull() | F.col(k).try_cast("double").isNotNull()).alias(f"c{i}") for i, k in enumerate(texts))).first() if texts else ()
    numbers = {k for k, ok in zip(texts, numeric) if ok}
    key = lambda k: F.col(k).try_cast("double") if k in numbers else F.col(k)
    order = [key(k).desc() if down else key(k).asc() for k, down in keys]
    return df.orderBy(*order).offset((max(1, number) - 1) * rows).limit(rows)


def page_count(df: DataFrame, rows: int) -> DataFrame:
    return df.agg(F.ceil(F.count("*") / rows).cast("long").alias("pages"))


def top_per_key(df: DataFrame, by: list[str], order: list, n: int) -> DataFrame:
    """The first ``n`` rows of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= n).drop("_n")
