"""Data behind report charts: reshaping in Spark, and a document of cells as JSON or HTML."""

from __future__ import annotations

import html
import json
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The names that k-line columns may have.
KLINE_NAMES = {
    "open": ["open", "开盘", "Open", "OPEN", "o", "O"],
    "close": ["close", "收盘", "Close", "CLOSE", "c", "C"],
    "low": ["low", "最低", "Low", "LOW", "l", "L"],
    "high": ["high", "最高", "High", "HIGH", "h", "H"],
}


def series(df: DataFrame, x: str, names: list[str] | None = None, keys: list[str] | None = None) -> DataFrame:
    """Wide columns as rows ``x, name, value``, beside the columns ``keys``."""
    keys = keys or []
    cols = names or [c for c in df.columns if c not in (x, *keys)]
    return df.select(*keys, F.col(x).alias("x"), *(F.col(c).cast("double").alias(c) for c in cols)).unpivot([*keys, "x"], cols, "name", "value")


def kline(df: DataFrame, x: str, keys: list[str] | None = None) -> DataFrame:
    """Rows ``x, ohlc`` with open, close, low and high in this order, beside the columns ``keys``."""
    pick = {k: [c for c in names if c in df.columns] for k, names in KLINE_NAMES.items()}
    if missing := [k for k, c in pick.items() if not c]:
        raise ValueError(f"no column for {missing}")
    return df.select(*(keys or []), F.col(x).alias("x"), F.array(*(F.col(pick[k][0]).cast("double") for k in KLINE_NAMES)).alias("ohlc"))


def heatmap(df: DataFrame, y: str, x: str, value: str) -> DataFrame:
    """Cells as ``xi, yi, value`` with places counted from 0 in sorted order."""
    places = lambda c: df.select(c).distinct().withColumn("_i", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(c)) - 1)  # noqa: E731  one row per label
    d = df.join(places(x).withColumnRenamed("_i", "xi"), x).join(places(y).withColumnRenamed("_i", "yi"), y)
    return d.select("xi", "yi", F.col(value).cast("double").alias("value"))


def color_scale(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Each value's place between the least and the largest of its group; 0.5 where these are equal."""
    w = Window.partitionBy(*by)
    lo, hi = F.min(value).over(w), F.max(value).over(w)
    return df.withColumn("scale", F.when(F.col(value).isNotNull(), F.coalesce(F.try_divide(F.col(value) - lo, hi - lo), F.lit(0.5))))


# The colours of a heat map from its least to its largest value.
HEAT_COLORS = ("#2196f3", "#fff", "#f44336")


def _channels(color: str) -> list[int]:
    digits = color.lstrip("#")
    digits = "".join(c * 2 for c in digits) if len(digits) == 3 else digits
    return [int(digits[i : i + 2], 16) for i in (0, 2, 4)]


def _stops(colors: tuple[str, ...]) -> list[list[int]]:
    if len(colors) not in (2, 3):
        raise ValueError("two or three colours are needed")
    return [_channels(c) for c in colors]


def blended(ratio: Column, colors: tuple[str, ...] = HEAT_COLORS) -> Column:
    """The colour between two or three stops at a ratio from 0 to 1, as ``#rrggbb``."""
    stops = _stops(colors)

    def between(a: list[int], b: list[int], at: Column) -> Column:
        parts = [F.lower(F.lpad(F.hex(F.floor(F.lit(x) + F.lit(y - x) * at + 0.5).cast("long")), 2, "0")) for x, y in zip(a, b)]
        return F.concat(F.lit("#"), *parts)

    if len(stops) == 2:
        return between(*stops, ratio)
    return F.when(ratio <= 0.5, between(stops[0], stops[1], ratio * 2)).otherwise(between(stops[1], stops[2], (ratio - 0.5) * 2))


def heat_colors(df: DataFrame, keys: list[str], columns: list[str], colors: tuple[str, ...] = HEAT_COLORS, axis: str = "column", groups: dict[str, str] | None = None, group_colors: dict[str, tuple[str, ...]] | None = None, skip: Column | None = None, page: list[str] | None = None) -> DataFrame:
    """Cells ``*keys, column, value, color``; null colours where a cell has none.

    The ends of a scale are the least and the largest value of a column (``axis="column"``), of all columns (``"table"``), or
    of the columns that ``groups`` puts together; on each page, if ``page`` names its keys. Rows that ``skip`` marks neither
    count nor are coloured. A scale without extent has its second colour.
    """
    if axis not in ("column", "table"):
        raise ValueError(f"unknown axis {axis!r}")
    page, groups, group_colors = page or [], groups or {}, group_colors or {}
    scale = {c: groups.get(c, c if axis == "column" else "") for c in columns}
    cells = df.withColumn("_skip", F.coalesce(skip, F.lit(False)) if skip is not None else F.lit(False))
    cells = cells.select(*keys, *(c for c in page if c not in keys), "_skip", F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.lit(scale[c]).alias("scale"), F.col(c).cast("double").alias("value")) for c in columns))).alias("_c"))
    cells = cells.select("*", "_c.*").drop("_c").withColumn("_v", F.when(~F.col("_skip") & ~F.isnan("value"), F.col("value")))
    ends = cells.groupBy(*page, "scale").agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))  # a row for each scale of a page
    d = cells.join(ends.select(*(F.col(c).alias(f"_{c}") for c in [*page, "scale"]), "_lo", "_hi"), [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in [*page, "scale"]]) if page else cells.join(ends, "scale")
    ratio = (F.col("_v") - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0))
    of = lambda cs: F.when(F.col("_v").isNull(), F.lit(None)).when(F.col("_lo") == F.col("_hi"), F.lit("#" + "".join(f"{x:02x}" for x in _stops(cs)[1]))).otherwise(blended(ratio, cs))
    color = of(colors)
    for g, cs in group_colors.items():
        color = F.when(F.col("scale") == g, of(cs)).otherwise(color)
    return d.select(*keys, "column", "value", color.alias("color"))


def visual_range(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Bounds of a colour scale: least and largest value of each group, widened to whole steps of 5, 0.5 or 0.01 by their distance."""
    g = df.groupBy(*by).agg(F.min(value).cast("double").alias("_lo"), F.max(value).cast("double").alias("_hi"))
    step = F.when(F.col("_hi") - F.col("_lo") >= 10, 5.0).when(F.col("_hi") - F.col("_lo") >= 1, 0.5).otherwise(0.01)
    g = g.withColumn("step", step)
    return g.select(*by, (F.floor(F.col("_lo") / F.col("step")) * F.col("step")).alias("low"), (F.ceil(F.col("_hi") / F.col("step")) * F.col("step")).alias("high"), "step")


def stack_percent(df: DataFrame, x: str, value: str) -> DataFrame:
    """Each value as a percentage of its ``x``'s total; 0 where the total is not positive."""
    total = F.sum(value).over(Window.partitionBy(x))
    return df.withColumn("percent", F.when(total > 0, 100 * F.col(value) / total).otherwise(0.0))


#: Builders of cells by kind.
CELL_KINDS: dict[str, Callable[..., dict]] = {}


def cell_kind(name: str) -> Callable:
    """Decorator: register a builder of cells, a function that returns their data."""

    def add(f: Callable[..., dict]) -> Callable[..., dict]:
        CELL_KINDS[name] = f
        return f

    return add


def account_report(title: str, metrics: DataFrame, daily: DataFrame, trips: DataFrame, days: int = 5000, trades: int = 100) -> Notebook:
    """An account's metrics (rows ``name, place, value``), its daily assets, and its most and least profitable round trips, as a document."""
    rows = metrics.orderBy("place").collect()  # a row for each metric
    doc = Notebook(title).metrics({r["name"]: r["value"] for r in rows})
    doc.section("Assets").chart("line", daily, "date", [c for c in daily.columns if c != "date"], days)
    return doc.section("Trades").table(trips.orderBy(F.desc("profit")), trades).table(trips.orderBy("profit"), trades)


class Notebook:
    """Titled sections of cells, written as JSON or as one HTML page.

    Cells hold small results: each has a bound, which may be ``None``. A cell whose data are longer says so: it has
    ``left_out``, the number of rows that it does not show.
    """

    def __init__(self, title: str):
        self.title, self.cells, self._at = title, [], None

    def section(self, title: str) -> Notebook:
        self._at = {"type": "section", "title": title, "cells": []}
        self.cells.append(self._at)
        return self

    def _add(self, kind: str, **data) -> Notebook:
        (self._at["cells"] if self._at else self.cells).append({"type": kind, **data})
        return self

    def markdown(self, text: str) -> Notebook:
        return self._add("markdown", text=text)

    def metrics(self, values: dict) -> Notebook:
        return self._add("metrics", items=[{"name": k, "value": v} for k, v in values.items()])

    @staticmethod
    def _rows(df: DataFrame, most: int | None) -> tuple[list, dict]:
        """The first rows, and how many were left out, if any."""
        if most is None:
            return df.collect(), {}
        got = df.limit(most + 1).collect()
        return got[:most], {"left_out": df.count() - most} if len(got) > most else {}

    def table(self, df: DataFrame, rows: int | None = 1000) -> Notebook:
        """The first rows, in the order that ``df`` has."""
        got, more = self._rows(df, rows)
        return self._add("table", columns=df.columns, rows=[list(r) for r in got], **more)

    def chart(self, kind: str, df: DataFrame, x: str, names: list[str] | None = None, points: int | None = 10_000) -> Notebook:
        """Columns over ``x``; where there are more points than it may hold, the latest."""
        cols = names or [c for c in df.columns if c != x]
        got, more = self._rows(df.select(x, *cols).orderBy(F.desc(x)), points)
        got = got[::-1]
        return self._add(kind, xAxis=[str(r[0]) for r in got], series=[{"name": c, "data": [r[i + 1] for r in got]} for i, c in enumerate(cols)], **more)

    def pie(self, df: DataFrame, name: str, value: str, slices: int | None = 100) -> Notebook:
        """Values by name, the largest first; what is left out is one more slice, ``other``."""
        d = df.select(name, value)
        got, more = self._rows(d.orderBy(F.desc_nulls_last(value), name), slices)
        data = [{"name": r[0], "value": r[1]} for r in got]
        if more:
            rest = d.agg(F.sum(value)).first()[0] - sum(r[1] for r in got if r[1] is not None)
            data.append({"name": "other", "value": rest})
        return self._add("pie", data=data, **more)

    def scatter(self, df: DataFrame, x: str, names: list[str], points: int | None = 10_000) -> Notebook:
        """Points ``[x, y]`` of each named column, by ``x``; where there are too many, the latest."""
        got, more = self._rows(df.select(x, *names).orderBy(F.desc(x)), points)
        got = got[::-1]
        return self._add("scatter", **more, xAxis=[], series=[{"name": c, "data": [[r[0], r[i + 1]] for r in got if r[i + 1] is not None]} for i, c in enumerate(names)])

    def grid(self, charts: list[dict], heights: list[float] | None = None) -> Notebook:
        """Several charts above each other; heights are shares of the whole, equal ones by default."""
        heights = heights or [1.0] * len(charts)
        if len(heights) != len(charts):
            raise ValueError("a height for each chart is needed")
        total = sum(heights)
        return self._add("grid", charts=[{**c, "height": f"{100 * h / total:.4g}%"} for c, h in zip(charts, heights)])

    def cell(self, kind: str, **data) -> Notebook:
        """A cell of a kind registered with :func:`cell_kind`, made by its builder, or of any kind with the data as they are."""
        return self._add(kind, **(CELL_KINDS[kind](**data) if kind in CELL_KINDS else data))

    def to_dict(self) -> dict:
        return {"title": self.title, "cells": self.cells}

    def to_json(self) -> str:
        return json.dumps(self.to_dict(), default=str, ensure_ascii=False)

    def export_html(self, path: str) -> None:
        """One page without scripts: tables, and charts drawn as lines or bars; the document itself is in it as JSON."""
        data = self.to_json().replace("</", "<\\/")
        body = "".join(_drawn(c) for c in self.cells)
        Path(path).write_text(f"<!doctype html><meta charset=utf-8><title>{html.escape(self.title)}</title><style>{_STYLE}</style><h1>{html.escape(self.title)}</h1>{body}<script type=application/json id=data>{data}</script>")


_STYLE = "body{font:14px sans-serif;margin:2em}table{border-collapse:collapse}td,th{padding:2px 8px;border-bottom:1px solid #ddd;text-align:right}svg{background:#fafafa}"
_LINES = ("#1f77b4", "#d62728", "#2ca02c", "#9467bd", "#ff7f0e", "#17becf")


def _said(v: object) -> str:
    return "" if v is None else f"{v:,.6g}" if isinstance(v, float) else html.escape(str(v))


def _table(columns: list, rows: list) -> str:
    head = "".join(f"<th>{_said(c)}" for c in columns)
    return f"<table><tr>{head}" + "".join("<tr>" + "".join(f"<td>{_said(v)}" for v in r) for r in rows) + "</table>"


def _chart(cell: dict, width: int = 800, height: int = 240) -> str:
    """Series over their places, as lines, or as bars of the first one."""
    known = [v for s in cell["series"] for v in s["data"] if isinstance(v, (int, float)) and v == v]
    if not known:
        return "<p>no values</p>"
    low, high = min(known), max(known)
    n = max(len(s["data"]) for s in cell["series"])
    x = lambda i: width * (i + 0.5) / n
    y = lambda v: height - 10 - (height - 20) * ((v - low) / (high - low) if high > low else 0.5)
    drawn = []
    for s, color in zip(cell["series"], _LINES * len(cell["series"])):
        points = [(x(i), y(v)) for i, v in enumerate(s["data"]) if isinstance(v, (int, float)) and v == v]
        if cell["type"] == "bar":
            zero = y(min(max(0.0, low), high))
            drawn += [f'<rect x="{a - width / n * 0.4:.1f}" y="{min(b, zero):.1f}" width="{width / n * 0.8:.1f}" height="{abs(b - zero):.1f}" fill="{color}"/>' for a, b in points]
        else:
            drawn.append(f'<polyline fill="none" stroke="{color}" points="{" ".join(f"{a:.1f},{b:.1f}" for a, b in points)}"/>')
    names = ", ".join(f'<span style="color:{c}">{_said(s["name"])}</span>' for s, c in zip(cell["series"], _LINES * len(cell["series"])))
    ends = f"{_said(cell['xAxis'][0])} to {_said(cell['xAxis'][-1])}" if cell.get("xAxis") else ""
    return f'<p>{names}; {_said(float(low))} to {_said(float(high))}; {ends}</p><svg viewBox="0 0 {width} {height}" width="{width}">{"".join(drawn)}</svg>'


def _drawn(cell: dict) -> str:
    """A cell as HTML; kinds without a drawing of their own are shown as their data."""
    kind = cell["type"]
    if kind == "section":
        return f"<h2>{_said(cell['title'])}</h2>" + "".join(_drawn(c) for c in cell["cells"])
    if kind == "markdown":
        out = f"<p>{_said(cell['text'])}</p>"
    elif kind == "metrics":
        out = _table(["name", "value"], [(m["name"], m["value"]) for m in cell["items"]])
    elif kind == "table":
        out = _table(cell["columns"], cell["rows"])
    elif kind == "pie":
        out = _table(["name", "value"], [(p["name"], p["value"]) for p in cell["data"]])
    elif kind in ("line", "bar", "area"):
        out = _chart(cell)
    else:
        out = f"<pre>{html.escape(json.dumps(cell, default=str, ensure_ascii=False))}</pre>"
    return out + (f"<p>{cell['left_out']} more are not shown</p>" if cell.get("left_out") else "")
