"""Rows of JSON documents as tables: files, folders, or texts; nested fields are reached by dotted names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def json_table(spark: SparkSession, source: str | list[str], schema: str | None = None, filters: dict | None = None) -> DataFrame:
    """Rows of JSON: of a path (documents that are an object or an array of objects), or of texts with a schema.

    ``filters`` maps columns to values; empty ones (``None`` and ``""``) are left out, as a search form leaves them.
    """
    if isinstance(source, str):
        reader = spark.read.option("multiLine", True)
        d = (reader.schema(schema) if schema else reader).json(source)
    else:
        if not schema:
            raise ValueError("texts need a schema")
        texts = spark.createDataFrame([(t,) for t in source], "value string")
        d = texts.select(F.from_json("value", schema).alias("r")).select("r.*")
    for c, v in (filters or {}).items():
        if v not in (None, ""):
            d = d.where(nested(c) == v)
    return d


def nested(path: str) -> Column:
    """A column by a dotted path; null where a part of it is."""
    return F.col(".".join(f"`{p.strip('`')}`" for p in path.split(".")))


def page_of(d: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The columns to show: those asked for, by dotted names, or all there are."""
    return d.select(*(nested(c).alias(c.replace(".", "_")) for c in columns)) if columns else d


def documents(df: DataFrame, text: str, out: str = "doc") -> DataFrame:
    """Texts of JSON of any shape as a variant column; null where a text is no JSON."""
    return df.withColumn(out, F.try_parse_json(text))


def picked(df: DataFrame, doc: str, fields: dict[str, tuple[str, str]]) -> DataFrame:
    """Columns of a variant: name to path (``$.a.b[0]``) and type; null where a document lacks the path or holds another type there."""
    return df.withColumns({n: F.try_variant_get(doc, path, kind) for n, (path, kind) in fields.items()})


def by_date_keys(df: DataFrame, keys: list[str], doc: str, fields: dict[str, tuple[str, str]]) -> DataFrame:
    """Rows ``*keys, date, fields`` of documents whose keys are dates: one for each key; keys that are no date are left out.

    Documents that are not objects give no rows.
    """
    spark = df.sparkSession
    pairs = df.lateralJoin(spark.tvf.variant_explode(F.col(doc).outer()))
    d = pairs.where(F.col("key").isNotNull()).withColumn("date", F.col("key").try_cast("date")).where("date is not null")
    return picked(d, "value", {f"_{n}": f for n, f in fields.items()}).select(*keys, "date", *(F.col(f"_{n}").alias(n) for n in fields))
