"""A library of factor versions as a table: one row for each name and version."""

from __future__ import annotations

import json
from datetime import datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "factor_name string, version string, category string, description string, author string, status string, tags array<string>, created_at timestamp, updated_at timestamp"
STATUSES = ("draft", "testing", "active", "deprecated")


def _version_key(version: str):
    """Versions compare number by number, so 1.0.10 is after 1.0.9."""
    return F.transform(F.split(version, r"\."), lambda p: F.coalesce(p.try_cast("int"), F.lit(-1)))


class FactorLibrary:
    def __init__(self, spark: SparkSession, entries: DataFrame | None = None):
        self.spark = spark
        self.entries = entries if entries is not None else spark.createDataFrame([], SCHEMA)

    def register(self, name: str, version: str | None = None, *, category: str = "custom", description: str = "", author: str = "", tags: list[str] | None = None, status: str = "draft", at: datetime | None = None, overwrite: bool = False) -> str:
        """Add a version; without one, the patch number after the latest."""
        if version is None:
            last = self.latest().where(F.col("factor_name") == name).first()
            parts = [int(x) for x in last["version"].split(".")] if last else [1, 0, -1]
            version = ".".join(map(str, [*parts[:-1], parts[-1] + 1]))
        same = (F.col("factor_name") == name) & (F.col("version") == version)
        if not overwrite and self.entries.where(same).first():
            raise ValueError(f"{name} {version} exists")
        at = at or datetime.now()
        row = self.spark.createDataFrame([(name, version, category, description, author, status, tags or [], at, at)], SCHEMA)
        self.entries = self.entries.where(~same).unionByName(row)
        return version

    def latest(self) -> DataFrame:
        w = Window.partitionBy("factor_name").orderBy(_version_key("version").desc())
        return self.entries.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")

    def get(self, name: str, version: str | None = None) -> dict | None:
        d = self.latest() if version is None else self.entries.where(F.col("version") == version)
        r = d.where(F.col("factor_name") == name).first()
        return r.asDict() if r else None

    def list(self, tags: list[str] | None = None, category: str | None = None, status: str | None = None) -> DataFrame:
        """Latest versions that have any of the tags, the category and the status asked for."""
        d = self.latest()
        if tags:
            d = d.where(F.arrays_overlap("tags", F.array(*map(F.lit, tags))))
        if category:
            d = d.where(F.col("category") == category)
        return d.where(F.col("status") == status) if status else d

    def search(self, text: str, fields: tuple[str, ...] = ("factor_name", "description", "tags")) -> DataFrame:
        """Latest versions in which any of the fields holds the text, without regard to case."""
        q, hit = text.lower(), F.lit(False)
        for f in fields:
            hit |= F.exists("tags", lambda t: F.lower(t).contains(q)) if f == "tags" else F.coalesce(F.lower(f).contains(q), F.lit(False))
        return self.latest().where(hit)

    def set_status(self, name: str, status: str, version: str | None = None) -> None:
        if status not in STATUSES:
            raise ValueError(f"unknown status {status!r}")
        hit = (F.col("factor_name") == name) & (F.lit(True) if version is None else F.col("version") == version)
        self.entries = self.entries.withColumn("status", F.when(hit, status).otherwise(F.col("status")))

    def add_tags(self, name: str, tags: list[str]) -> None:
        self.entries = self.entries.withColumn("tags", F.when(F.col("factor_name") == name, F.array_union("tags", F.array(*map(F.lit, tags)))).otherwise(F.col("tags")))

    def remove_tags(self, name: str, tags: list[str]) -> None:
        self.entries = self.entries.withColumn("tags", F.when(F.col("factor_name") == name, F.array_except("tags", F.array(*map(F.lit, tags)))).otherwise(F.col("tags")))

    def delete(self, name: str, version: str | None = None) -> None:
        hit = (F.col("factor_name") == name) & (F.lit(True) if version is None else F.col("version") == version)
        self.entries = self.entries.where(~hit)

    def statistics(self) -> DataFrame:
        """Numbers by category (latest versions), status and author (all versions): grouping sets over one pass."""
        w = Window.partitionBy("factor_name").orderBy(_version_key("version").desc())
        kinds = ["category", "status", "author"]
        d = self.entries.select("category", "status", "author", (F.row_number().over(w) == 1).cast("long").alias("_new"))
        # The bits of grouping_id say which of the columns a row is not grouped by.
        g = d.groupingSets([["category"], ["status"], ["author"]], *kinds).agg(F.grouping_id().alias("_g"), F.count("*").alias("_all"), F.sum("_new").alias("_new"))
        at = {0b011: "category", 0b101: "status", 0b110: "author"}
        pick = lambda f: F.coalesce(*(F.when(F.col("_g") == k, f(c)) for k, c in at.items()))
        return g.select(pick(F.lit).alias("kind"), pick(F.col).alias("value"), F.when(F.col("_g") == 0b011, F.col("_new")).otherwise(F.col("_all")).alias("n")).where("n > 0")

    def save(self, path: str) -> None:
        rows = [r.asDict() for r in self.entries.orderBy("factor_name", "version").collect()]
        Path(path).write_text(json.dumps(rows, default=lambda x: x.isoformat(), ensure_ascii=False, indent=1))

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> FactorLibrary:
        rows = json.loads(Path(path).read_text())
        for r in rows:
            for k in ("created_at", "updated_at"):
                r[k] = datetime.fromisoformat(r[k])
        return cls(spark, spark.createDataFrame([tuple(r[k.split()[0]] for k in SCHEMA.split(", ")) for r in rows], SCHEMA))

    def export_factor(self, name: str, path: str, version: str | None = None) -> None:
        r = self.get(name, version)
        if r is None:
            raise ValueError(f"unknown factor {name!r}")
        Path(path).write_text(json.dumps(r, default=lambda x: x.isoformat(), ensure_ascii=False))

    def import_factor(self, path: str, overwrite: bool = False) -> str:
        r = json.loads(Path(path).read_text())
        return self.register(r["factor_name"], r["version"], category=r["category"], description=r["description"], author=r["author"], tags=r["tags"], status=r["status"], at=datetime.fromisoformat(r["created_at"]), overwrite=overwrite)
