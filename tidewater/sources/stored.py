"""Tables that outlive a session: Parquet folders beside a pointer to the one that counts.

A change writes a whole new version and then moves the pointer, in one rename that replaces it, so readers see the table
before or after it and a failed job leaves it as it was. Versions stay until :meth:`StoredTable.tidy`, so that plans made
on them can still run. One writer at a time is assumed.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class StoredTable:
    """A table in a folder. ``keys`` are unique and belong to the table; null keys are equal to each other."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._files = self._path(self.path).getFileSystem(self._conf)

    @classmethod
    def create(cls, rows: DataFrame, path: str, keys: list[str]) -> StoredTable:
        """A new table of rows whose keys must differ."""
        self = cls(rows.sparkSession, path)
        if self._files.exists(self._path(f"{self.path}/current")):
            raise ValueError(f"there is a table in {path}")
        if rows.groupBy(*keys).count().where("count > 1").first():
            raise ValueError("keys are not unique")
        self._put(rows, keys)
        return self

    def _pointer(self) -> tuple[str, list[str]]:
        lines = [r["value"] for r in self.spark.read.text(f"{self.path}/current", wholetext=True).collect()]
        version, *keys = lines[0].split("\n")
        return version, keys

    def _put(self, rows: DataFrame, keys: list[str]) -> None:
        """Write a version and make it the one that counts."""
        version = f"v-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{version}")
        fresh = self._path(f"{self.path}/next-{version}")
        out = self._files.create(fresh, False)
        out.write(bytearray("\n".join([version, *keys]).encode()))
        out.close()
        jvm = self.spark.sparkContext._jvm
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._files.getUri(), self._conf).rename(self._files.makeQualified(fresh), self._files.makeQualified(self._path(f"{self.path}/current")), options)

    @property
    def keys(self) -> list[str]:
        return self._pointer()[1]

    def df(self) -> DataFrame:
        """The rows of the version that counts now."""
        return self.spark.read.parquet(f"{self.path}/{self._pointer()[0]}")

    def insert(self, rows: DataFrame, on_conflict: str | None = None, seq: str | None = None) -> dict:
        """Insert a batch, in the order of ``seq``: ``inserted``, ``errors`` and ``error_details``.

        Of rows whose keys exist, ``replace`` takes the new (the last of the batch), ``ignore`` keeps the old (or the first of
        the batch); both count every row of the batch. Without a rule the first row whose keys exist, in the table or before
        it in the batch, is an error that ends the batch: the rows before it are inserted. Without ``seq`` the order of the
        batch is that of its partitions and of the rows in them.
        """
        if on_conflict not in (None, "replace", "ignore"):
            raise ValueError(f"unknown conflict rule {on_conflict!r}")
        keys, old = self.keys, self.df()
        names = old.columns
        if set(rows.columns) - {seq} - set(names) or set(names) - set(rows.columns):
            raise ValueError(f"columns differ: {rows.columns} for {names}")
        batch = rows.withColumn("_seq", F.col(seq) if seq else F.monotonically_increasing_id()).select(*names, "_seq")
        same = lambda a, b: [a[k].eqNullSafe(b[f"_{k}"]) for k in keys]
        named = lambda d: d.select(*(F.col(k).alias(f"_{k}") for k in keys))
        if on_conflict is None:
            held = named(old).withColumn("_held", F.lit(True))
            place = F.row_number().over(Window.partitionBy(*keys).orderBy("_seq"))
            marked = batch.withColumn("_nth", place).join(held, same(batch, held), "left")
            first = marked.where((F.col("_nth") > 1) | F.col("_held")).agg(F.min_by(F.struct(*keys), "_seq").alias("k"), F.min("_seq").alias("at")).first()
            good = batch if first["at"] is None else batch.where(F.col("_seq") < F.lit(first["at"]))
            count = good.count()
            if count:
                self._put(old.unionByName(good.drop("_seq")), keys)
            failed = [] if first["at"] is None else [{"error": f"keys exist: {first['k'].asDict()}"}]
            return {"inserted": count, "errors": len(failed), "error_details": failed}
        pick = F.max_by if on_conflict == "replace" else F.min_by
        new = batch.groupBy(*keys).agg(pick(F.struct(*names), "_seq").alias("_r")).select("_r.*")
        other = named(new if on_conflict == "replace" else old)
        if on_conflict == "replace":
            old = old.join(other, same(old, other), "left_anti")
        else:
            new = new.join(other, same(new, other), "left_anti")
        self._put(old.unionByName(new), keys)
        return {"inserted": batch.count(), "errors": 0, "error_details": []}

    def tidy(self) -> int:
        """Delete the versions that do not count any more; how many there were."""
        now, n = self._pointer()[0], 0
        for s in self._files.listStatus(self._path(self.path)):
            if s.isDirectory() and s.getPath().getName().startswith("v-") and s.getPath().getName() != now:
                n += bool(self._files.delete(s.getPath(), True))
        return n
