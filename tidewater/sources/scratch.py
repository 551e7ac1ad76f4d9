"""Folders for intermediate tables, on storage that all machines share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_OWN: dict[str, str] = {}


def scratch_folder(spark: SparkSession) -> str:
    """A new path below ``spark.checkpoint.dir``; below a temporary folder only on one machine where none is set (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        base = _OWN.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="tidewater-folders-"))
    return f"{base.rstrip('/')}/tidewater-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
