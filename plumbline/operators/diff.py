"""What has changed between a set of documents and an index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def changes(incoming: DataFrame, stored: DataFrame, force: bool = False) -> DataFrame:
    """``path, status``: added, modified, unchanged or error, of rows with ``path, content_hash`` and perhaps ``error``."""
    old = stored.select("path", F.col("content_hash").alias("old_hash"))
    error = F.col("error") if "error" in incoming.columns else F.lit(None).cast("string")
    status = F.when(error.isNotNull(), "error").when(F.col("old_hash").isNull(), "added").when(F.lit(force) | (F.col("old_hash") != F.col("content_hash")), "modified").otherwise("unchanged")
    return incoming.withColumn("_error", error).join(old, "path", "left").withColumn("status", status).drop("old_hash", "_error")


def vanished(stored: DataFrame, present: DataFrame) -> DataFrame:
    """Stored paths that are present no more."""
    return stored.select("path").join(present.select("path"), "path", "left_anti")


def report(changed: DataFrame) -> DataFrame:
    return changed.groupBy("status").agg(F.count(F.lit(1)).alias("files"))
