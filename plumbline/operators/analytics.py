"""Statistics of an index and summaries of the query log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import bytes_to_tokens

#: Dollars for a million tokens.
PRICE, SOURCES = 5.0, ("cli", "mcp")


def stats(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: counts, documents without chunks, total size, time of the last indexing."""
    empty = documents.join(chunks.select(F.col("document_id").alias("id")).distinct(), "id", "left_anti").agg(F.count(F.lit(1)).alias("empty_documents"))
    per = documents.agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("file_size"), F.lit(0)).alias("total_bytes"), F.max("indexed_at").alias("last_indexed_at"))
    return per.crossJoin(chunks.agg(F.count(F.lit(1)).alias("chunks"))).crossJoin(empty).withColumn("chunks_per_document", F.when(F.col("documents") > 0, F.round(F.col("chunks") / F.col("documents"), 1)))


def savings(log: DataFrame) -> DataFrame:
    """A row for all searches (source null) and one per known source; unknown sources count in the total only."""
    sums = [F.count(F.lit(1)).alias("searches"), F.coalesce(F.sum("result_bytes"), F.lit(0)).alias("delivered_bytes"), F.coalesce(F.sum("baseline_bytes"), F.lit(0)).alias("baseline_bytes"), F.min("ts").alias("since")]
    per = log.where(F.col("source").isin(*SOURCES)).groupBy("source").agg(*sums)
    return log.agg(*sums).withColumn("source", F.lit(None).cast("string")).unionByName(per)


def costs(totals: DataFrame) -> DataFrame:
    """Tokens, tokens saved, their multiple and dollars, from ``delivered_bytes`` and ``baseline_bytes``."""
    out = totals.withColumn("delivered_tokens", bytes_to_tokens(F.col("delivered_bytes"))).withColumn("baseline_tokens", bytes_to_tokens(F.col("baseline_bytes")))
    out = out.withColumn("saved_tokens", F.greatest(F.col("baseline_tokens") - F.col("delivered_tokens"), F.lit(0)))
    out = out.withColumn("multiplier", F.when(F.col("delivered_tokens") > 0, F.col("baseline_tokens") / F.col("delivered_tokens")).otherwise(F.lit(0.0)))
    return out.withColumns({f"{c}_dollars": F.col(f"{c}_tokens") * PRICE / 1e6 for c in ("delivered", "baseline", "saved")})


def recent(log: DataFrame, limit: int) -> DataFrame:
    """The newest searches; unknown sources show as ``cli``."""
    shown = F.when(F.col("source").isin(*SOURCES), F.col("source")).otherwise("cli")
    return log.orderBy(F.desc("ts"), F.desc("id")).limit(limit).withColumn("source", shown)


def measured(hits: DataFrame, documents: DataFrame) -> DataFrame:
    """One row: bytes of the results, how many files they come from, and what reading those whole would take."""
    results = hits.agg(F.coalesce(F.sum(F.octet_length("content")), F.lit(0)).alias("result_bytes"))
    files = hits.select(F.col("file_path").alias("path")).distinct().join(documents.select("path", "file_size"), "path", "left").agg(F.count(F.lit(1)).alias("n_paths"), F.coalesce(F.sum("file_size"), F.lit(0)).alias("baseline_bytes"))
    return results.crossJoin(files)
