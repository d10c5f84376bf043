"""Times the engine at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

First the indexes are built and one query runs unmeasured, so that no figure holds the start of the session; then each
query is run ``$BENCH_REPEATS`` times (once by default) and the median counts. With ``BENCH_FULL=1`` the metrics of a full index, a small
change of it and a single search follow, which work on documents through ``Bank``.
"""

import json
import os
import statistics
import tempfile
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from plumbline import queries
from plumbline.config import EngineConfig
from plumbline.plans.bank import Bank

SF_DIR, CPUS = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
HEADLINE = ["knn_batch", "bm25_and", "rrf_fusion", "hybrid_search", "banks_merged", "mmr_rerank", "window_context", "chunk_documents", "diff_changes", "index_stats", "log_savings", "join_three_tables"]
REPEATS = int(os.environ.get("BENCH_REPEATS", "1"))


def timed(work) -> float:
    start = time.time()
    work()
    return time.time() - start


def median(work) -> float:
    return round(statistics.median(timed(work) for _ in range(REPEATS)), 3)


def run(frame) -> None:
    frame.write.format("noop").mode("overwrite").save()


def indexing(spark: SparkSession) -> dict[str, float]:
    """A full index of all documents, an index of one changed in a hundred, and one search in a warm session."""
    docs = queries.docs(spark, SF_DIR).select("path", "content", "id")
    bank = Bank(spark, tempfile.mkdtemp(prefix="bench-") + "/bank", EngineConfig(embedding_dim=64))
    n = docs.count()
    full = timed(lambda: bank.index_documents(docs.drop("id")))
    changed = docs.where("id % 100 = 0").withColumn("content", F.concat("content", F.lit(" changed")))
    small = timed(lambda: bank.index_documents(changed.drop("id")))
    chunks = bank.table("chunks").count()
    search = lambda: bank.search(["the heed thing"], 5).collect()
    search()
    return {
        "full_index_seconds": round(full, 3), "full_index_docs_per_second": round(n / full, 1), "full_index_chunks_per_second": round(chunks / full, 1),
        "reindex_one_percent_seconds": round(small, 3), "single_search_ms": round(1000 * median(search), 1),
    }


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench").config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    built = round(timed(lambda: queries.text_index(spark, SF_DIR)), 3)
    for part in ("id IS NOT NULL", "id % 2 = 0", "id % 2 = 1"):
        queries.chunk_index(spark, SF_DIR, part)
    run(queries.QUERIES["knn_batch"](spark, SF_DIR))
    took = {name: median(lambda name=name: run(queries.QUERIES[name](spark, SF_DIR))) for name in HEADLINE}
    asked = {"knn_batch": queries._vectors(spark, SF_DIR)[1].count(), "bm25_and": len(queries.AND_QUERIES), "hybrid_search": len(queries.AND_QUERIES)}
    more = {f"{name}_per_second": round(n / took[name], 2) for name, n in asked.items()}
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": SF_DIR.rsplit("/", 1)[-1], "index_words_seconds": built, **more, **(indexing(spark) if os.environ.get("BENCH_FULL") else {})}))


if __name__ == "__main__":
    main()
