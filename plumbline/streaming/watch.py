"""Watching folders: a stream of ticks, each of which indexes the files that have changed.

File streams of Spark never report a file again after it was changed, so the stream carries time alone. At each tick the
executors list the folders; a join with the listing of the tick before says which files came, went or changed. Listings
are kept by batch beside the index: after a stop, or a crash in the middle of a batch, the stream goes on from the last
listing whose changes have been indexed, so it loses no change, and what it repeats the stored hashes turn into nothing. Ticks
that come while one is at work fall together, which is what debouncing is for.
"""

from __future__ import annotations

import logging
from collections.abc import Callable
from functools import reduce

import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from plumbline.plans.bank import LOG, Bank, Report
from plumbline.sources import files
from plumbline.storage import delete, discard, stored

DEBOUNCE_MS = 500
LISTING = "root string, path string, modified long, file_size long"
logger = logging.getLogger(__name__)


def listing(spark: SparkSession, roots: list[str], recursive: bool = True) -> DataFrame:
    """``root, path, modified, file_size`` of each Markdown file below the roots."""
    found = [files.scan(spark, r, recursive, content=False).select(F.lit(r).alias("root"), "path", "modified", "file_size") for r in roots]
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], LISTING)


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """``root, path, kind`` (added, modified, removed) of the files that two listings don't show alike."""
    old = before.select("root", "path", F.struct("modified", "file_size").alias("old"))
    new = after.select("root", "path", F.struct("modified", "file_size").alias("new"))
    kind = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "modified")
    return old.join(new, ["root", "path"], "full").select("root", "path", kind.alias("kind")).where("kind IS NOT NULL")


class Watcher:
    """What a tick does, and the listings that it is measured by."""

    def __init__(self, bank: Bank, roots: list[str], recursive: bool = True, on_report: Callable[[Report], None] = lambda _: None):
        self.bank, self.roots, self.recursive, self.on_report = bank, roots, recursive, on_report
        self.folder = f"watch/{xxhash.xxh64_hexdigest(chr(0).join(roots))}"

    def _numbers(self) -> list[int]:
        fs, at = self.bank._fs(), self.bank._path(self.folder)
        names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        # Only whole listings count.
        return sorted(int(n) for n in names if fs.exists(self.bank._path(f"{self.folder}/{n}/_SUCCESS")))

    def last(self) -> DataFrame:
        """The last listing whose changes have been indexed."""
        numbers = self._numbers()
        spark = self.bank.spark
        return spark.read.schema(LISTING).parquet(f"{self.bank.root}/{self.folder}/{numbers[-1]}") if numbers else spark.createDataFrame([], LISTING)

    def tick(self) -> dict[str, int]:
        """Indexes what has changed since the last listing and keeps the new one; gives the number of changes of each root.

        A root that can't be indexed now, as another writes or its folder can't be read, keeps its old listing and is tried again.
        """
        now, before = stored(listing(self.bank.spark, self.roots, self.recursive), "listing"), self.last()
        events = stored(changes(before, now), "events")
        counts = {r["root"]: r["count"] for r in events.groupBy("root").count().collect()}
        failed = []
        for root in counts:
            its = events.where(F.col("root") == root)
            try:
                there = files.read_files(self.bank.spark, its.where("kind <> 'removed'").select("path"), self.bank.config.max_file_size)
                self.on_report(self.bank.apply(there, its.where("kind = 'removed'").select("path")))
            except Exception as e:  # noqa: BLE001  the stream goes on
                logger.warning("%s could not be indexed and is tried again: %s", root, e)
                failed.append(root)
        if counts or not self._numbers():
            again = F.col("root").isin(failed)
            kept = now.where(~again).unionByName(before.where(again)) if failed else now
            number = (self._numbers() or [0])[-1] + 1
            delete(self.bank.spark, f"{self.bank.root}/{self.folder}/{number}")  # of a tick that was cut off
            kept.write.parquet(f"{self.bank.root}/{self.folder}/{number}")
            for old in self._numbers()[:-1]:
                delete(self.bank.spark, f"{self.bank.root}/{self.folder}/{old}")
        discard(now)
        discard(events)
        return counts


def watch(bank: Bank, roots: list[str], recursive: bool = True, on_report: Callable[[Report], None] = lambda _: None, debounce_ms: int = DEBOUNCE_MS, checkpoint: str | None = None) -> StreamingQuery:
    """Indexes what the roots hold that the index has not seen, then keeps them indexed until the query is stopped."""
    watcher = Watcher(bank, roots, recursive, on_report)
    watcher.tick()
    ticks = bank.spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).load()
    writer = ticks.writeStream.trigger(processingTime=f"{debounce_ms} milliseconds").foreachBatch(lambda *_: watcher.tick() and None)
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()


def log_counts(log_path: str, spark, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Searches by source and hour over a stream of log files."""
    rows = spark.readStream.schema(LOG).parquet(log_path).withColumn("at", F.timestamp_seconds("ts"))
    return rows.withWatermark("at", late).groupBy(F.window("at", window), "source").agg(F.count(F.lit(1)).alias("searches"), F.sum("result_bytes").alias("delivered_bytes"))
