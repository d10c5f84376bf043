"""Helpers that the training-data operators share.

Intermediate tables go to the folder the session names in ``spark.checkpoint.dir``
(all executors and the driver see it); a temporary folder stands in only where the
setting is missing, as in tests on one machine.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch between the JVM and Python: bounds a worker's memory.
BATCH_ROWS = 1024
BATCH_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches small, so that very long texts cannot fill a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_folder(spark: SparkSession) -> str:
    """The shared folder of the session; where it is unset, one for a session on one machine, an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        at = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not at.isDefined() and not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = at.get() if at.isDefined() else "file://" + tempfile.mkdtemp(prefix="plumbline-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/plumbline/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, columns: list[str] | None = None) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    (df.select(*columns) if columns else df).write.parquet(path)
    out = spark.read.schema(df.select(*columns).schema if columns else df.schema).parquet(path)
    out._scratch = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes the files of a ``stored`` table that nothing reads any more."""
    path = getattr(df, "_scratch", None)
    if path:
        spark = df.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: The type of a row's key.
KEY = "struct<file: bigint, at: bigint>"


def unused(columns: list[str], name: str) -> str:
    """``name`` with underscores before it until no column has that name, in any case of letters."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def quoted(columns: list[str]) -> list[str]:
    """Names of columns as ``select`` takes them, whatever characters they hold."""
    return ["`" + c.replace("`", "``") + "`" for c in columns]


def _read_from_files(df: DataFrame) -> bool:
    """Whether each row is a row of a Parquet file: nothing but projections and filters lies between."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    return "parquet" in plan.simpleString(20) and plan.nodeName().startswith(("LogicalRelation", "Relation"))


def keyed(df: DataFrame, name: str) -> DataFrame:
    """Adds a key of its own to each row, the same whenever and by whomever the result is read.

    Rows of Parquet files are known by the hash of the file's path and their place in it, whatever the splits. Rows of any
    other source are numbered once, in a copy in the shared folder.
    """
    if _read_from_files(df):
        at = df.metadataColumn("_metadata")
        return df.withColumn(name, F.struct(F.xxhash64(at["file_path"]).alias("file"), at["row_index"].alias("at")))
    return stored(df.withColumn(name, F.struct(F.lit(0).cast("long").alias("file"), F.monotonically_increasing_id().alias("at"))), "keyed")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: A group with more than this share of all rows is joined by broadcast; fewer than 1 / HOT_SHARE groups can be that large.
HOT_SHARE = 0.001


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, n_rows: int) -> DataFrame:
    """Inner join of rows with their groups, one row per ``key`` with the group's ``size``, without skew.

    Rows of the few groups that hold more than ``HOT_SHARE`` of all rows meet them by broadcast; their
    number is bounded by 1 / HOT_SHARE, whatever the data. All others are too small to skew a shuffle.
    """
    hot = groups.where(F.col(size) > max(1, int(HOT_SHARE * n_rows)))
    values = [c for c in groups.columns if c != key]
    marked = rows.join(F.broadcast(hot.select(key, *(F.col(c).alias(f"hot_{c}") for c in values))), key, "left")
    is_hot = F.col(f"hot_{size}").isNotNull()
    done = marked.where(is_hot).select(*rows.columns, *(F.col(f"hot_{c}").alias(c) for c in values))
    rest = marked.where(~is_hot).select(*rows.columns).join(groups, key).select(*rows.columns, *values)
    return done.unionByName(rest)


#: Keys that are sent to all tasks (16 bytes each); more are joined by shuffle.
BROADCAST_KEYS = 1_000_000


def without(rows: DataFrame, dropped: DataFrame, key: str) -> DataFrame:
    """The rows whose ``key`` is not in ``dropped``, a stored table of that one column."""
    few = dropped.count() <= BROADCAST_KEYS
    return rows.join(F.broadcast(dropped) if few else dropped, key, "left_anti")
