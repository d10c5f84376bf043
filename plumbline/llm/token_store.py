"""Token-id files: ORC with integer run-length encoding, row indexes and Bloom filters on document ids.

Layout of a store: ORC files, each a range of document ids in ascending order. A row holds one
document: ``chunk`` (the range it was written with), ``seq`` (place in the range), ``doc_id``,
``local_start`` (ids before it in the range), ``n_tokens`` and ``tokens``. Readers take stripes in
parallel; a lookup by document id skips files and stripes by their statistics and Bloom filters.
A document's place in the whole corpus is its range's start plus ``local_start``; range starts come
from one small aggregate, so no task ever counts through the corpus.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import bounded_batches, partitions
from plumbline.llm.tokens import document_ids

SCHEMA = T.StructType(
    [
        T.StructField("chunk", T.IntegerType()),
        T.StructField("seq", T.LongType()),
        T.StructField("doc_id", T.LongType()),
        T.StructField("local_start", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("tokens", T.ArrayType(T.IntegerType())),
    ]
)
STRIPE_BYTES = 16 << 20
ROW_INDEX_STRIDE = 1_000


def write_store(docs: DataFrame, path: str, tokenizer_path: str) -> None:
    """Encodes every ``text`` and writes the ids, ranges of ``doc_id`` in ascending order.

    Null texts count as empty (one id, the end of a document); a null ``doc_id`` sorts first;
    equal ``doc_id`` values follow by text. Other columns are ignored. An empty table writes no rows.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ordered = ordered.repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    ordered = ordered.select(F.spark_partition_id().alias("chunk"), "doc_id", "text")

    def encode(batches):
        seq = start = 0
        for batch in batches:
            packed = document_ids(tokenizer_path, batch.column("text").to_pylist())
            sizes = np.array([len(x) // 4 for x in packed], "i8")
            ends = np.cumsum(sizes)
            tokens = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(np.frombuffer(b"".join(packed), "<i4"))
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column("chunk"), pa.array(np.arange(seq, seq + len(sizes))), batch.column("doc_id"), pa.array(start + ends - sizes), pa.array(sizes), tokens],
                names=SCHEMA.names,
            )
            seq, start = seq + len(sizes), start + int(ends[-1]) if len(ends) else start

    (
        ordered.mapInArrow(encode, SCHEMA)
        .write.option("compression", "none")  # the run-length encoding packs ids about as tightly
        .option("orc.stripe.size", STRIPE_BYTES)
        .option("orc.row.index.stride", ROW_INDEX_STRIDE)
        .option("orc.create.index", "true")
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .orc(path)
    )


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a store with ``start``, the ids of all documents before each one."""
    files = spark.read.schema(SCHEMA).orc(path)
    before = Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    ranges = files.groupBy("chunk").agg(F.sum("n_tokens").alias("n")).select("chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    # One row per range; a store has at most as many as the writing session had shuffle partitions.
    return files.join(F.broadcast(ranges), "chunk").withColumn("start", F.col("base") + F.col("local_start")).drop("base")


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The tokens of some documents; files, stripes and row groups without them are skipped."""
    return spark.read.schema(SCHEMA).orc(path).where(F.col("doc_id").isin(doc_ids)).select("doc_id", "tokens")


def checksums(store: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of the rows of ``read_store``, from the tokens as read."""

    def crc(batches):
        for batch in batches:
            tokens = batch.column("tokens")
            values, ends = tokens.values.to_numpy().astype("<u4", copy=False), tokens.offsets.to_numpy()
            sums = [zlib.crc32(values[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("start"), pa.array(np.diff(ends).astype("i8")), pa.array(sums, pa.int64())],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )

    return store.select("doc_id", "start", "tokens").mapInArrow(crc, "doc_id long, start long, n_tokens long, ids_crc32 long")
