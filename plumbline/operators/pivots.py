"""A stored index of vectors for exact nearest neighbours: partitions around pivots, skipped by the triangle inequality.

Each vector, at unit length, lies in the partition of the pivot nearest to it, a folder of its own, with its distance to the
pivot. A query's distance to a pivot bounds its distance to all vectors there: they are at least as far from it as the
query's distance and theirs differ. A search first reads the partitions nearest to each query, which gives a
distance that its k-th neighbour does not exceed, and then only those partitions, and in them only those vectors, that may lie within.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.errors import ConfigError
from plumbline.operators.retrieval import FOUND, PASS_FLOATS
from plumbline.storage import scratch

#: Pivots of an index, and the vectors they are taken from: the first by a hash of the id.
PIVOTS, SAMPLE = 64, 4096
VECTORS = "id long, embedding array<double>, away double, pivot int"
#: What distances may be off by for rounding.
SLACK = 1e-7


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)


def farthest_first(x: np.ndarray, n: int) -> np.ndarray:
    """Rows that lie far from each other: each is the one farthest from those before it."""
    chosen = [0]
    near = np.linalg.norm(x - x[0], axis=1)
    while len(chosen) < min(n, len(x)) and near.max() > SLACK:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, np.linalg.norm(x - x[chosen[-1]], axis=1))
    return x[chosen]


@dataclass
class VectorIndex:
    """``vectors`` (``VECTORS``) in partitions, the ``pivots``, and of each partition the rows and the least and greatest distance from its pivot."""

    vectors: DataFrame
    pivots: np.ndarray
    shapes: dict[int, tuple[int, float, float]]

    @staticmethod
    def build(vectors: DataFrame, path: str, pivots: int = PIVOTS) -> VectorIndex:
        """Writes the index of ``vectors`` (id, embedding) to a folder and gives it.

        Rows without an id or a vector, and vectors of no length, are passed over; vectors of different lengths are an error.
        """
        spark = vectors.sparkSession
        usable = vectors.where("id IS NOT NULL AND size(embedding) > 0").select(F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))
        usable = usable.where(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x) > 0)
        widths = usable.agg(F.min(F.size("embedding")).alias("least"), F.max(F.size("embedding")).alias("most")).first()
        if widths["least"] != widths["most"]:
            raise ConfigError("the vectors differ in length")
        sample = usable.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()
        width = widths["most"] or 1
        at = farthest_first(_unit(np.array([r["embedding"] for r in sample], float).reshape(-1, width)), pivots) if sample else np.zeros((0, width))
        shared = spark.sparkContext.broadcast(at)

        def assign(batches):
            for batch in batches:
                if len(batch):
                    x = _unit(_matrix(batch.column("embedding"), width))
                    away = np.sqrt(np.maximum(0, 2 - 2 * (x @ shared.value.T)))
                    nearest = away.argmin(axis=1)
                    yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("embedding"), pa.array(away[np.arange(len(x)), nearest]), pa.array(nearest.astype("i4"))], names=["id", "embedding", "away", "pivot"])

        dealt = usable.mapInArrow(assign, VECTORS)
        # A partition that holds a large share of all rows is written by several tasks.
        dealt.repartition("pivot", F.pmod(F.xxhash64("id"), F.lit(4))).sortWithinPartitions("pivot", "away").write.partitionBy("pivot").parquet(f"{path}/vectors")
        spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(at)], "pivot int, place array<double>").coalesce(1).write.parquet(f"{path}/pivots")
        return VectorIndex.read(spark, path)

    @staticmethod
    def read(spark: SparkSession, path: str) -> VectorIndex:
        vectors = spark.read.schema(VECTORS).parquet(f"{path}/vectors")
        shapes = vectors.groupBy("pivot").agg(F.count(F.lit(1)).alias("n"), F.min("away").alias("least"), F.max("away").alias("most")).collect()
        places = spark.read.parquet(f"{path}/pivots").orderBy("pivot").collect()
        width = len(places[0]["place"]) if places else 0
        return VectorIndex(vectors, np.array([r["place"] for r in places], float).reshape(len(places), width), {r["pivot"]: (r["n"], r["least"], r["most"]) for r in shapes})

    def _scan(self, ids: np.ndarray, q: np.ndarray, wanted: np.ndarray, reach: np.ndarray, away: np.ndarray, k: int, counted) -> DataFrame:
        """The ``k`` best of each task for each query among the rows of its ``wanted`` (queries x pivots) partitions that lie within its ``reach``."""
        spark = self.vectors.sparkSession
        shared = spark.sparkContext.broadcast((ids, q, wanted, reach, away))
        width = q.shape[1]

        def best(batches):
            ids, q, wanted, reach, away = shared.value
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            held_ids, held = np.full((len(q), k), -1, "i8"), np.full((len(q), k), np.inf)
            for batch in batches:
                pivots, rows, far = (batch.column(c).to_numpy() for c in ("pivot", "id", "away"))
                x = _unit(_matrix(batch.column("embedding"), width))
                for p in np.unique(pivots):
                    here = pivots == p
                    for i in np.flatnonzero(wanted[:, p]):
                        at = np.flatnonzero(here & (np.abs(far - away[i, p]) <= reach[i] + SLACK))
                        counted.add(len(at))
                        distance = np.concatenate([held[i], 1 - x[at] @ q[i]])
                        its = np.concatenate([held_ids[i], rows[at]])
                        order = np.lexsort((its, distance))[:k]
                        held_ids[i], held[i] = its[order], distance[order]
            some = held < np.inf
            out.append((np.repeat(ids, some.sum(axis=1)), held_ids[some], held[some]))
            for its_query, its, distance in out:
                yield pa.RecordBatch.from_arrays([pa.array(its_query), pa.array(its), pa.array(distance)], names=["query_id", "id", "distance"])

        asked = np.flatnonzero(wanted.any(axis=0)).tolist()
        return self.vectors.where(F.col("pivot").isin(asked)).mapInArrow(best, FOUND)

    def _probed(self, away: np.ndarray, k: int) -> np.ndarray:
        """The partitions nearest to each query that hold ``k`` rows together."""
        sizes = np.array([self.shapes.get(p, (0, 0, 0))[0] for p in range(len(self.pivots))])
        order = np.argsort(away, axis=1)
        before = np.cumsum(sizes[order], axis=1) - sizes[order]
        out = np.zeros(away.shape, bool)
        np.put_along_axis(out, order, before < k, axis=1)
        return out & (sizes > 0)

    def _reachable(self, away: np.ndarray, reach: np.ndarray) -> np.ndarray:
        """The partitions that may hold a vector within the ``reach`` of each query."""
        shapes = [self.shapes.get(p, (0, np.inf, -np.inf)) for p in range(len(self.pivots))]
        least, most = (np.array([s[i] for s in shapes]) for i in (1, 2))
        return (away - most <= reach[:, None] + SLACK) & (least - away <= reach[:, None] + SLACK)

    def search(self, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
        """``query_id, id, distance, vec_rank`` as ``retrieval.knn`` finds them, and the ``work``: one row
        ``pairs, pairs_read, rows, rows_compared``: of queries with partitions and with vectors, and those of them looked at.

        Queries (query_id, embedding) are taken in blocks of a bounded size. A vector of another length than the index's is an error,
        one of no length finds nothing.
        """
        spark, width = self.vectors.sparkSession, self.pivots.shape[1] if len(self.pivots) else 0
        given = queries.where(F.col("embedding").isNotNull() & F.col("query_id").isNotNull()).select(F.col("query_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("embedding"))
        path, rows, total, counted = scratch(spark, "pivots"), iter(given.toLocalIterator()), np.zeros(4, np.int64), spark.sparkContext.accumulator(0)
        spark.createDataFrame([], FOUND).write.parquet(path)
        n_rows = sum(n for n, _, _ in self.shapes.values())
        while width and (block := list(islice(rows, max(1, PASS_FLOATS // max(width, len(self.pivots)))))):
            if any(len(r["embedding"]) != width for r in block):
                raise ConfigError(f"the index holds vectors of {width} numbers")
            block = [r for r in block if any(r["embedding"])]
            if not block:
                continue
            ids, q = np.array([r["query_id"] for r in block], "i8"), _unit(np.array([r["embedding"] for r in block], float))
            away = np.sqrt(np.maximum(0, 2 - 2 * (q @ self.pivots.T)))
            probed = self._probed(away, k)
            first = self._scan(ids, q, probed, np.full(len(q), np.inf), away, k, spark.sparkContext.accumulator(0))
            order = Window.partitionBy("query_id").orderBy("distance", "id")
            reached = {r["query_id"]: r["distance"] for r in first.withColumn("n", F.row_number().over(order)).where(F.col("n") == k).collect()}
            reach = np.array([np.sqrt(max(0.0, 2 * reached[i])) + SLACK if i in reached else np.inf for i in ids.tolist()])
            wanted = self._reachable(away, reach)
            self._scan(ids, q, wanted, reach, away, k, counted).write.mode("append").parquet(path)
            total += (wanted.size, (wanted | probed).sum(), len(q) * n_rows, 0)
        order = Window.partitionBy("query_id").orderBy("distance", "id")
        found = spark.read.schema(FOUND).parquet(path).withColumn("vec_rank", F.row_number().over(order)).where(F.col("vec_rank") <= k)
        total[3] = counted.value
        return found, spark.createDataFrame([tuple(total.tolist())], "pairs long, pairs_read long, rows long, rows_compared long")
