"""Exact nearest neighbours, rank fusion, heading boost and diversity reranking, for batches of queries."""

from __future__ import annotations

from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.config import EngineConfig
from plumbline.errors import ConfigError
from plumbline.functions.text import heading_boost, query_terms
from plumbline.operators.lexical import bm25
from plumbline.operators.postings import TextIndex
from plumbline.storage import scratch

#: Numbers in the query vectors that one pass over the corpus takes along.
PASS_FLOATS = 8_000_000
#: Products of queries and rows that a task works out at a time.
TASK_PRODUCTS = 4_000_000
FOUND = "query_id long, id long, distance double"


def _pass(vectors: DataFrame, ids: np.ndarray, matrix: np.ndarray, k: int) -> DataFrame:
    """``query_id, id, distance``: the ``k`` best rows of each task for each query; ``vectors`` have the queries' width."""
    width = matrix.shape[1]
    matrix = matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)
    shared = vectors.sparkSession.sparkContext.broadcast((ids, matrix))

    def best(batches):
        query_ids, q = shared.value
        parts = range(0, len(q), max(1, TASK_PRODUCTS // ROWS))
        held = {p: (np.zeros((len(q[p : p + parts.step]), 0), "i8"), np.zeros((len(q[p : p + parts.step]), 0))) for p in parts}
        for whole in batches:
            for at in range(0, len(whole), ROWS):
                batch = whole.slice(at, ROWS)
                rows = batch.column("id").to_numpy()
                x = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(rows), width)
                norms = np.linalg.norm(x, axis=1)
                norms = np.where(norms > 0, norms, np.nan)
                for p in parts:
                    distance = 1 - (q[p : p + parts.step] @ x.T) / norms
                    near = np.concatenate([held[p][1], distance], axis=1)
                    its = np.concatenate([held[p][0], np.broadcast_to(rows, distance.shape)], axis=1)
                    order = np.lexsort((its, near), axis=1)[:, :k]
                    held[p] = np.take_along_axis(its, order, 1), np.take_along_axis(near, order, 1)
        for p in parts:
            its, near = held[p]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(query_ids[p : p + parts.step], near.shape[1])), pa.array(its.ravel()), pa.array(near.ravel())], names=["query_id", "id", "distance"])

    found = vectors.where(F.col("id").isNotNull() & (F.size("embedding") == F.lit(width)) & F.lit(width > 0)).select(F.col("id").cast("long").alias("id"), "embedding")
    return found.mapInArrow(best, FOUND).where(~F.isnan("distance"))


#: Rows of a task's batch.
ROWS = 4096


def knn(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``query_id, id, distance, vec_rank``: the ``k`` rows of ``vectors`` (id, embedding) with the least cosine distance, ties to smaller ids.

    Each task multiplies its rows with a block of query vectors and passes on its own ``k`` best of
    each query; so the corpus is read in place, and only candidates are shuffled. A block holds at most ``PASS_FLOATS`` numbers. More
    queries take further passes, whose candidates are written to the shared folder. Rows without an id
    or a vector as long as the queries' are passed over.
    """
    spark = vectors.sparkSession
    given = queries.where(F.col("embedding").isNotNull()).select(F.col("query_id").cast("long").alias("query_id"), "embedding")
    shape = given.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("embedding")).alias("least"), F.max(F.size("embedding")).alias("most")).first()
    if shape["least"] != shape["most"]:
        raise ConfigError("the query vectors differ in length")
    width = shape["most"] or 0
    per = max(1, PASS_FLOATS // max(1, width))

    def block(rows: list) -> DataFrame:
        return _pass(vectors, np.array([r["query_id"] for r in rows], "i8"), np.array([r["embedding"] for r in rows], float).reshape(len(rows), width), k)

    if shape["n"] <= per:
        found = block(given.collect())
    else:
        path, rows = scratch(spark, "knn"), iter(given.toLocalIterator())
        while taken := list(islice(rows, per)):
            block(taken).write.mode("append").parquet(path)
        found = spark.read.schema(FOUND).parquet(path)
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    return found.withColumn("vec_rank", F.row_number().over(order)).where(F.col("vec_rank") <= k)


#: Candidates that are sent to where the chunks are; more are joined by shuffle.
BROADCAST_CANDIDATES = 200_000


def fuse(by_vector: DataFrame, by_words: DataFrame, rrf_k: int = 60) -> DataFrame:
    """``query_id, id, score, cand_pos``: sums of 1 / (k + rank) over both lists; candidates keep vector order, then word order."""
    joined = by_vector.select("query_id", "id", "vec_rank").join(by_words.select("query_id", "id", "bm25_rank"), ["query_id", "id"], "full")
    share = lambda c: F.coalesce(1.0 / (rrf_k + F.col(c)), F.lit(0.0))
    position = F.coalesce(F.col("vec_rank"), F.lit(1 << 30) + F.col("bm25_rank"))
    return joined.select("query_id", "id", (share("vec_rank") + share("bm25_rank")).alias("score"), position.alias("cand_pos"))


def mmr_order(relevance: list[float], vectors: list, k: int, weight: float) -> list[int]:
    """Places of candidates in the order in which maximal marginal relevance picks them; ties go to the later one."""
    left = list(range(len(relevance)))
    width = max((len(v) for v in vectors if v is not None), default=0)
    x = np.zeros((len(left), width))
    for i, v in enumerate(vectors):
        if v is not None:
            x[i, : len(v)] = v
    near, chosen = np.zeros(len(left)), []
    rel = np.asarray(relevance, float)
    while left and len(chosen) < k:
        scores = weight * rel[left] - (1 - weight) * near[left]
        pick = left[len(left) - 1 - int(np.argmax(scores[::-1]))]
        left.remove(pick)
        chosen.append(pick)
        near = np.maximum(near, x @ x[pick])
    return chosen


def rerank(candidates: DataFrame, k: int, weight: float) -> DataFrame:
    """Adds ``mmr_pos`` (from 1) to at most ``k`` rows of each query; rows have ``query_id, id, score, cand_pos, embedding``."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("cand_pos", kind="stable")
        order = mmr_order(frame["score"].tolist(), frame["embedding"].tolist(), k, weight)
        return frame.iloc[order][["query_id", "id", "score"]].assign(mmr_pos=range(1, len(order) + 1))

    return candidates.select("query_id", "id", "score", "cand_pos", "embedding").groupBy("query_id").applyInPandas(run, "query_id long, id long, score double, mmr_pos int")


def hybrid(chunks: DataFrame, index: TextIndex, queries: DataFrame, top_k: int, config: EngineConfig) -> DataFrame:
    """Raw hybrid search: ``query_id, id, score, mmr_pos``.

    chunks: ``id, heading_context, embedding``; index: of their texts; queries: ``query_id, query, embedding``. Both
    candidate lists hold ``top_k`` times the multiplier; a query that the word search cannot read is
    answered by vectors alone. Chunks are read twice, by id and vector: once for neighbours, once for the candidates found.
    """
    pool = top_k * config.mmr_candidate_multiplier
    fused = fuse(knn(chunks, queries, pool), bm25(index, queries, pool), config.rrf_k)
    terms = queries.select("query_id", query_terms(F.col("query")).alias("terms"))
    if queries.count() * pool * 2 <= BROADCAST_CANDIDATES:
        fused, terms = F.broadcast(fused), F.broadcast(terms)
    whole = chunks.select("id", "heading_context", "embedding").join(fused, "id").join(terms, "query_id")
    boosted = whole.withColumn("score", F.col("score") + heading_boost(F.col("heading_context"), F.col("terms"), config.heading_boost))
    return rerank(boosted, top_k, config.mmr_lambda)


def normalised(hits: DataFrame) -> DataFrame:
    """Scores over the largest of their query; all 0 where that is not positive."""
    top = F.greatest(F.max("score").over(Window.partitionBy("query_id")), F.lit(0.0))
    return hits.withColumn("score", F.when(top > 0, F.col("score") / top).otherwise(F.lit(0.0)))


def merged(hits: dict[str, DataFrame], top_k: int) -> DataFrame:
    """One ranking over several indexes: best scores first, ties by the indexes' order, then as each ranked them."""
    tagged = [df.withColumn("source_db", F.lit(label)).withColumn("bank_pos", F.lit(i)) for i, (label, df) in enumerate(hits.items())]
    both = tagged[0]
    for df in tagged[1:]:
        both = both.unionByName(df)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "bank_pos", "mmr_pos")
    best = both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)
    first = F.first("score").over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return best.withColumn("score", F.when(first > 0, F.col("score") / first).otherwise(F.col("score"))).drop("bank_pos", "mmr_pos")
