"""Nearest neighbours by inner product with multi-index hashing of learned binary codes.

Vectors get one more component, so that inner products order them as angles do. Rotations learned on a
bounded sample turn them into binary codes, several bits a component. Codes are cut into substrings, and
a table of each substring's values finds, by the pigeonhole principle, every code within a Hamming radius
of a query's. Those are ranked by their float vectors. The radius is fitted on the sample, so that it
holds nearly all true neighbours at the size of the whole table.

Rows are dealt into blocks of a bounded size, queries too; each task holds one block of either kind.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import stored

#: Rows of the sample that rotations and radius are fitted on.
SAMPLE_ROWS = 4096
BLOCK_ROWS = 8192
QUERY_ROWS = 2048
BITS, SUBSTRINGS = 256, 8
ROUNDS = 15
#: The share of the sample's true neighbours that the radius holds.
HELD = 0.98


@dataclass
class Coder:
    largest: float
    rotation: np.ndarray
    middle: np.ndarray
    radius: int = 0

    def lifted(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        """Vectors with one more component; all rows get the same length, queries a zero."""
        if query:
            last = np.zeros(len(x))
            x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300) * self.largest
        else:
            last = np.sqrt(np.maximum(0, self.largest**2 - (x**2).sum(axis=1)))
        return np.column_stack([x, last])

    def codes(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        """Codes as rows of unsigned 32-bit substrings."""
        bits = self.lifted(x, query) @ self.rotation > self.middle
        return np.packbits(bits, axis=1).view("<u4").reshape(len(x), SUBSTRINGS)


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of all codes of ``a`` to all codes of ``b``."""
    out = np.zeros((len(a), len(b)), np.uint16)
    for x, y in zip(np.ascontiguousarray(a).view("<u8").T, np.ascontiguousarray(b).view("<u8").T, strict=True):
        out += np.bitwise_count(x[:, None] ^ y[None, :])
    return out


def fit(sample: np.ndarray, n_rows: int, largest: float, k: int) -> Coder:
    """Learns rotations by alternating between signs and the rotation that fits them best, then the radius."""
    source = np.random.default_rng(11)
    coder = Coder(largest, np.zeros((sample.shape[1] + 1, BITS)), np.zeros(BITS))
    lifted = coder.lifted(sample)
    centred = lifted - lifted.mean(axis=0)
    d = lifted.shape[1]
    parts = []
    while sum(p.shape[1] for p in parts) < BITS:
        r = np.linalg.qr(source.standard_normal((d, d)))[0]
        for _ in range(ROUNDS):
            u, _, vt = np.linalg.svd(np.where(centred @ r > 0, 1.0, -1.0).T @ centred)
            r = vt.T @ u.T
        parts.append(r)
    coder.rotation = np.concatenate(parts, axis=1)[:, :BITS]
    coder.middle = lifted.mean(axis=0) @ coder.rotation
    queries = sample[:256]
    near = queries @ sample.T
    near[np.arange(len(queries)), np.arange(len(queries))] = -np.inf
    # The sample's first few neighbours are about as near as the first k of the whole table.
    first = int(np.clip(np.ceil(k * len(sample) / max(1, n_rows)), 1, max(1, len(sample) - 1)))
    at = np.argpartition(-near, first - 1, axis=1)[:, :first]
    distances = np.take_along_axis(hamming(coder.codes(queries, True), coder.codes(sample)), at, axis=1)
    coder.radius = int(np.ceil(np.quantile(distances, HELD))) if len(sample) > 1 else BITS
    return coder


class SubstringIndex:
    """Tables from substring values to the rows that have them."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.tables = []
        for j in range(SUBSTRINGS):
            values, of_row = np.unique(codes[:, j], return_inverse=True)
            self.tables.append((values, of_row))

    def within(self, query: np.ndarray, radius: int) -> np.ndarray:
        """Rows of codes within ``radius``: one of their substrings must lie within its share of it."""
        share, rest = divmod(radius, SUBSTRINGS)
        found = np.zeros(len(self.codes), bool)
        for j, (values, of_row) in enumerate(self.tables):
            most = share if j <= rest else share - 1
            if most >= 0:
                near = np.bitwise_count(values ^ query[j]) <= most
                found |= near[of_row]
        rows = np.flatnonzero(found)
        exact = np.bitwise_count(self.codes[rows] ^ query[None, :]).sum(axis=1)
        return rows[exact <= radius]


def search_block(coder: Coder, vectors: np.ndarray, ids: np.ndarray, rows: np.ndarray, queries: np.ndarray, query_rows: np.ndarray, k: int):
    """The ``k`` best of one block for each query: (query's place, ids, scores), nearest first, ties to smaller ids."""
    index = SubstringIndex(coder.codes(vectors))
    for q, code in enumerate(coder.codes(queries, True)):
        radius, found = coder.radius, np.zeros(0, int)
        while True:
            found = index.within(code, radius)
            found = found[rows[found] != query_rows[q]]
            if len(found) >= k or radius >= BITS:
                break
            radius = min(BITS, radius + 8)  # too few within the radius: widen it
        scores = np.einsum("ij,j->i", vectors[found], queries[q])
        best = np.lexsort((ids[found], -scores))[:k]
        yield q, ids[found[best]], scores[best]


def usable(vectors: DataFrame) -> DataFrame:
    """Rows with ``_row, vec_id, embedding``, without null, zero and non-finite vectors and those of an unusual length."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite)
    rows = stored(rows.select("*", F.monotonically_increasing_id().alias("_row")), "vectors")  # numbers are written with the rows, so they stay
    usual = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("embedding") == (usual["d"] if usual else 0))


def nearest(vectors: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row whose id is divisible by ``every``, its ``k`` nearest others.

    Nearest is the largest inner product in double precision; ties go to smaller ids. Vectors that are
    null, zero, or hold null or non-finite components take no part, nor do those of another length than
    most, nor rows without an id. A query passes over its own row only, not over equal vectors or repeated
    ids. With fewer candidates all are returned; an empty table gives no rows.
    """
    rows = usable(vectors)
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    n, largest = rows.agg(F.count(F.lit(1)), F.max(norm)).first()
    schema = "query_id long, query_row long, vec_id long, score double"
    if not n:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    drawn = F.pmod(F.xxhash64("_row", F.lit("sample")), F.lit(1 << 30)) < int((1 << 30) * min(1.0, SAMPLE_ROWS / n))
    picked = sorted((r["_row"], r["embedding"]) for r in rows.where(drawn).limit(2 * SAMPLE_ROWS).collect())
    coder = fit(np.array([v for _, v in picked], float), n, largest, k) if picked else Coder(largest, np.zeros((1, BITS)), np.zeros(BITS), BITS)
    n_blocks, n_query_blocks = -(-n // BLOCK_ROWS), -(-max(1, n // every) // QUERY_ROWS)
    shared = vectors.sparkSession.sparkContext.broadcast(coder)

    def blocks(df: DataFrame, own: str, count: int, other: str, others: int) -> DataFrame:
        """Each row once for each block of the other kind that it meets."""
        return df.withColumn(own, F.pmod(F.xxhash64("_row", F.lit(own)), F.lit(count))).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1)).cast("array<long>")))

    index = blocks(rows, "block", n_blocks, "query_block", n_query_blocks)
    queries = blocks(rows.where(F.col("vec_id") % every == 0), "query_block", n_query_blocks, "block", n_blocks)

    def run(theirs: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(theirs) or not len(asked):
            return pd.DataFrame({"query_id": [], "query_row": [], "vec_id": [], "score": []}).astype({"query_id": "i8", "query_row": "i8", "vec_id": "i8"})
        data, wanted = (np.stack(x["embedding"].to_numpy()).astype(float) for x in (theirs, asked))
        ids, places = asked["vec_id"].to_numpy(), asked["_row"].to_numpy()
        found = list(search_block(shared.value, data, theirs["vec_id"].to_numpy(), theirs["_row"].to_numpy(), wanted, places, k))
        sizes = [len(v) for _, v, _ in found]
        return pd.DataFrame({"query_id": np.repeat(ids, sizes), "query_row": np.repeat(places, sizes), "vec_id": np.concatenate([v for _, v, _ in found]), "score": np.concatenate([s for _, _, s in found])})

    best = index.groupBy("block", "query_block").cogroup(queries.groupBy("block", "query_block")).applyInPandas(run, schema)
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
