"""BM25 over a stored index of texts, for any number of queries at once."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import fts
from plumbline.operators import postings
from plumbline.operators.postings import TextIndex

PARSED = "query_id long, phrases array<array<string>>, clauses array<struct<need:array<int>,ban:array<int>>>"


def parsed(queries: DataFrame) -> DataFrame:
    """``query_id, phrases, clauses`` of rows with ``query_id, query``; broken queries are left out: nothing matches them by words."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(i, fts.parse(fts.sanitize(q or ""))) for i, q in zip(frame["query_id"], frame["query"], strict=True)]
            yield pd.DataFrame([(i, q.phrases, [{"need": n, "ban": b} for n, b in q.clauses]) for i, q in rows if q and q.clauses], columns=["query_id", "phrases", "clauses"])

    return queries.select(F.col("query_id").cast("long").alias("query_id"), "query").mapInPandas(run, PARSED)


def bm25(index: TextIndex, queries: DataFrame, limit: int) -> DataFrame:
    """``query_id, id, score, bm25_rank``: the ``limit`` best texts of each query (query_id, query), ties to smaller ids.

    Terms have to match all (AND), unless the query says OR or NOT; a term in half of the texts or more
    still counts a little. An empty index gives no rows.
    """
    return postings.search(index, parsed(queries), limit)


def work(index: TextIndex, queries: DataFrame, limit: int) -> DataFrame:
    """``query_id, postings, scored``: the postings of each query's terms and those that a search of its best scores."""
    return postings.work(index, parsed(queries), limit)
