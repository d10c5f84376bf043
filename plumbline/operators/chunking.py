"""Texts as chunks."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from plumbline.functions.markdown import chunk_markdown

CHUNK = [("chunk_index", T.LongType(), pa.int64()), ("content", T.StringType(), pa.string()), ("heading_context", T.StringType(), pa.string()), ("start_byte", T.LongType(), pa.int64()), ("end_byte", T.LongType(), pa.int64())]


def chunked(docs: DataFrame, keep: list[str], most: int, overlap: int) -> DataFrame:
    """The columns ``keep`` of each document and ``chunk_index, content, heading_context, start_byte, end_byte``: a row per chunk of its ``content``.

    A null text has no chunks. Batches hold the chunks of the documents of one batch that comes in.
    """
    kept = docs.select(*keep, "content")

    def run(batches):
        for batch in batches:
            found = [list(enumerate(chunk_markdown(text or "", most, overlap))) for text in batch.column("content").to_pylist()]
            owner = pa.array([row for row, its in enumerate(found) for _ in its], pa.int64())
            rows = [(i, c.content, c.heading_context, c.start_byte, c.end_byte) for its in found for i, c in its]
            columns = [pa.array([r[k] for r in rows], kind) for k, (_, _, kind) in enumerate(CHUNK)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(owner) for k in keep), *columns], names=[*keep, *(n for n, _, _ in CHUNK)])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields[:-1], *(T.StructField(n, t) for n, t, _ in CHUNK)]))
