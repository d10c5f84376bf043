"""The document pipeline: language ID, exact deduplication, near deduplication, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each one's result as
Parquet to the shared folder and hands it, read again, to the next. All stages but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import exact_dedup, langid, minhash, packing
from plumbline.llm.common import keyed, quoted, stored, table, unused, without

SHINGLE_WORDS, SIMILARITY_PERCENT = 5, 80
IDS_FILE = public_tokenizers.path("byte_bpe_50k.json")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language: null texts, texts without letters and those between two languages go.

    Each row is judged alone, so repeated rows share their fate. Columns may have any names; an empty table stays empty.
    """
    found = langid.identify(docs, langid.train(docs), docs.columns, prefix="found_")
    lang, unclear = (unused(docs.columns, "found_" + c) for c in ("lang_pred", "ambiguous"))
    return found.where((F.col(lang) != langid.UNKNOWN) & ~F.col(unclear)).select(*quoted(docs.columns))


def _kept(docs: DataFrame, judge: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """The rows of ``docs`` that a deduplication keeps; ``judge`` gets them with a key and the key's name."""
    key = unused(docs.columns, "row")
    rows = keyed(docs, key)
    judged = stored(judge(rows, key).where("NOT kept").select(F.col("_row").alias(key)), "dropped")
    return without(rows, judged, key).select(*quoted(docs.columns))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the one with the largest id, see ``deduplicate`` for nulls and ties."""
    return _kept(docs, lambda rows, key: exact_dedup.deduplicate(rows, key=key))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that near-duplicate links connect: the one with the least id, see ``near_duplicates`` for nulls and ties."""
    return _kept(docs, lambda rows, key: minhash.near_duplicates(rows, SHINGLE_WORDS, SIMILARITY_PERCENT, key))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of at most 2048 tokens; null texts, repeated rows and empty tables as in ``pieces_of``."""
    return packing.pack_documents(docs, IDS_FILE)


STAGES = [("language ID", language_id), ("exact dedup", exact), ("near dedup", near), ("packing", pack)]

#: SQL has no language classifier, tokenizer or packing search: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stored(stage(spark, docs, sf_dir), f"stage-{number}")
    return docs
