"""A stored full-text index: postings in blocks, with what bounds the scores in each.

A task deals its texts into spans of ``SPAN`` texts of like length. A row of ``postings`` holds what one term has in one span:
the texts by their places in the span, how often and where the term stands in each, and for each ``PART`` places the most
often it stands in one text and the least length of those that hold it, for parts that have any. As lengths are alike, the greatest score there
follows closely, for any corpus statistics. A file holds runs of rows sorted by term (a bank's: buckets by the term's hash), so a search reads the
asked terms' pages alone. ``spans`` holds the ids and lengths of each span's texts. A search never reads a text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions.text import tokens
from plumbline.storage import stored

K1, B = 1.2, 0.75
#: Texts of a span, which bound a row of postings, and of a part of it, whose scores have a bound of their own.
SPAN, PART = 128, 16
#: Buckets of terms, each a folder; the spans lie in one of their own.
BUCKETS, SPANS_BUCKET = 16, -1
#: Bytes of a row group: what a search for one term reads at least.
ROW_GROUP = 4 << 20
INDEX = "term string, span long, slots array<smallint>, tf array<int>, positions array<array<int>>, tops array<struct<tf:int,len:int>>, ids array<long>, lens array<int>, bucket int"


def bucket_of(term: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def tokenised(texts: DataFrame, *kept: str) -> DataFrame:
    """``id, terms, len`` of rows with ``id, content`` and, if there, ``heading_context``: both columns count as one text of two fields.
    ``terms`` are joined by spaces, as a text takes less room in a shuffle than an array. ``kept`` columns pass through."""
    heading = tokens(F.coalesce("heading_context", F.lit(""))) if "heading_context" in texts.columns else F.array().cast("array<string>")
    # A gap between the fields keeps phrases from reaching across.
    fields = F.concat(tokens(F.coalesce("content", F.lit(""))), F.array(F.lit("")), heading)
    split = texts.select("id", fields.alias("terms"), *kept)
    return split.select("id", F.array_join("terms", " ").alias("terms"), *kept, (F.size("terms") - 1).alias("len"))


_NAMES = ["term", "span", "slots", "tf", "positions", "tops", "ids", "lens"]
_TOP = pa.struct([("tf", pa.int32()), ("len", pa.int32())])
_KINDS = [pa.string(), pa.int64(), pa.list_(pa.int16()), pa.list_(pa.int32()), pa.list_(pa.list_(pa.int32())), pa.list_(_TOP), pa.list_(pa.int64()), pa.list_(pa.int32())]
#: Spans are numbered by the generation that writes them, the task and their order in it.
_GENERATION, _TASK = 40, 20
#: Bytes of words whose postings a task makes at a time, and rows that it hands on at a time.
RUN_BYTES, RUN_ROWS = 16 << 20, 1 << 14


def _lists(starts: np.ndarray, end: int, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(starts, end).astype(np.int32)), values)


def _firsts(*keys: np.ndarray) -> np.ndarray:
    """The places where one of the keys differs from the row before."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


def _run(first_span: int, ids: pa.Array, terms: pa.Array, lens: np.ndarray, owners: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """The rows of some texts: of their spans, then postings by term. Texts are dealt into spans by owner, length and id."""
    owner = np.zeros(len(lens), np.int32) if owners is None else owners
    order = np.lexsort((ids.to_numpy(), lens, owner))
    ids, lens, owner, terms = ids.take(pa.array(order)), lens[order], owner[order], terms.take(pa.array(order))
    # A span ends after SPAN texts and where the next text has another owner.
    begins = _firsts(owner)
    inside = np.arange(len(lens)) - np.repeat(begins, np.diff(np.append(begins, len(lens))))
    heads = np.flatnonzero(inside % SPAN == 0)
    spans, slots = np.cumsum(inside % SPAN == 0) - 1, inside % SPAN

    def rows(n: int, span: np.ndarray, found: dict[str, pa.Array]) -> Iterator[pa.RecordBatch]:
        columns = [found[k] if k in found else pa.nulls(n, kind) for k, kind in zip(_NAMES, _KINDS, strict=True)]
        columns[1], names = pa.array(first_span + span), _NAMES
        if owners is not None:
            columns, names = [*columns, pa.array(owner[heads[span]])], [*_NAMES, "part"]
        batch = pa.RecordBatch.from_arrays(columns, names=names)
        yield from (batch.slice(at, RUN_ROWS) for at in range(0, n, RUN_ROWS))

    every = np.arange(len(heads))
    yield from rows(len(heads), every, {"ids": _lists(heads, len(lens), ids.cast(pa.int64())), "lens": _lists(heads, len(lens), pa.array(lens))})
    words = pc.split_pattern(terms, " ")
    edges = words.offsets.to_numpy()
    coded = words.values.slice(edges[0], edges[-1] - edges[0]).dictionary_encode()
    by_term = pc.array_sort_indices(coded.dictionary)
    sorted_terms = coded.dictionary.take(by_term)
    rank = np.empty(len(sorted_terms), np.int32)
    rank[by_term.to_numpy()] = np.arange(len(sorted_terms), dtype=np.int32)
    term = rank[coded.indices.to_numpy()]
    text = np.repeat(np.arange(len(lens), dtype=np.int32), np.diff(edges))
    place = (np.arange(len(term)) - np.repeat(edges[:-1] - edges[0], np.diff(edges))).astype(np.int32)
    # The empty word stands between fields, and comes first.
    order = np.argsort(term, kind="stable")
    order = order[np.searchsorted(term[order], int(len(sorted_terms) > 0 and sorted_terms[0].as_py() == "")) :]
    term, text, place = term[order], text[order], place[order]
    if not len(term):
        return
    posting = _firsts(term, text)
    tf = np.diff(np.append(posting, len(term))).astype(np.int32)
    term, text = term[posting], text[posting]
    span, slot = spans[text], slots[text].astype(np.int16)
    row = _firsts(term, span)
    # Slots ascend by length, so the first posting of a part has its least length.
    top = _firsts(term, span, slot // PART)
    tops = pa.StructArray.from_arrays([pa.array(np.maximum.reduceat(tf, top)), pa.array(lens[text[top]])], fields=list(_TOP))
    found = {"term": sorted_terms.take(pa.array(term[row])), "slots": _lists(row, len(term), pa.array(slot)), "tf": _lists(row, len(term), pa.array(tf))}
    found |= {"positions": _lists(row, len(term), _lists(posting, len(place), pa.array(place))), "tops": _lists(np.searchsorted(top, row), len(top), tops)}
    yield from rows(len(row), span[row], found)


def _rows_of(tokens: DataFrame, generation: int, apart: bool) -> DataFrame:
    """``INDEX`` without buckets, of texts where they lie: a task makes the postings of its texts in runs, each sorted by term."""
    schema = INDEX.removesuffix(", bucket int") + (", part int" if apart else "")

    def run(batches):
        span, held, size = (generation << _GENERATION) | (TaskContext.get().partitionId() << _TASK), [], 0

        def made() -> Iterator[pa.RecordBatch]:
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            column = lambda name: whole.column(whole.schema.get_field_index(name))
            yield from _run(span, column("id"), column("terms"), column("len").to_numpy(), column("part").to_numpy() if apart else None)

        for batch in batches:
            at = 0
            while at < len(batch):
                # As many texts as the run still takes, one at least.
                sizes = np.cumsum(pc.binary_length(batch.column("terms").slice(at)).to_numpy())
                n = max(1, int(np.searchsorted(sizes, RUN_BYTES - size, side="right")))
                held.append(batch.slice(at, n))
                at, size = at + n, size + int(sizes[min(n, len(sizes)) - 1])
                if size >= RUN_BYTES or at < len(batch):
                    last = span
                    for rows in made():
                        last = max(last, pc.max(rows.column("span")).as_py())
                        yield rows
                    span, held, size = last + 1, [], 0
        if held:
            yield from made()

    return tokens.mapInArrow(run, schema)


def index_rows(tokens: DataFrame, generation: int = 0) -> DataFrame:
    """The rows of an index (``INDEX``) of ``tokens`` (id, terms, len, part), with a ``part``: no span holds texts of two. Rows come in buckets of
    terms, in order. ``tokens`` are stored, as the sort by length looks at them twice."""
    ordered = tokens.repartitionByRange("part", "len", "id").sortWithinPartitions("part", "len", "id")
    made = _rows_of(ordered, generation, True).withColumn("bucket", F.when(F.col("term").isNull(), SPANS_BUCKET).otherwise(bucket_of(F.col("term"))))
    groups = ["part", "bucket"]
    return made.repartition(*groups, F.pmod(F.xxhash64("span"), F.lit(4))).sortWithinPartitions(*groups, "term", "span")


def spread(texts: DataFrame) -> DataFrame:
    """``texts`` (read from files, as they are counted first), dealt anew by length if they lie in fewer partitions than tasks run at a time."""
    n = texts.sparkSession.sparkContext.defaultParallelism
    return texts.repartitionByRange(n, F.length("content"), "id") if texts.rdd.getNumPartitions() < n else texts


@dataclass
class TextIndex:
    """``postings`` (term, span, slots, tf, positions, tops and perhaps bucket; those of spans have no term) and ``spans`` (span, ids, lens) of a set of texts."""

    postings: DataFrame
    spans: DataFrame

    @staticmethod
    def build(texts: DataFrame, path: str) -> TextIndex:
        """Writes the index of ``texts`` (id, content and perhaps heading_context) to a folder and gives it.

        Null texts are empty texts; rows without an id are passed over; an id given twice is two texts.
        """
        spark, given = texts.sparkSession, texts.where("id IS NOT NULL")
        _rows_of(tokenised(spread(given)), 0, False).write.option("parquet.block.size", str(ROW_GROUP)).parquet(path)
        return TextIndex.read(spark, path)

    @staticmethod
    def read(spark: SparkSession, path: str) -> TextIndex:
        return TextIndex.of(spark.read.schema(INDEX.removesuffix(", bucket int")).parquet(path))

    @staticmethod
    def of(rows: DataFrame) -> TextIndex:
        """The index whose rows these are."""
        in_spans = F.col("bucket") == SPANS_BUCKET if "bucket" in rows.columns else F.col("term").isNull()
        return TextIndex(rows.drop("ids", "lens"), rows.where(in_spans).select("span", "ids", "lens"))

    def corpus(self) -> DataFrame:
        """One row: ``n_docs, avg_len``."""
        each = self.spans.select(F.size("lens").alias("n"), F.aggregate("lens", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))
        return each.agg(F.sum("n").alias("n_docs"), (F.sum("total") / F.sum("n")).alias("avg_len"))


def weight(tf: Column, length: Column, df: Column, n_docs: Column, avg_len: Column) -> Column:
    idf = F.greatest(F.log((n_docs - df + 0.5) / (df + 0.5)), F.lit(1e-6))
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / avg_len))


#: Rows of tables of queries, their statistics and the parts of spans they look at, which go to all tasks; more stay in the shared folder.
HANDED = 20_000
#: Terms or spans named in a filter that files are read by; more are joined.
NAMED = 2000
#: Values of a list in a filter that files are searched for one by one.
PUSHED = 10


@dataclass
class Settled:
    """A table computed once. ``rows``: handed to all tasks if there are few, else read from the shared folder; ``few``: those rows, if few."""

    rows: DataFrame
    few: pa.Table | None

    @staticmethod
    def of(df: DataFrame, name: str) -> Settled:
        few = df.limit(HANDED + 1).toArrow()
        if few.num_rows > HANDED:
            return Settled(stored(df, name), None)
        return Settled(F.broadcast(df.sparkSession.createDataFrame(few, df.schema)), few)

    def largest(self, column: str) -> int:
        """The largest value of a column; 0 if there is none."""
        values = self.rows.agg(F.max(column)).toArrow().column(0) if self.few is None else self.few[column]
        return pc.max(values).as_py() or 0

    def named(self, column: str) -> list | None:
        """The distinct values of a column, if a filter can name them."""
        values = None if self.few is None else self.few[column].unique().to_pylist()
        return values if values is not None and len(values) <= NAMED else None


def asked_postings(index: TextIndex, parts: Settled) -> DataFrame:
    """The index's rows of the terms in ``parts`` (term, bucket); only their files' row groups are read if they can be named."""
    terms = parts.named("term")
    if terms is None:
        return index.postings.join(parts.rows.select("term").distinct(), "term", "left_semi")
    # Longer lists would be pushed into files as their least and largest value alone.
    terms = sorted(terms)
    found = index.postings.where(reduce(or_, [F.col("term").isin(terms[i : i + PUSHED]) for i in range(0, len(terms), PUSHED)]) if terms else F.lit(False))
    return found.where(F.col("bucket").isin(parts.few["bucket"].unique().to_pylist())).drop("bucket") if "bucket" in found.columns else found


def phrase_blocks(index: TextIndex, parts: Settled, several: bool) -> DataFrame:
    """What phrases have in each span: ``query_id, phrase, span, slots, tf, tops``. several: whether some have more than one term.

    A phrase of several terms stands where their positions, each moved back by its place in the phrase, agree.
    """
    found = asked_postings(index, parts).join(parts.rows.drop("bucket"), "term")
    single = found.where("n_parts = 1").select("query_id", "phrase", "span", "slots", "tf", "tops")
    if not several:
        return single
    rows = found.where("n_parts > 1").select("query_id", "phrase", "n_parts", "part", "span", F.explode(F.arrays_zip("slots", "positions")).alias("x"))
    rows = rows.select("query_id", "phrase", "n_parts", "span", F.col("x.slots").alias("slot"), F.transform("x.positions", lambda at: at - F.col("part")).alias("starts"))
    met = rows.groupBy("query_id", "phrase", "n_parts", "span", "slot").agg(F.collect_list("starts").alias("starts")).where("size(starts) = n_parts")
    starts = F.aggregate(F.slice("starts", 2, F.greatest(F.size("starts") - 1, F.lit(0))), F.col("starts")[0], lambda a, x: F.array_intersect(a, x))
    met = met.withColumn("tf", F.size(starts)).where("tf > 0").join(index.spans, "span").withColumn("len", F.col("lens")[F.col("slot").cast("int")])
    in_part = lambda i: F.when(F.col("slot").between(i * PART, i * PART + PART - 1), F.col("tf"))
    length = lambda i: F.min(F.when(in_part(i).isNotNull(), F.col("len")))
    tops = F.array(*(F.when(length(i).isNotNull(), F.struct(F.max(in_part(i)).alias("tf"), length(i).alias("len"))) for i in range(SPAN // PART)))
    grouped = met.groupBy("query_id", "phrase", "span").agg(F.array_sort(F.collect_list(F.struct("slot", "tf"))).alias("block"), tops.alias("tops"))
    return single.unionByName(grouped.select("query_id", "phrase", "span", F.col("block.slot").alias("slots"), F.col("block.tf").alias("tf"), "tops"))


def scored(rows: DataFrame, spans: DataFrame, clauses: DataFrame) -> DataFrame:
    """``query_id, id, score`` of the texts in ``rows`` (query_id, phrase, span, slot, tf, df, n_docs, avg_len) that meet their query (``clauses``)."""
    place = F.col("slot").cast("int")
    rows = rows.join(spans, "span").select("query_id", "phrase", "span", "slot", F.col("ids")[place].alias("id"), weight(F.col("tf"), F.col("lens")[place], F.col("df"), F.col("n_docs"), F.col("avg_len")).alias("w"))
    per_text = rows.groupBy("query_id", "span", "slot", "id").agg(F.sort_array(F.collect_list(F.struct("phrase", "w"))).alias("found"))
    per_text = per_text.join(clauses, "query_id").withColumn("have", F.col("found.phrase"))
    met = F.filter("clauses", lambda c: (F.size(F.array_except(c["need"], F.col("have"))) == 0) & ~F.arrays_overlap(c["ban"], F.col("have")))
    counted = F.flatten(F.transform(F.col("met"), lambda c: c["need"]))
    score = F.aggregate(F.filter("found", lambda x: F.array_contains(counted, x["phrase"])), F.lit(0.0), lambda s, x: s + x["w"])
    return per_text.withColumn("met", met).where(F.size("met") > 0).select("query_id", "id", score.alias("score"))


def ranked(scores: DataFrame, limit: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scores.withColumn("bm25_rank", F.row_number().over(order)).where(F.col("bm25_rank") <= limit)


#: Parts of spans that are scored first for each query, for a threshold: this many times as many as texts are wanted.
PROBED = 2


def _by_span(parts: DataFrame, name: str) -> Settled:
    """``query_id, span, parts`` of rows with ``query_id, span, part``."""
    return Settled.of(parts.groupBy("query_id", "span").agg(F.collect_list("part").alias("parts")), name)


def _rows_in(index: TextIndex, blocks: DataFrame, wanted: Settled) -> tuple[DataFrame, DataFrame]:
    """The postings of ``blocks`` that lie in the parts ``wanted`` (query_id, span, parts), a row each, and the spans they are in.

    Where the spans can be named, only the row groups that may hold them are read.
    """
    named = wanted.named("span")
    here = F.lit(True) if named is None else F.expr(f"span IN ({', '.join(map(str, named))})") if named else F.lit(False)
    at = lambda df: df.where(here)
    near = at(blocks).drop("tops").join(wanted.rows, ["query_id", "span"])
    rows = near.select("query_id", "phrase", "span", "parts", "df", "n_docs", "avg_len", F.explode(F.arrays_zip("slots", "tf")).alias("x"))
    rows = rows.where(F.array_contains("parts", F.shiftright(F.col("x.slots").cast("int"), PART.bit_length() - 1)))
    return rows.select("query_id", "phrase", "span", "df", "n_docs", "avg_len", F.col("x.slots").alias("slot"), F.col("x.tf").alias("tf")), at(index.spans)


def bounded(index: TextIndex, queries: DataFrame, limit: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """``(blocks, rows, spans, clauses)``: the blocks of all phrases with their statistics, and of those the postings that may hold one of the best.

    queries: ``query_id, phrases, clauses``. In each part of a span a query scores at most the sum of its phrases' bounds, and
    nothing unless all phrases of some clause are there. The parts with the highest bounds are scored; parts whose bound lies
    below the score of rank ``limit`` there are skipped.

    Each step is computed once: queries, the counts of their phrases, the bounds, the parts scored first, the scores to beat and the parts left.
    """
    asked = Settled.of(queries, "queries")
    clauses = asked.rows.select("query_id", "clauses")
    phrases = asked.rows.select("query_id", F.posexplode("phrases").alias("phrase", "terms"))
    parts = phrases.select("query_id", "phrase", F.size("terms").alias("n_parts"), F.posexplode("terms").alias("part", "term"))
    parts = Settled.of(parts.withColumn("bucket", bucket_of(F.col("term"))), "terms")
    several = parts.largest("n_parts") > 1
    blocks = phrase_blocks(index, parts, several)
    counts = Settled.of(blocks.groupBy("query_id", "phrase").agg(F.sum(F.size("slots")).alias("df")).crossJoin(F.broadcast(index.corpus())), "counts")
    blocks = blocks.join(counts.rows, ["query_id", "phrase"])
    # Bounds lie in the order of the parts that hold a posting.
    held = F.array_distinct(F.transform("slots", lambda s: F.shiftright(s.cast("int"), PART.bit_length() - 1)))
    heads = blocks.withColumn("x", F.explode(F.arrays_zip(held.alias("part"), F.filter("tops", lambda x: x.isNotNull()).alias("top"))))
    heads = heads.select("query_id", "phrase", "span", "df", "n_docs", "avg_len", F.col("x.part").alias("part"), F.col("x.top").alias("top"))
    bound = weight(F.col("top.tf"), F.col("top.len"), F.col("df"), F.col("n_docs"), F.col("avg_len"))
    heads = heads.groupBy("query_id", "span", "part").agg(F.collect_list("phrase").alias("have"), F.sum(bound).alias("bound"))
    possible = F.exists("clauses", lambda c: F.size(F.array_except(c["need"], F.col("have"))) == 0)
    heads = Settled.of(heads.join(clauses, "query_id").where(possible).select("query_id", "span", "part", "bound"), "heads").rows
    # Where all texts are wanted, there is no score to beat.
    if counts.largest("n_docs") > limit:
        highest = Window.partitionBy("query_id").orderBy(F.desc("bound"), "span", "part")
        first = heads.withColumn("_place", F.row_number().over(highest)).where(F.col("_place") <= F.lit(PROBED * limit).cast("long"))
        sample = ranked(scored(*_rows_in(index, blocks, _by_span(first, "probed")), clauses), limit)
        least = Settled.of(sample.where(F.col("bm25_rank") == limit).select("query_id", F.col("score").alias("least")), "least").rows
        # Sums of bounds may differ from those of scores in their last bits.
        heads = heads.join(least, "query_id", "left").where("least IS NULL OR bound >= least * (1 - 1e-12)")
    return blocks, *_rows_in(index, blocks, _by_span(heads, "kept")), clauses


def search(index: TextIndex, queries: DataFrame, limit: int) -> DataFrame:
    """``query_id, id, score, bm25_rank``: the ``limit`` best texts of each parsed query (query_id, phrases, clauses), ties to smaller ids."""
    _, rows, spans, clauses = bounded(index, queries, limit)
    return ranked(scored(rows, spans, clauses), limit)


def work(index: TextIndex, queries: DataFrame, limit: int) -> DataFrame:
    """``query_id, postings, scored``: how many postings each query's terms have, and how many a search of its ``limit`` best scores."""
    blocks, rows, _, _ = bounded(index, queries, limit)
    have = blocks.groupBy("query_id").agg(F.sum(F.size("slots")).cast("long").alias("postings"))
    return have.join(rows.groupBy("query_id").agg(F.count(F.lit(1)).alias("scored")), "query_id", "left").fillna(0, ["scored"])
