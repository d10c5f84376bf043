"""Exact Jaccard self-join of texts by their word shingles, size-aware, with the components that its links form.

Shingles have one order common to all sets, rare ones first; how often each occurs is counted over all texts, in buckets.
Two linked sets share many shingles, so they share one among the first few of each, and every subset of ``SUBSET``
ones among a few more. Small sets are light: each lists all subsets of that size of its first shingles, and sets meet
only where a whole subset is equal. Large sets are heavy: they enter inverted lists by single shingles, which are
scanned. A pair is met as light if both sets are small, else in the lists, which also hold the small sets that a large
one may be linked to. The size where sets become heavy is the one with the least cost: rows of subsets below it, rows
and scanned entries of lists above it, both counted over all sets.

Documents with equal sets are one node. Nodes of one list are first compared with those next to them. What is linked
by that is one label, and only nodes of different labels go on: all their meetings are compared on full sets, unless
sizes, places or parity bits rule a link out. So a group of near copies costs about as much as it has members, and no
link between different components can be lost.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import BROADCAST_KEYS, KEY, bounded_batches, discard, keyed, partitions, quoted, stored
from plumbline.llm.minhash import _mixed, components, confirmed, leading, linked_labels, marks, parity, plausible, relabelled, shingle_set, shingles, with_components

#: Shingles of a light set's subsets.
SUBSET = 2
#: Buckets that shingles are counted in, and how many of them one row carries.
BUCKET_BITS, BLOCK_BITS = 21, 14
#: What writing, moving and sorting a row costs, in scanned entries of a list.
ROW_COST = 32
#: Bins of sizes for each doubling.
BINS = 4
#: Rows of one output batch.
ROWS = 1 << 18


def _counted(counts: np.ndarray):
    """The blocks of bucket counts that hold any, packed."""
    for at, block in enumerate(counts.reshape(-1, 1 << BLOCK_BITS)):
        if block.any():
            yield at, pa.compress(block.astype("<i8").tobytes(), codec="zstd", asbytes=True)


def _buckets(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def total_counts(blocks: DataFrame) -> np.ndarray:
    """The sums of packed blocks (block, counts) of all tasks. A block's are added up as a stream; the result has a fixed size."""
    size = 8 << BLOCK_BITS

    def run(batches):
        held, total = None, None

        def row():
            return pa.RecordBatch.from_arrays([pa.array([held], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["block", "counts"])

        for batch in batches:
            for block, packed in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                fresh = np.frombuffer(pa.decompress(packed, size, codec="zstd", asbytes=True), "<i8")
                if block != held:
                    if held is not None:
                        yield row()
                    held, total = block, fresh.copy()
                else:
                    total += fresh
        if held is not None:
            yield row()

    spark = blocks.sparkSession
    dealt = blocks.select("block", "counts").repartition(partitions(spark), "block").sortWithinPartitions("block")
    counts = np.zeros((1 << (BUCKET_BITS - BLOCK_BITS), 1 << BLOCK_BITS), np.int32)
    for r in dealt.mapInArrow(run, "block int, counts binary").collect():
        counts[r["block"]] = np.minimum(np.frombuffer(r["counts"], "<i8"), 2**31 - 1)
    return counts.ravel()


FEATURES = f"_row {KEY}, doc_id long, n long, digest binary, parity binary, marks binary, block int, counts binary"


def features(docs: DataFrame, width: int) -> DataFrame:
    """``_row, doc_id, n, digest, parity, marks`` of rows with ``_row, doc_id, text`` (the last three null for empty sets), and further
    rows with ``block, counts`` alone: how often each bucket's shingles are held by the sets of a task."""
    names, kinds = ["_row", "doc_id", "n", "digest", "parity", "marks", "block", "counts"], None

    def run(batches):
        nonlocal kinds
        counts = np.zeros(1 << BUCKET_BITS, np.int64)
        for batch in batches:
            sets = [shingle_set(text, width) for text in batch.column("text").to_pylist()]
            if sets:
                counts += np.bincount(_buckets(np.concatenate(sets)), minlength=1 << BUCKET_BITS)
            found = [[f(s) if len(s) else None for s in sets] for f in (lambda s: hashlib.blake2b(s.tobytes(), digest_size=16).digest(), parity, marks)]
            none = pa.nulls(len(sets), pa.int32()), pa.nulls(len(sets), pa.binary())
            kinds = batch.column("_row").type
            yield pa.RecordBatch.from_arrays([batch.column("_row"), batch.column("doc_id"), pa.array(list(map(len, sets)), pa.int64()), *(pa.array(x, pa.binary()) for x in found), *none], names=names)
        blocks = list(_counted(counts))
        if blocks:
            n = len(blocks)
            nulls = [pa.nulls(n, t) for t in (kinds, pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())]
            yield pa.RecordBatch.from_arrays([*nulls, pa.array([b for b, _ in blocks], pa.int32()), pa.array([c for _, c in blocks], pa.binary())], names=names)

    return docs.mapInArrow(run, FEATURES)


def shared_at_least(n: int | np.ndarray, percent: int) -> int | np.ndarray:
    """How many shingles of a set of ``n`` every linked set holds."""
    return -(-percent * n // 100)


def first_shingles(texts: DataFrame, width: int, percent: int, counts: np.ndarray) -> DataFrame:
    """``node, n, firsts, block, counts`` of rows with ``node, text``: the first shingles of each set, as many as its subsets need, in the
    common order; and further rows with counts of the first shingles as ``features`` gives them."""
    shared = texts.sparkSession.sparkContext.broadcast(counts)
    names = ["node", "n", "firsts", "block", "counts"]

    def run(batches):
        listed = np.zeros(1 << BUCKET_BITS, np.int64)
        for batch in batches:
            sizes, firsts = [], []
            for text in batch.column("text").to_pylist():
                s = shingle_set(text, width)
                keep = len(s) - int(shared_at_least(len(s), percent)) + SUBSET
                order = np.argsort(shared.value[_buckets(s)], kind="stable")  # equal counts stay in the order of hashes
                sizes.append(len(s))
                firsts.append(s[order[:keep]].view(np.int64))
            if firsts:
                alone = np.concatenate([f[: n - int(shared_at_least(n, percent)) + 1] for f, n in zip(firsts, sizes, strict=True)])
                listed += np.bincount(_buckets(alone.view(np.uint64)), minlength=1 << BUCKET_BITS)
            k = len(sizes)
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sizes, pa.int64()), pa.array(firsts, pa.list_(pa.int64())), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], names=names)
        blocks = list(_counted(listed))
        if blocks:
            k = len(blocks)
            yield pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.list_(pa.int64())), pa.array([b for b, _ in blocks], pa.int32()), pa.array([c for _, c in blocks], pa.binary())], names=names)

    return texts.select("node", "text").mapInArrow(run, "node long, n long, firsts array<long>, block int, counts binary")


def _sets(batch: pa.RecordBatch):
    """Size and first shingles of each row of a batch."""
    lists = batch.column("firsts")
    values, ends = lists.values.to_numpy().view(np.uint64), lists.offsets.to_numpy()
    return zip(batch.column("n").to_numpy(), (values[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)), strict=True)


def boundary(firsts: DataFrame, percent: int, listed: np.ndarray) -> int:
    """The size from which sets are heavy: of the sizes where a bin begins, the one with the least cost over all sets."""
    shared = firsts.sparkSession.sparkContext.broadcast(listed)

    def run(batches):
        costs: dict[int, list[int]] = {}
        for batch in batches:
            for n, keys in _sets(batch):
                single = n - int(shared_at_least(int(n), percent)) + 1
                cost = costs.setdefault(_bin(int(n)), [0, 0])
                cost[0] += ROW_COST * comb(len(keys), SUBSET)
                cost[1] += ROW_COST * int(single) + int(shared.value[_buckets(keys[:single])].sum())
        columns = [list(costs), *([c[i] for c in costs.values()] for i in (0, 1))]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(map(float, c), pa.float64()) for c in columns[1:])], names=["bin", "light", "heavy"])

    rows = firsts.select("n", "firsts").mapInArrow(run, "bin int, light double, heavy double").groupBy("bin").agg(F.sum("light").alias("light"), F.sum("heavy").alias("heavy")).collect()
    costs = sorted((r["bin"], r["light"], r["heavy"]) for r in rows)

    def cost(at: int) -> float:
        from_ = _bin(int(shared_at_least(_size(at), percent)))
        return sum(light for b, light, _ in costs if b < at) + sum(heavy for b, _, heavy in costs if b >= from_)

    ends = range(0, costs[-1][0] + BINS + 2) if costs else [0]  # up to where even the largest sets have no heavy partner
    return _size(min(ends, key=cost))


def _bin(n: int) -> int:
    """Sizes of a doubling fall into ``BINS`` bins."""
    return int(np.floor(BINS * np.log2(max(1, n)) + 1e-9))


def _size(at: int) -> int:
    """The least size of a bin."""
    return int(np.ceil(2 ** (at / BINS) - 1e-9)) if at else 1


@lru_cache(256)
def _subsets(n: int) -> np.ndarray:
    """All places of ``SUBSET`` ascending items out of ``n``, a column each."""
    return np.array(list(combinations(range(n), SUBSET)), np.int64).reshape(-1, SUBSET).T


def meeting_keys(firsts: DataFrame, percent: int, heavy: int) -> DataFrame:
    """``key, n, at, node``: where sets meet. ``at`` is the first place that they can share, if this is what they share first."""
    factors = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)[:SUBSET]
    partner = int(shared_at_least(heavy, percent))

    def batch_of(rows: list[tuple[np.ndarray, np.ndarray, int, int]]) -> pa.RecordBatch:
        lengths = [len(k) for k, _, _, _ in rows]
        keys, at = (np.concatenate([np.zeros(0, np.int64), *(r[i] for r in rows)]) for i in (0, 1))
        n, node = (np.repeat(np.array([r[i] for r in rows], np.int64), lengths) for i in (2, 3))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (keys, n, at, node)], names=["key", "n", "at", "node"])

    def run(batches):
        rows, size = [], 0
        for batch in batches:
            for (n, keys), node in zip(_sets(batch), batch.column("node").to_numpy(), strict=True):
                if n < heavy and len(keys) >= SUBSET:
                    picked = _subsets(len(keys))
                    with np.errstate(over="ignore"):
                        key = _mixed((keys[picked] * factors[:, None]).sum(axis=0, dtype=np.uint64))
                    rows.append((key.view(np.int64), picked[-1] - (SUBSET - 1), int(n), int(node)))
                    size += picked.shape[1]
                if n >= partner:
                    single = keys[: int(n) - int(shared_at_least(int(n), percent)) + 1]
                    rows.append((single.view(np.int64), np.arange(len(single)), int(n), int(node)))
                    size += len(single)
                if size >= ROWS:
                    yield batch_of(rows)
                    rows, size = [], 0
        yield batch_of(rows)

    return firsts.select("node", "n", "firsts").mapInArrow(run, "key long, n long, at long, node long")


def shared_keys(keys: DataFrame, percent: int) -> DataFrame:
    """The rows of ``key, n, at, node`` whose key several sets hold, each with the set after it (``after``) that it may be linked to.

    Rows are sorted over all tasks, so a key held by many sets is spread; at the ends of a task rows are kept without a look at the next.
    Those by which a set of the same size may be found come first, so that they stand next to each other.
    """
    names = ["key", "n", "at", "node"]

    def run(batches):
        held: dict[str, np.ndarray] | None = None
        alike = True  # whether the key of the held row has another row before it, or may have
        for batch in batches:
            if not len(batch):
                continue
            c = {k: batch.column(k).to_numpy() for k in names}
            if held is not None:
                c = {k: np.concatenate([held[k], v]) for k, v in c.items()}
            same = c["key"][1:] == c["key"][:-1]
            small, large = c["n"][:-1], c["n"][1:]
            rest = np.minimum(small - c["at"][:-1], large - c["at"][1:])
            next_to = same & (100 * small >= percent * large) & ((100 + percent) * rest >= percent * (small + large)) & leading(small, c["at"][:-1], percent)
            keep = np.concatenate([[alike], same[:-1]]) | same if len(same) else np.zeros(0, bool)
            yield rows({k: v[:-1][keep] for k, v in c.items()}, c["node"][1:][keep], next_to[keep])
            alike = bool(same[-1]) if len(same) else alike
            held = {k: v[-1:] for k, v in c.items()}
        if held is not None:
            yield rows(held, held["node"], np.zeros(1, bool))

    def rows(c, after, linked):
        return pa.RecordBatch.from_arrays([*(pa.array(c[k]) for k in names), pa.array(after, mask=~linked)], names=[*names, "after"])

    order = ["key", ~leading(F.col("n"), F.col("at"), percent), "n", "node"]
    dealt = keys.repartitionByRange(partitions(keys.sparkSession), *order).sortWithinPartitions(*order)
    return dealt.mapInArrow(run, "key long, n long, at long, node long, after long")


def similar_documents(docs: DataFrame, width: int = 5, percent: int = 80, key: str = "") -> DataFrame:
    """A row per document: ``_row, doc_id, n_shingles, component_id, kept``, exactly.

    docs: ``doc_id``, ``text`` and any other columns; key: one that ``keyed`` added, which ``_row`` repeats. Words are what lies
    between ASCII white space after lower-casing A-Z; a document's set are its distinct shingles of ``width`` words, of fewer
    words their whole sequence. Documents are linked if 100 * intersection >= percent * union, which has to be more than 50.
    ``component_id`` is the least ``doc_id`` that links reach, the document's own included; ``kept`` marks the documents with that id
    (of repeated rows, one). Empty and null texts have no shingles and no links. Null ids are greater than all others. An
    empty table gives no rows. Shingles are told apart by 64 bits.
    """
    if not 50 < percent <= 100:
        raise ValueError("a link needs more than half of the union")
    spark = docs.sparkSession
    bounded_batches(spark)
    wanted = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")]
    ids = docs.select(*(F.col(c).alias("_row") for c in quoted([key])), *wanted) if key else keyed(docs.select(*wanted), "_row")
    found = stored(features(ids, width), "features")
    rows, counts = found.where("block IS NULL").drop("block", "counts"), total_counts(found.where("block IS NOT NULL"))
    first = F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "_row"))
    groups = rows.where("n > 0").groupBy("digest").agg(first.alias("first"), F.count(F.lit(1)).alias("size"), F.min(F.struct("_row", "n", "parity", "marks")).alias("rep"))
    # Numbers are written with the nodes, so they stay.
    nodes = stored(groups.select(F.monotonically_increasing_id().alias("node"), "digest", "first", "size", "rep.*"), "nodes")

    def texts_of(needed: DataFrame) -> DataFrame:
        return ids.join(F.broadcast(needed) if needed.count() <= BROADCAST_KEYS else needed, "_row")

    listed = stored(first_shingles(texts_of(nodes.select("node", "_row")), width, percent, counts), "firsts")
    firsts = listed.where("block IS NULL").select("node", "n", "firsts")
    heavy = boundary(firsts, percent, total_counts(listed.where("block IS NOT NULL")))
    postings = stored(shared_keys(meeting_keys(firsts, percent, heavy), percent), "keys")
    discard(listed)

    def confirm(pairs: DataFrame) -> DataFrame:
        ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        needed = stored(ends.join(nodes.select("node", "_row"), "node"), "needed")
        return confirmed(pairs, stored(shingles(texts_of(needed), width), "sets"), percent)

    # Of the sets next to it, each is compared with the one that it meets most often.
    beside = postings.where("after IS NOT NULL AND after <> node").groupBy(F.col("node").alias("a"), F.col("after").alias("b")).agg(F.count(F.lit(1)).alias("keys"))
    beside = beside.groupBy("a").agg(F.max(F.struct("keys", "b")).alias("most")).select("a", F.col("most.b").alias("b"))
    links = stored(confirm(stored(plausible(beside, nodes.select("node", "n", "marks"), percent), "beside")), "links")
    named = nodes.select("node", "n", "parity", "marks", "digest", "first", "size", F.col("node").alias("label"))
    if not links.isEmpty():
        named = relabelled(named, components(links))
    named = stored(named, "named")
    members = postings.select("node").distinct().join(named, "node").select("node", "n", "parity", "marks", "label")
    more = linked_labels(postings, stored(members, "members"), percent, confirm)
    if not more.isEmpty():
        named = relabelled(named, components(more))
    out = with_components(rows, named)
    discard(postings)
    return out
