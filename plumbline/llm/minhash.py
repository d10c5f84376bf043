"""Near-duplicate detection by an LSH forest over MinHash signatures.

A document's set are the hashes of its distinct word shingles. Documents with equal sets are one node.
Each tree of the forest orders all nodes by its own stretch of the signature; a node's candidates are
those that follow it in the order, the ones with the longest common prefix. How deep a prefix they share
adapts to the region: in a crowded one the nearest agree on many hashes, elsewhere on ``LEAD`` at least.
Orders are range-partitioned, so that no bucket, however popular, meets in one task.

A pair is tried only if its parity bits allow a link. Each shingle of a set flips one of ``PARITY`` bits, so
two sets differ in at least as many shingles as bits: no link is lost by that. Pairs tried become links
by a comparison of their full sets. Components are found on the links by contraction.

A node that has more candidates in some order than are taken is crowded. Links that this hid lie between two
crowded nodes, so an exact join finds them: two linked sets share a shingle among the first few of each,
in any order common to all sets (rare ones first, as few sets share those). Only nodes of different components
meet there, as no others can change the result. What remains is the forest's own chance to miss a link: that its nodes
agree on the leading hashes in no tree, at most (1 - s ** LEAD) ** TREES at a similarity of s: 8e-8 at 0.8, 1e-9 at 0.85.
Shingles are told apart by 64 bits: two different ones of a pair of sets of a million shingles each are taken for one
with a chance of 5e-8.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import BROADCAST_KEYS, KEY, bounded_batches, discard, join_groups, keyed, partitions, quoted, stored

#: Trees; values of a tree's key, of which the ``LEAD`` first have 32 bits and must be equal, the others 16.
TREES, DEPTH, LEAD = 16, 6, 2
#: Places behind a node in each order that are looked at, and candidates taken from them. Nodes with more are crowded.
REACH, TAKEN = 24, 2
PARITY = 512
#: Words whose hashes a worker remembers.
WORDS = 300_000
#: Sets whose shingles are counted for the order of prefixes, and most shingles of it; others count as rare. Neither changes the result.
COUNTED, COMMON = 8192, 1 << 18
#: Labels are compared with their nearest once more if one in so many was linked by that.
FEW_LINKS = 20
#: Links that one task puts together into components (16 bytes each); rounds over all tasks leave no more.
LAST_LINKS = 1 << 15
#: Nodes that one task compares through one shingle; those of commoner ones are dealt in pairs of blocks.
BLOCK = 4096


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS:
            self.clear()
        h = xxhash.xxh64_intdigest(word)
        if len(word) <= 64:
            self[word] = h
        return h


_words = _WordHashes()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _seeds(number: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Factors and addends of a family of hash functions."""
    source = np.random.default_rng(20_240_613 + number)
    return source.integers(1, 2**63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1), source.integers(0, 2**63, count, dtype=np.uint64)


_FACTORS, _ADDENDS = _seeds(0, TREES * DEPTH)
_PLACES = _seeds(-1, 64)[0]


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """The sorted 64-bit hashes of the distinct shingles of ``width`` words; of fewer words, the whole sequence is one."""
    words = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    n = max(1, len(words) - width + 1)
    with np.errstate(over="ignore"):
        total = np.full(n, len(words) if len(words) < width else 0, np.uint64)
        for i in range(min(width, len(words))):
            total = _mixed(total * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + n] * _PLACES[i])
    return np.unique(total)


def signature(hashes: np.ndarray) -> bytes:
    """The keys of a non-empty set in all trees, one after another: bytes order as MinHash values do."""
    low = np.full(len(_FACTORS), 2**64 - 1, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(hashes), 1024):
            part = _FACTORS[:, None] * hashes[None, at : at + 1024] + _ADDENDS[:, None]
            np.minimum(low, part.min(axis=1), out=low)
        # The least values of a set are small: their leading bits say little, so they are mixed first.
        values = _mixed(low).reshape(TREES, DEPTH)
    lead, rest = (values[:, :LEAD] >> np.uint64(32)).astype(">u4"), (values[:, LEAD:] >> np.uint64(48)).astype(">u2")
    return np.concatenate([lead.view(np.uint8).reshape(TREES, -1), rest.view(np.uint8).reshape(TREES, -1)], axis=1).tobytes()


LEAD_BYTES, KEY_BYTES = 4 * LEAD, 4 * LEAD + 2 * (DEPTH - LEAD)


def parity(hashes: np.ndarray) -> bytes:
    """Bits that each shingle flips one of: those of two sets differ in no more places than the sets do."""
    places = (hashes >> np.uint64(64 - (PARITY - 1).bit_length())).astype(np.int64)
    return np.packbits((np.bincount(places, minlength=PARITY) & 1).astype(np.uint8)).tobytes()


#: Bits a shingle of ``marks``, which a comparison of two sets takes before it reads them.
MARKS = 3


def marks(hashes: np.ndarray) -> bytes:
    """Parity bits in proportion to the set, at least 64: they still tell long sets apart, whose ``parity`` says little."""
    bits = max(6, (MARKS * len(hashes) - 1).bit_length())
    places = (hashes >> np.uint64(64 - bits)).astype(np.int64)
    return np.packbits((np.bincount(places, minlength=1 << bits) & 1).astype(np.uint8)).tobytes()


def folded(x: np.ndarray, width: int) -> np.ndarray:
    """Rows of parity bits as those of ``width`` bytes, which say less: neighbouring bits are added up."""
    bits = np.unpackbits(x, axis=1)
    return np.packbits(bits.reshape(len(x), 8 * width, -1).sum(axis=2).astype(np.uint8) & 1, axis=1)


def matrix(values: pa.Array, width: int, kind: type) -> np.ndarray:
    """Binary values of ``width`` bytes each as rows."""
    return np.frombuffer(b"".join(values.to_pylist()), kind).reshape(len(values), -1) if len(values) else np.zeros((0, width // np.dtype(kind).itemsize), kind)


def distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many parity bits the rows of two matrices differ."""
    return np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)


def possible(apart: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets that differ in ``apart`` shingles at least and have ``sizes`` together can be linked."""
    return (100 + percent) * apart <= (100 - percent) * sizes


def leading(n: np.ndarray | Column, at: np.ndarray | Column, percent: int) -> np.ndarray | Column:
    """Whether a set's place ``at`` may be the first it shares with a linked set that is no smaller."""
    return (100 + percent) * (n - at) >= 2 * percent * n


def features(docs: DataFrame, width: int) -> DataFrame:
    """``_row, doc_id, n, digest, sig, parity, marks`` of rows with ``_row, doc_id, text``; the last four are null for empty sets."""

    def run(batches):
        for batch in batches:
            sets = [shingle_set(text, width) for text in batch.column("text").to_pylist()]
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            found = [[f(s) if len(s) else None for s in sets] for f in (signature, parity, marks)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_row"), batch.column("doc_id"), pa.array(list(map(len, sets)), pa.int64()), *(pa.array(x, pa.binary()) for x in (digests, *found))],
                names=["_row", "doc_id", "n", "digest", "sig", "parity", "marks"],
            )

    return docs.mapInArrow(run, f"_row {KEY}, doc_id long, n long, digest binary, sig binary, parity binary, marks binary")


def shingles(texts: DataFrame, width: int) -> DataFrame:
    """``node, hashes`` of rows with ``node, text``."""

    def run(batches):
        for batch in batches:
            sets = [shingle_set(text, width).view(np.int64) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.list_(pa.int64()))], names=["node", "hashes"])

    return texts.select("node", "text").mapInArrow(run, "node long, hashes array<long>")


def neighbours(nodes: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs (a, b) of ``nodes`` (node, n, sig, parity) by all trees, and the crowded nodes: (a, null)."""

    def run(batches):
        held, seen = None, 0
        for batch in batches:
            if not len(batch):
                continue
            c = {k: batch.column(k).to_numpy() for k in ("tree", "n", "node")} | {"lead": matrix(batch.column("lead"), LEAD_BYTES, np.uint8), "parity": matrix(batch.column("parity"), PARITY // 8, np.uint64)}
            fresh = 0 if held is None else len(held["node"])
            if held is not None:
                c = {k: np.concatenate([held[k], v]) for k, v in c.items()}
            size, node, n = len(c["node"]), c["node"], c["n"]
            taken = np.concatenate([held["taken"], np.zeros(size - fresh, np.int64)]) if held is not None else np.zeros(size, np.int64)
            # Others of a run may lie beyond the first and last places of a partition.
            crowded, pairs = [node[fresh : fresh + max(0, REACH - seen)]], []
            seen += size - fresh
            for r in range(1, REACH + 1):
                a = np.arange(max(0, fresh - r), size - r)  # the later of a pair is new
                a = a[(c["tree"][a] == c["tree"][a + r]) & (c["lead"][a] == c["lead"][a + r]).all(axis=1)]
                if r == REACH:
                    crowded += [node[a], node[a + r]]
                a = a[100 * np.minimum(n[a], n[a + r]) >= percent * np.maximum(n[a], n[a + r])]
                a = a[possible(distance(c["parity"][a], c["parity"][a + r]), n[a] + n[a + r], percent)]
                more = taken[a] >= TAKEN
                crowded += [node[a[more]], node[a[more] + r]]
                a = a[~more]
                taken[a] += 1
                pairs.append(np.sort(np.stack([node[a], node[a + r]], axis=1), axis=1))
            held = {k: v[-REACH:] for k, v in (c | {"taken": taken}).items()}
            yield found(np.concatenate(pairs), np.concatenate(crowded))
        if held is not None:
            yield found(np.zeros((0, 2), np.int64), held["node"])

    def found(pairs: np.ndarray, crowded: np.ndarray) -> pa.RecordBatch:
        pairs, crowded = np.unique(pairs, axis=0), np.unique(crowded)
        a, b = np.concatenate([pairs[:, 0], crowded]), np.concatenate([pairs[:, 1], crowded])
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b, mask=np.arange(len(b)) >= len(pairs))], names=["a", "b"])

    trees = F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")
    orders = nodes.select("node", "n", "sig", "parity", trees)
    orders = orders.withColumn("key", F.col("sig").substr(F.col("tree") * KEY_BYTES + 1, F.lit(KEY_BYTES))).drop("sig")
    orders = orders.repartitionByRange(partitions(nodes.sparkSession), "tree", "key", "n", "node").sortWithinPartitions("tree", "key", "n", "node")
    return orders.select("tree", F.substring("key", 1, LEAD_BYTES).alias("lead"), "n", "node", "parity").mapInArrow(run, "a long, b long").distinct()


def plausible(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The rows of ``pairs`` (a, b and others) that the ``marks`` of ``nodes`` (node, n, marks) leave open: no link is lost."""

    def run(batches):
        for batch in batches:
            c = {k: batch.column(k) for k in ("marks_a", "marks_b")}
            widths = {k: pc.binary_length(v).to_numpy() for k, v in c.items()}
            sizes = batch.column("sizes").to_numpy()
            keep = np.zeros(len(sizes), bool)
            both = np.stack([widths["marks_a"], widths["marks_b"]], axis=1)
            for wa, wb in np.unique(both, axis=0):
                at = np.flatnonzero((both == (wa, wb)).all(axis=1))
                x, y = (matrix(c[k].take(pa.array(at)), w, np.uint8) for k, w in (("marks_a", wa), ("marks_b", wb)))
                least = min(wa, wb)
                x, y = (v if v.shape[1] == least else folded(v, least) for v in (x, y))
                keep[at] = possible(np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64), sizes[at], percent)
            yield batch.select(names).filter(pa.array(keep))

    names = pairs.columns
    a, b = (nodes.select(F.col("node").alias(k), F.col("n").alias(f"n_{k}"), F.col("marks").alias(f"marks_{k}")) for k in ("a", "b"))
    both = pairs.join(a, "a").join(b, "b").select(*names, (F.col("n_a") + F.col("n_b")).alias("sizes"), "marks_a", "marks_b")
    return both.mapInArrow(run, pairs.schema)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The rows of ``pairs`` (a, b and others) with 100 * intersection >= percent * union of their full sets."""
    a = sets.select(F.col("node").alias("a"), F.col("hashes").alias("set_a"))
    b = sets.select(F.col("node").alias("b"), F.col("hashes").alias("set_b"))
    both = F.size(F.array_intersect("set_a", "set_b"))
    joined = pairs.join(a, "a").join(b, "b").select(*pairs.columns, both.alias("both"), (F.size("set_a") + F.size("set_b")).alias("sum"))
    return joined.where(100 * F.col("both") >= percent * (F.col("sum") - F.col("both"))).select(*pairs.columns)


def components(links: DataFrame) -> DataFrame:
    """``node, label`` of every node of undirected ``links`` (a, b): the label is the component's least node.

    Each round every node takes the one of itself and the nodes around it that comes first in an order of the round's own; links
    between the nodes taken go on to the next round. Orders are hashes, so however nodes are numbered, a constant share of them
    goes each round, and rounds grow with the logarithm of a component's size. What is left of few links, one task puts together.
    """
    a, b = F.least("a", "b"), F.greatest("a", "b")
    edges = stored(links.where("a <> b").select(a.alias("a"), b.alias("b")).distinct(), "edges")
    steps: list[DataFrame] = []
    while edges.count() > LAST_LINKS:
        place = {c: F.xxhash64(c, F.lit(len(steps))) for c in ("a", "b")}
        around = edges.union(edges.select("b", "a")).groupBy("a").agg(F.min_by("b", place["b"]).alias("b"))
        step = stored(around.select(F.col("a").alias("node"), F.when(place["b"] < place["a"], F.col("b")).otherwise(F.col("a")).alias("label")), "step")
        fresh = edges.join(step.toDF("a", "top_a"), "a").join(step.toDF("b", "top_b"), "b").where("top_a <> top_b")
        fresh = stored(fresh.select(F.least("top_a", "top_b").alias("a"), F.greatest("top_a", "top_b").alias("b")).distinct(), "edges")
        discard(edges)
        edges = fresh
        steps.append(step)
    labels, contracted = edges.coalesce(1).mapInArrow(_put_together, "node long, label long"), bool(steps)
    while steps:  # the last step is the smallest
        labels = steps.pop().join(labels.toDF("label", "lower"), "label", "left").select("node", F.coalesce("lower", "label").alias("label"))
    labels = stored(labels, "labels")
    if contracted:  # labels are any nodes of their components
        least = labels.groupBy("label").agg(F.min("node").alias("least"))
        labels = stored(labels.join(least, "label").select("node", F.col("least").alias("label")), "labels")
    return labels


def _put_together(batches):
    """``node, label`` of the links (a, b) of one task: the label is the least node that they reach."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    for batch in batches:
        for x, y in zip(*(batch.column(c).to_pylist() for c in ("a", "b")), strict=True):
            x, y = top(x), top(y)
            up[max(x, y)] = min(x, y)
    nodes = list(up)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(map(top, nodes), pa.int64())], names=["node", "label"])


def relabelled(rows: DataFrame, lower: DataFrame) -> DataFrame:
    """``rows`` with ``label`` put through ``lower`` (node, label), where it is in there."""
    return rows.join(lower.toDF("label", "lower"), "label", "left").withColumn("label", F.coalesce("lower", "label")).select(*rows.columns)


def common_shingles(sets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles found in several of a sample of ``sets`` (node, hashes), sorted, and in how many."""

    def run(batches):
        for batch in batches:
            values, counts = np.unique(batch.column("hashes").flatten().to_numpy(), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(counts)], names=["shingle", "n"])

    every = -(-sets.count() // COUNTED) or 1
    sample = sets.where(F.pmod(F.xxhash64("node"), F.lit(every)) == 0).select("hashes")
    counts = sample.mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("count"))
    most = counts.where("count > 1").orderBy(F.desc("count"), "shingle").limit(COMMON).toArrow()
    found, n = most["shingle"].to_numpy().astype(np.int64).view(np.uint64), most["count"].to_numpy().astype(np.int32)
    order = np.argsort(found)
    return found[order], n[order]


def prefix(hashes: np.ndarray, percent: int, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The first of a sorted set's hashes by (count, hash): so many that every linked set has one of them among its own first."""
    size = len(hashes) - -(-percent * len(hashes) // 100) + 1
    known, n = common
    if not len(known):
        return hashes[:size]
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    counts = np.where(known[at] == hashes, n[at], 0)
    return hashes[np.argsort(counts, kind="stable")[:size]]


def postings_of(sets: DataFrame, percent: int, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """``key, at, node``: the shingles of each set's prefix and their places in it."""
    shared = sets.sparkSession.sparkContext.broadcast(common)

    def run(batches):
        for batch in batches:
            lists = batch.column("hashes")
            values, ends = lists.values.to_numpy().view(np.uint64), lists.offsets.to_numpy()
            firsts = [prefix(values[a:b], percent, shared.value).view(np.int64) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            sizes = list(map(len, firsts))
            places = np.concatenate([np.zeros(0, np.int64), *map(np.arange, sizes)])
            columns = [np.concatenate([np.zeros(0, np.int64), *firsts]), places, np.repeat(batch.column("node").to_numpy(), sizes)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["key", "at", "node"])

    return sets.select("node", "hashes").mapInArrow(run, "key long, at long, node long")


def _best(pairs: np.ndarray) -> np.ndarray:
    """Of rows (label_a, label_b, apart, ...), those that come first by ``apart`` for one of their labels."""
    keep = np.zeros(len(pairs), bool)
    for side in (0, 1):
        order = np.lexsort((pairs[:, 2], pairs[:, side]))
        keep[order[np.concatenate([[True], np.diff(pairs[order, side]) != 0])]] = True
    return pairs[keep]


def meetings(postings: DataFrame, percent: int, take: str) -> DataFrame:
    """Pairs (a, b, label_a < label_b) of nodes of different labels that share a ``key``, unless sizes, places or parity bits rule a link out.

    postings: ``key, n, at, node, label, side, parity``: a node's set has ``n`` shingles, the key at place ``at``. Nodes meet if
    their sides differ or are 0. take: ``all`` pairs; the ``nearest`` of each pair of labels, that differ in the fewest bits; or of
    each label the ``best``, so that there are no more pairs than labels.
    """
    names = ["key", "n", "at", "node", "label", "side"]

    def met(c: dict[str, np.ndarray]) -> pa.RecordBatch:
        # A smaller set is found only by a place from which enough of it is left, were the other as small.
        found, a, step = [np.zeros((0, 5), np.int64)], np.flatnonzero(leading(c["n"], c["at"], percent)), 1
        while len(a):
            a = a[a + step < len(c["key"])]
            # Within a key sizes grow: once one is too large, so are all that follow.
            a = a[(c["key"][a] == c["key"][a + step]) & (100 * c["n"][a] >= percent * c["n"][a + step])]
            x, y = a, a + step
            fit = (c["label"][x] != c["label"][y]) & ((c["side"][x] == 0) | (c["side"][x] != c["side"][y]))
            rest = np.minimum(c["n"][x] - c["at"][x], c["n"][y] - c["at"][y])  # no more is shared if this is the first place shared
            fit &= (100 + percent) * rest >= percent * (c["n"][x] + c["n"][y])
            x, y = x[fit], y[fit]
            apart = distance(c["parity"][x], c["parity"][y])
            fit = possible(apart, c["n"][x] + c["n"][y], percent)
            x, y, apart = x[fit], y[fit], apart[fit]
            swap = c["label"][x] > c["label"][y]
            x, y = np.where(swap, y, x), np.where(swap, x, y)
            found.append(np.stack([c["label"][x], c["label"][y], apart, c["node"][x], c["node"][y]], axis=1))
            step += 1
        pairs = np.unique(np.concatenate(found), axis=0)
        if take != "all" and len(pairs):
            pairs = pairs[np.concatenate([[True], (pairs[1:, :2] != pairs[:-1, :2]).any(axis=1)])]
        if take == "best" and len(pairs):
            pairs = _best(pairs)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, i].copy()) for i in (3, 4, 0, 1, 2)], names=["a", "b", "label_a", "label_b", "apart"])

    def run(batches):
        held = []
        for batch in batches:
            if not len(batch):
                continue
            fresh = {k: batch.column(k).to_numpy() for k in names} | {"parity": matrix(batch.column("parity"), PARITY // 8, np.uint64)}
            if held and held[0]["key"][0] == fresh["key"][-1]:
                held.append(fresh)
                continue
            last = int(np.searchsorted(fresh["key"], fresh["key"][-1]))
            whole = [*held, {k: v[:last] for k, v in fresh.items()}]
            held = [{k: v[last:] for k, v in fresh.items()}]
            yield met({k: np.concatenate([x[k] for x in whole]) for k in fresh})
        if held:
            yield met({k: np.concatenate([x[k] for x in held]) for k in held[0]})

    dealt = postings.select(*names, "parity").repartition(partitions(postings.sparkSession), "key").sortWithinPartitions("key", "n", "node")
    pairs = dealt.mapInArrow(run, "a long, b long, label_a long, label_b long, apart long")
    if take == "all":
        return pairs.distinct()
    if take == "best":
        row = F.struct("apart", "a", "b", "label_a", "label_b")
        each = pairs.select(F.explode(F.array("label_a", "label_b")).alias("label"), row.alias("row"))
        return each.groupBy("label").agg(F.min("row").alias("row")).select("row.a", "row.b", "row.label_a", "row.label_b", "row.apart").distinct()
    best = pairs.groupBy("label_a", "label_b").agg(F.min(F.struct("apart", "a", "b")).alias("best"))
    return best.select("best.a", "best.b", "label_a", "label_b", "best.apart")


def met_by_prefix(postings: DataFrame, members: DataFrame, percent: int, take: str) -> DataFrame:
    """``meetings`` of ``members`` (node, n, parity, label) by their ``postings`` (key, at, node)."""
    named = postings.select("key", "at", "node").join(members.select("node", "n", "label"), "node")
    begins = F.max(leading(F.col("n"), F.col("at"), percent)).alias("begins")
    counts = named.groupBy("key").agg(F.count(F.lit(1)).alias("count"), (F.min("label") < F.max("label")).alias("mixed"), begins)
    mixed = stored(counts.where("mixed AND begins").select("key", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")), "mixed")
    hot, rest = stored(mixed.where("blocks > 1"), "hot"), mixed.where("blocks = 1").select("key")
    postings, members = postings.select("key", "at", "node"), members.select("node", "n", "parity", "label")
    dealt = postings.join(rest, "key").join(members, "node").withColumn("side", F.lit(0))
    if not hot.isEmpty():  # as many as all postings by BLOCK at most
        own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
        few = F.broadcast(hot) if hot.count() <= BROADCAST_KEYS else hot
        blocks = postings.join(few, "key").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
        blocks = blocks.withColumn("side", side).withColumn("key", F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")))
        dealt = dealt.unionByName(blocks.select("key", "at", "node", "side").join(members, "node"))
    return meetings(dealt, percent, take)


def linked_labels(postings: DataFrame, members: DataFrame, percent: int, confirm: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Links (a, b) of labels that connect ``members`` (node, n, parity, marks, label) as all links between them would.

    Nodes meet by a shared key of ``postings`` (key, at, node). ``confirm`` gives the linked rows of pairs (a, b and others). First
    each label is compared with the one it comes nearest to, as long as that links many: families of near copies
    become one label at the cost of their members, not of their pairs. Then the nearest nodes of each pair of labels
    are compared, and labels that this leaves apart by all pairs of nodes.
    """
    links, take = None, "best"
    while take:
        pairs = met_by_prefix(postings, members, percent, take).select("a", "b", "label_a", "label_b")
        pairs = stored(plausible(pairs, members.select("node", "n", "marks"), percent), "meetings")
        found = stored(confirm(pairs).select("label_a", "label_b").distinct().toDF("a", "b"), "hidden")
        discard(pairs)
        links = found if links is None else links.union(found)
        n_found = found.count()
        if n_found and take != "all":
            n_labels = members.select("label").distinct().count() if take == "best" else 0
            members = stored(relabelled(members, components(found)), "members")
            if n_found * FEW_LINKS >= n_labels > 0:
                continue
        take = {"best": "nearest", "nearest": "all", "all": ""}[take]
    return links


def hidden_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``linked_labels`` by an exact join of the prefixes of the members' ``sets``."""
    own = sets.join(members.select("node"), "node", "left_semi")
    postings = stored(postings_of(own, percent, common_shingles(own)), "postings")
    links = linked_labels(postings, members, percent, lambda pairs: confirmed(pairs, sets, percent))
    discard(postings)
    return links


def with_components(rows: DataFrame, named: DataFrame) -> DataFrame:
    """``_row, doc_id, n_shingles, component_id, kept`` of documents ``rows`` (_row, doc_id, n, digest): see ``near_duplicates``.

    named: ``digest, first, size, label`` of each set, its documents' least and their number, and its component.
    """
    n_rows = rows.count()
    named = stored(named.select("digest", "first", "size", "label"), "components")
    of_component = named.groupBy("label").agg(F.min("first").alias("least"), F.count(F.lit(1)).alias("nodes"))
    # Components may be large: the few that hold many nodes go to every task.
    labelled = join_groups(named.select("digest", "size", "label"), of_component, "label", "nodes", n_rows).select("digest", "size", F.col("least").alias("first"))
    labelled = stored(labelled, "labelled")
    whole = join_groups(rows.where("n > 0").select("_row", "doc_id", "n", "digest"), labelled, "digest", "size", n_rows)
    whole = whole.select("_row", "doc_id", F.col("n").alias("n_shingles"), F.col("first.doc_id").alias("component_id"), (F.col("_row") == F.col("first._row")).alias("kept"))
    empty = rows.where("n = 0").select("_row", "doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"))
    return whole.unionByName(empty)


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, key: str = "") -> DataFrame:
    """A row per document: ``_row, doc_id, n_shingles, component_id, kept``.

    docs: ``doc_id``, ``text`` and any other columns; key: the one that ``keyed`` added, which ``_row`` repeats. Words are what lies
    between ASCII white space after lower-casing A-Z; a document's set are its distinct shingles of ``width`` words,
    of fewer words their whole sequence. Documents are linked if 100 * intersection >= percent * union.
    ``component_id`` is the least ``doc_id`` that links reach, the document's own included; ``kept`` marks the documents
    with that id (of repeated rows, one). Empty and null texts have no shingles and no links. Null ids
    are greater than all others. An empty table gives no rows.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    wanted = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")]
    ids = docs.select(*(F.col(c).alias("_row") for c in quoted([key])), *wanted) if key else keyed(docs.select(*wanted), "_row")
    rows = stored(features(ids, width), "features")
    first = F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "_row"))
    groups = rows.where("n > 0").groupBy("digest").agg(first.alias("first"), F.count(F.lit(1)).alias("size"), F.min(F.struct("_row", "n", "sig", "parity", "marks")).alias("rep"))
    # Numbers are written with the nodes, so they stay.
    nodes = stored(groups.select(F.monotonically_increasing_id().alias("node"), "digest", "first", "size", "rep.*"), "nodes")
    near = stored(neighbours(nodes, percent), "near")
    needed = near.select("a").union(near.where("b IS NOT NULL").select("b")).distinct().toDF("node").join(nodes.select("node", "_row"), "node")
    needed = stored(needed, "needed")
    sets = stored(shingles(ids.join(F.broadcast(needed) if needed.count() <= BROADCAST_KEYS else needed, "_row"), width), "sets")
    links = stored(confirmed(plausible(near.where("b IS NOT NULL"), nodes, percent), sets, percent), "links")
    named = nodes.select("node", "n", "parity", "marks", "digest", "first", "size", F.col("node").alias("label"))
    if not links.isEmpty():
        named = relabelled(named, components(links))
    named = stored(named, "named")
    members = stored(named.join(near.where("b IS NULL").select(F.col("a").alias("node")), "node", "left_semi").select("node", "n", "parity", "marks", "label"), "members")
    if not members.isEmpty():
        hidden = hidden_links(members, sets, percent)
        if not hidden.isEmpty():
            named = relabelled(named, components(hidden))
    for done in (near, needed, sets, links, members):
        discard(done)
    return with_components(rows, named)
