"""Prefix trie of conversations: a row per distinct beginning of turns, with what sharing it saves.

A conversation's path are its beginnings of 0, 1, 2, ... turns, each known by a running digest: the XOR of its turns'
SHA-256 digests, every turn with its place. A beginning shared by several conversations is one node, owned by the
smallest of them. As that one is the smallest for all nodes below on its path too, a conversation owns a suffix of its
path, and every node is owned exactly once. So nothing has to walk the tree: below a node lie the owned suffixes of its
members. For each member and depth a window sums the words of the turns from there on that the member does not own; one
group-by of prefixes adds up these sums, the members that own the child below, and the members that own a leaf.

A long conversation is split: positions and running digests or sums are found in segments and put together by
the segments' totals, so that no task holds one whole.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import join_groups, partitions, stored

#: Turns of a segment.
SEGMENT = 1024
#: Bytes of member ids that one row carries to where they are digested.
RUN_BYTES = 1 << 20
#: Conversations are dealt in families: the first turns of the multiple of this number at or before an id (towards zero)
#: stand before the others'. How many follows from the id's CRC-32: 0 to HEADS - 1.
FAMILY, HEADS = 20, 4
_LANES = ("p0", "p1", "p2", "p3")


def numbered(rows: DataFrame, key: str, order: list[str], kept: dict[str, Column], name: str) -> DataFrame:
    """``key``, the columns ``kept`` and the place from 0 of each row among those of the same ``key`` by ``order`` (nulls first), stored.

    Rows are sorted over all tasks by key and order; each task numbers its own, and the few keys that reach over several
    tasks go on where the task before ended.
    """
    # Equal rows are alike, so any split of them will do.
    by = [F.asc_nulls_first(c) for c in (key, *order, "_tie")]
    dealt = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(partitions(rows.sparkSession), *by).sortWithinPartitions(*by)
    # What is kept is worked out behind the sort, which looks at the rows twice.
    dealt = stored(dealt.select(key, *(c.alias(n) for n, c in kept.items()), F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")), "dealt")
    counts = dealt.groupBy(key, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # At most one key reaches into a task from those before it.
    shift = counts.withColumn("_before", F.sum("_n").over(before)).where("_before > 0").select(key, "_part", "_before")
    own = F.row_number().over(Window.partitionBy("_part", key).orderBy("_at")) - 1
    placed = dealt.withColumn("_own", own).join(F.broadcast(shift), [key, "_part"], "left")
    return stored(placed.select(key, *kept, (F.col("_own") + F.coalesce("_before", F.lit(0))).cast("long").alias(name)), "numbered")


def running(rows: DataFrame, key: str, place: str, found: dict[str, tuple], backwards: bool = False) -> DataFrame:
    """``rows`` with ``{name: (aggregate, column)}`` over the rows of the same ``key`` up to the own place (``backwards``: from it on).

    Places count from 0. The aggregate may be F.sum or F.bit_xor, whose totals of segments are put together by itself.
    """
    segment = F.floor(F.col(place) / SEGMENT).alias("_segment")
    cut = rows.withColumn("_segment", segment)
    direction = F.desc if backwards else F.asc
    inside = Window.partitionBy(key, "_segment").orderBy(direction(place)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = cut.groupBy(key, "_segment").agg(*(agg(c).alias(f"_{name}") for name, (agg, c) in found.items()))
    before = Window.partitionBy(key).orderBy(direction("_segment")).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(key, "_segment", *(agg(f"_{name}").over(before).alias(f"_{name}") for name, (agg, _) in found.items()))
    local = cut.withColumns({name: agg(c).over(inside) for name, (agg, c) in found.items()})
    joined = local.join(totals, [key, "_segment"])
    both = {}
    for name, (agg, _) in found.items():
        carried = F.coalesce(f"_{name}", F.lit(0))
        both[name] = F.col(name) + carried if agg is F.sum else F.col(name).bitwiseXOR(carried)
    return joined.withColumns(both).select(*rows.columns, *found)


def rebuilt(conversations: DataFrame) -> DataFrame:
    """``conv_id, depth, digest, words`` of all conversations as rebuilt; ``depth`` counts from 1. A turnless one has no row.

    ``digest`` stands for role and text, ``words`` counts the text's. See ``prefix_trie`` for what becomes of nulls and ties.
    """
    empty = F.lit("")
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), empty).alias("role"), F.coalesce(F.col("text").cast("string"), empty).alias("text"),
    )
    # The length keeps role and text apart.
    digest = F.sha2(F.concat_ws(":", F.octet_length("role").cast("string"), "role", "text"), 256)
    words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    turns = numbered(turns, "conv_id", ["turn", "role", "text"], {"digest": digest, "words": words}, "place")
    sizes = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"))
    asked = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(HEADS)).cast("int")
    convs = sizes.select("conv_id", "turns", asked.alias("asked"), (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"))
    known = sizes.select(F.col("conv_id").alias("base"), F.col("turns").alias("offered"))
    got = F.least("asked", F.coalesce("offered", F.lit(0))).alias("got")
    convs = stored(convs.join(known, "base", "left").select("conv_id", "turns", "asked", "base", got), "convs")
    # A head has fewer than 2 * FAMILY conversations that may take its HEADS - 1 turns.
    heads = turns.where(F.col("place") < HEADS - 1).withColumnRenamed("conv_id", "base")
    taken = heads.join(convs.drop("turns"), "base").where(F.col("place") < F.col("got"))
    own = join_groups(turns, convs.drop("base"), "conv_id", "turns", turns.count()).where(F.col("place") >= F.col("asked"))
    own = own.select("conv_id", (F.col("place") - F.col("asked") + F.col("got") + 1).alias("depth"), "digest", "words")
    return taken.select("conv_id", (F.col("place") + 1).alias("depth"), "digest", "words").unionByName(own)


def paths(conversations: DataFrame) -> DataFrame:
    """``conv_id, depth, p0, p1, p2, p3, words, size`` of each beginning of each conversation, from depth 0; stored.

    The four numbers are the beginning's digest, ``words`` counts its last turn's, ``size`` the conversation's turns.
    """
    digest = F.sha2(F.concat_ws(":", F.col("depth").cast("string"), "digest"), 256)
    part = lambda i: F.conv(F.substr("placed", F.lit(16 * i + 1), F.lit(16)), 16, -10).cast("long")
    turns = rebuilt(conversations).withColumn("placed", digest).select("conv_id", "depth", *(part(i).alias(c) for i, c in enumerate(_LANES)), "words")
    zero = F.lit(0).cast("long")
    ids = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    roots = ids.select("conv_id", zero.alias("depth"), *(zero.alias(c) for c in _LANES), zero.alias("words"))
    every = stored(turns.unionByName(roots), "turns")
    run = running(every, "conv_id", "depth", {f"x{c}": (F.bit_xor, F.col(c)) for c in _LANES})
    whole = stored(run.select("conv_id", "depth", *(F.col(f"x{c}").alias(c) for c in _LANES), "words"), "beginnings")
    sizes = whole.groupBy("conv_id").agg(F.max("depth").alias("size"), F.count(F.lit(1)).alias("rows"))
    return stored(join_groups(whole, sizes, "conv_id", "rows", whole.count()).drop("rows"), "paths")


def _node() -> Column:
    return F.struct("depth", *_LANES)


def ends(members: DataFrame) -> DataFrame:
    """``node, ends_sha256`` of rows ``node, conv_id``: the digest of the ids, ascending, with commas between.

    Ids are sorted and written out by all tasks; only the digest itself, which can't be split, takes a node's runs one after another.
    """
    spark = members.sparkSession

    def write(batches):
        held, first, made, size = None, 0, [], 0
        for batch in batches:
            out = []
            for node, conv in zip(batch.column("key").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
                if held is not None and (node != held or size >= RUN_BYTES):
                    out.append((held, first, ",".join(made)))
                    held = None
                if held is None:
                    held, first, made, size = node, conv, [], 0
                text = str(conv)
                made.append(text)
                size += len(text) + 1
            yield rows(out)
        if held is not None:
            yield rows([(held, first, ",".join(made))])

    def rows(out):
        columns = list(zip(*out, strict=True)) or [[]] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.string()), strict=True)], names=["key", "first", "ids"])

    def digest(batches):
        held, sha = None, None
        for batch in batches:
            out = []
            for node, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if node != held:
                    if held is not None:
                        out.append((held, sha.hexdigest()))
                    held, sha = node, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.string()) for i in (0, 1)], names=["key", "ends_sha256"])
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.string()) for x in (held, sha.hexdigest())], names=["key", "ends_sha256"])

    keyed = members.select(F.concat_ws(":", "node.*").alias("key"), "node", "conv_id")
    nodes = keyed.select("key", "conv_id").repartitionByRange(partitions(spark), "key", "conv_id").sortWithinPartitions("key", "conv_id")
    runs = nodes.mapInArrow(write, "key string, first long, ids string").repartition(partitions(spark), "key").sortWithinPartitions("key", "first")
    return runs.mapInArrow(digest, "key string, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``: a row per node.

    conversations: ``conv_id, turn, role, text`` and any other columns. Turns are ordered by ``turn``, nulls first, then by
    role and text, so repeated rows are turns of their own; null roles and texts are empty. Rows without a ``conv_id``
    belong to no conversation and are passed over. Each conversation is rebuilt with the first turns of its family's head, see
    ``FAMILY``. A node is named by its smallest member and its depth. Conversations may hold any number of turns of any
    length. An empty table has no conversations and so no nodes, not even a root.
    """
    path = paths(conversations)
    n_rows = path.count()
    owners = stored(path.groupBy(_node().alias("node")).agg(F.min("conv_id").alias("owner"), F.max("size").alias("deepest"), F.count(F.lit(1)).alias("members")), "owners")
    marked = join_groups(path.select(_node().alias("node"), "conv_id", "words", "size"), owners, "node", "members", n_rows)
    own = F.col("owner") == F.col("conv_id")
    marked = marked.select("node", F.col("node.depth").alias("depth"), "conv_id", "owner", own.alias("own"), "words", "size", (own & (F.col("deepest") == F.col("size"))).alias("leaf"))
    marked = stored(marked, "marked")
    here = F.when(F.col("leaf") & (F.col("depth") == F.col("size")), F.lit(1)).otherwise(F.lit(0)).cast("long")
    shared = F.when(F.col("own"), F.lit(0).cast("long")).otherwise(F.col("words"))
    sums = running(marked, "conv_id", "depth", {"saved": (F.sum, shared), "leaves": (F.sum, here)}, backwards=True)
    # What stands next to a row on its path: the node above and the one below.
    below = F.struct((F.col("depth") + 1).alias("depth"), F.col("owner").alias("above"), F.lit(None).cast("boolean").alias("below"))
    above = F.struct((F.col("depth") - 1).alias("depth"), F.lit(None).cast("long").alias("above"), F.col("own").alias("below"))
    beside = marked.select("conv_id", F.explode(F.array(below, above)).alias("x")).select("conv_id", "x.*")
    beside = beside.groupBy("conv_id", "depth").agg(F.max("above").alias("above"), F.max("below").alias("below"))
    nodes = sums.join(beside, ["conv_id", "depth"], "left").groupBy("node").agg(
        F.min("conv_id").alias("conv_id"), F.max("above").alias("parent_conv_id"), F.count(F.lit(1)).alias("n_convs"),
        F.coalesce(F.sum(F.col("below").cast("long")), F.lit(0)).alias("n_children"), F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"),
    )
    digests = ends(marked.where("depth = size").select("node", "conv_id"))
    nodes = nodes.withColumn("key", F.concat_ws(":", "node.*")).join(digests, "key", "left")
    return nodes.select(
        "conv_id", F.col("node.depth").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )
