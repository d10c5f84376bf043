"""Exact deduplication against a history held in minimal perfect hash tables.

A text is known by the SHA-256 of its bytes after lower-casing A-Z. Digests fall into buckets by
their leading bits. Each bucket of the history is a minimal perfect hash table: its slots hold the
full digest and a locator of the winner, so a lookup is one probe and a comparison of all 32 bytes.
Digests of a delivery that are members of the history join their slot's group; the others are
grouped on their own. Rows are summed up by digest before anything is shuffled, so a text repeated
over a third of the corpus is one row per task; no bucket holds more than its share of distinct
digests.
"""

from __future__ import annotations

import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import join_groups, keyed, quoted, stored

#: Distinct digests of one bucket, on average.
BUCKET_DIGESTS = 32_768
#: Stands for a null id, which loses against any other.
NO_ID = -(2**63)


class PerfectHash:
    """A minimal perfect hash table over distinct 32-byte digests, with each digest in its slot.

    Built in levels: every level hashes the digests left into a bit array, keeps those that fall
    alone, and passes the rest on. A digest's slot is the rank of its bit over all levels.
    """

    GAMMA = 2.0

    def __init__(self, digests: np.ndarray):
        """digests: distinct, of dtype S32 or (n, 32) bytes."""
        raw = np.ascontiguousarray(digests).view(np.uint8).reshape(-1, 32)
        words = raw.view("<u8").reshape(-1, 4)
        self.levels: list[np.ndarray] = []
        left, where = np.arange(len(raw)), np.full(len(raw), -1, "i8")
        base = 0
        while len(left):
            size = max(64, int(self.GAMMA * len(left)))
            at = self._hash(words[left], len(self.levels), size)
            alone = np.bincount(at, minlength=size) == 1
            hit = alone[at]
            ranks = np.cumsum(alone)
            where[left[hit]] = base + ranks[at[hit]] - 1
            base += int(ranks[-1])
            self.levels.append(alone)
            left = left[~hit]
            if len(self.levels) > 200:
                raise ValueError("the digests are not distinct")
        self.starts = np.cumsum([0, *(int(x.sum()) for x in self.levels)])
        self.ranks = [np.cumsum(x) for x in self.levels]
        self.slots = np.zeros((len(raw), 32), np.uint8)
        self.slots[where] = raw
        self.order = np.argsort(where, kind="stable")  # slot -> index of the input

    @staticmethod
    def _hash(words: np.ndarray, level: int, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = words[:, 1] ^ (words[:, 2] * np.uint64(2 * level + 1)) ^ np.uint64(level * 0x9E3779B97F4A7C15 & (2**64 - 1))
            x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            return ((x ^ (x >> np.uint64(32))) % np.uint64(size)).astype("i8")

    def lookup(self, digests: np.ndarray) -> np.ndarray:
        """The slot of each digest, -1 for those that are no members: all 32 bytes are compared."""
        raw = np.ascontiguousarray(digests).view(np.uint8).reshape(-1, 32)
        words = raw.view("<u8").reshape(-1, 4)
        out, left = np.full(len(raw), -1, "i8"), np.arange(len(raw))
        for level, bits in enumerate(self.levels):
            at = self._hash(words[left], level, len(bits))
            hit = bits[at]
            out[left[hit]] = self.starts[level] + self.ranks[level][at[hit]] - 1
            left = left[~hit]
        found = out >= 0
        same = (self.slots[out[found]] == raw[found]).all(axis=1)
        out[np.flatnonzero(found)[~same]] = -1
        return out


def digest_of(text: F.Column) -> F.Column:
    """SHA-256 of the text in UTF-8, A-Z lower-cased; null counts as empty."""
    lowered = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.unhex(F.sha2(lowered.cast("binary"), 256))


def summed(rows: DataFrame) -> DataFrame:
    """One row per digest: the locator of its winner, the row with the largest (doc_id, _row), and its size."""
    return rows.groupBy("digest").agg(F.max(F.struct("doc_id", "_row")).alias("winner"), F.count(F.lit(1)).alias("size"))


GROUPS = "digest binary, doc_id long, file long, at long, size long"


def against_history(history: DataFrame, delivery: DataFrame, n_buckets: int) -> DataFrame:
    """Groups (digest, winner doc_id, file and at, size) of two tables of ``summed`` rows.

    Each bucket of ``history`` becomes a perfect hash table; the bucket's digests of ``delivery`` are
    looked up in it. Either side may be empty.
    """

    def bucketed(groups: DataFrame) -> DataFrame:
        lead = F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long")
        return groups.select((lead % n_buckets).alias("bucket"), "digest", F.coalesce("winner.doc_id", F.lit(NO_ID)).alias("doc_id"), "winner._row.*", "size")

    def digests(rows: pa.Table) -> np.ndarray:
        return np.frombuffer(b"".join(rows.column("digest").to_pylist()), np.uint8).reshape(-1, 32)

    def join(old: pa.Table, new: pa.Table) -> pa.Table:
        index = PerfectHash(digests(old))
        found = digests(new)
        slot = index.lookup(found) if len(found) else np.zeros(0, "i8")
        member = slot >= 0
        names = ("doc_id", "file", "at", "size")
        winner = {c: old.column(c).to_numpy()[index.order] for c in names}  # in the order of the slots
        theirs = {c: new.column(c).to_numpy() for c in names}
        at, met = slot[member], {c: v[member] for c, v in theirs.items()}
        same_id, same_file = met["doc_id"] == winner["doc_id"][at], met["file"] == winner["file"][at]
        later = (met["doc_id"] > winner["doc_id"][at]) | (same_id & ((met["file"] > winner["file"][at]) | (same_file & (met["at"] > winner["at"][at]))))
        for c in ("doc_id", "file", "at"):
            winner[c][at[later]] = met[c][later]
        winner["size"][at] += met["size"]
        both = np.concatenate([index.slots, found[~member]])
        packed = pa.Array.from_buffers(pa.binary(32), len(both), [None, pa.py_buffer(np.ascontiguousarray(both))])
        return pa.table({"digest": packed.cast(pa.binary())} | {c: np.concatenate([winner[c], theirs[c][~member]]) for c in names})

    return bucketed(history).groupBy("bucket").cogroup(bucketed(delivery).groupBy("bucket")).applyInArrow(join, GROUPS)


def deduplicate(docs: DataFrame, history: DataFrame | None = None, key: str = "") -> DataFrame:
    """A row per document: ``_row, doc_id, digest, keep_id, group_size, kept``.

    docs: ``doc_id``, ``text`` and any other columns; key: the one that ``keyed`` added, which ``_row``
    repeats. Of equal texts the row with the largest ``doc_id`` stays, a null id being the least; of repeated rows
    with that id, one. Null texts equal empty ones. An empty table gives no rows. history: earlier documents of
    the same form; without it the rows with an even ``doc_id`` count as the history of the others, so that
    groups of both kinds go through the tables.
    """

    def digested(table: DataFrame, key: str = "") -> DataFrame:
        wanted = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")]
        rows = table.select(*(F.col(c).alias("_row") for c in quoted([key])), *wanted) if key else keyed(table.select(*wanted), "_row")
        return rows.select("_row", "doc_id", digest_of(F.col("text")).alias("digest"))

    rows = stored(digested(docs, key), "digests")
    n_rows = rows.count()
    if history is None:
        first = F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(2)) == 0
        old, new = summed(rows.where(first)), summed(rows.where(~first))
    else:  # places of earlier rows are negative
        earlier = digested(history).withColumn("_row", F.struct("_row.file", (-1 - F.col("_row.at")).alias("at")))
        old, new = summed(earlier), summed(rows)
    groups = stored(against_history(old, new, max(1, -(-n_rows // BUCKET_DIGESTS))), "groups")
    keep = [F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("keep_id"), F.struct("file", "at").alias("keep_row")]
    found = join_groups(rows, groups.select("digest", *keep, F.col("size").alias("group_size")), "digest", "group_size", n_rows)
    return found.select("_row", "doc_id", "digest", "keep_id", "group_size", (F.col("_row") == F.col("keep_row")).alias("kept"))
