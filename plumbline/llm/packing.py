"""Best-fit packing by bin completion.

Documents become pieces of at most ``capacity`` tokens. Pieces that are not full are dealt by hash into groups of a
bounded size, and each group is packed on its own: a group needs at most about one sequence more
than its share of a joint packing, whatever the size of the corpus, and no task ever sees more than
one group. Within a group only the lengths matter, so the search runs over a histogram of lengths.

Bin completion: take the longest piece left, list fillings of the room beside it in order of waste,
none dominated by another, and go on with each in turn, cutting branches whose total waste already
rules out a better result than the incumbent. Best-fit decreasing gives the first incumbent; the search
ends at a lower bound that no packing can beat, or when its budget of steps is spent.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import bounded_batches, stored
from plumbline.llm.tokens import document_ids

CAPACITY = 2048
#: Pieces of one group, on average; full ones need no group.
GROUP_PIECES = 16_384
#: The budget of the search over one group: packings begun, pieces tried for fillings in all and at one branching.
SEARCH_STEPS, SEARCH_NODES, FILLING_NODES = 64, 250_000, 96

Bins = list[tuple[tuple[int, ...], int]]


def _fitting(mask: int, room: int) -> int:
    """The largest length of the set ``mask`` that is at most ``room``; 0 if there is none."""
    return (mask & ((1 << (room + 1)) - 1)).bit_length() - 1 if mask & ((1 << (room + 1)) - 2) else 0


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> Bins:
    """Each piece, longest first, goes into the fullest sequence with room for it."""
    open_bins: dict[int, list[list[int]]] = {}
    mask, done = 0, []
    for size in sorted(counts, reverse=True):
        for _ in range(counts[size]):
            above = mask >> size
            if above:
                room = size + (above & -above).bit_length() - 1
                contents = open_bins[room].pop()
                if not open_bins[room]:
                    mask &= ~(1 << room)
            else:
                room, contents = capacity, []
            contents.append(size)
            if room > size:
                open_bins.setdefault(room - size, []).append(contents)
                mask |= 1 << (room - size)
            else:
                done.append(contents)
    return [(tuple(b), 1) for bins in [done, *open_bins.values()] for b in bins]


def _dominated(counts: list[int], mask: int, chosen: tuple[int, ...], slack: int) -> bool:
    """Whether a piece left out could take the place of none, one or several of the chosen ones and waste less, or as little with fewer pieces."""
    for size in set(chosen):
        if chosen.count(size) >= counts[size]:
            mask &= ~(1 << size)
    sums = {0: 0}  # sums of some of the chosen, and of how many at most
    for size in chosen:
        for total, n in list(sums.items()):
            sums[total + size] = max(sums.get(total + size, 0), n + 1)
    return any(mask >> (total + (n < 2)) & ((1 << (slack + (n > 1))) - 1) for total, n in sums.items())


def fillings(counts: list[int], mask: int, mirror: int, room: int, exact: bool = True, nodes: int = FILLING_NODES) -> tuple[list[tuple[int, ...]], int]:
    """Undominated fillings of ``room`` by pieces of the lengths in ``mask``, the least waste first, and how many pieces were tried.

    mirror: ``mask`` from the other end, bit ``len(counts) - 1 - s`` for a length ``s``. A filling dominates another whose pieces
    fit into the places of its own; one piece that fills the room dominates all. They are enumerated from the longest
    pieces down; the search ends after trying ``nodes`` pieces. exact: pairs that fill what is left are taken at once.
    """
    one = _fitting(mask, room)
    if not one or one == room:
        return [(one,) if one else ()], 1
    found: dict[tuple[int, ...], int] = {}
    stack: list[tuple[tuple[int, ...], int, int]] = [((), room, room)]  # chosen, room left, longest piece still to be tried
    tried = 0
    while stack and tried < nodes:
        chosen, left, most = stack.pop()
        pairs = mask & (mirror >> (len(counts) - 1 - left)) & ((1 << (most + 1)) - 1) if exact else 0
        if pairs:
            a = pairs.bit_length() - 1
            pair = (a, left - a) if a >= left - a else (left - a, a)
            if pair[0] <= most and all(chosen.count(x) + pair.count(x) <= counts[x] for x in pair):
                found.setdefault((*chosen, *pair), 0)
        size = _fitting(mask, min(left, most))
        while size and chosen.count(size) >= counts[size]:
            size = _fitting(mask, size - 1)
        if size:
            tried += 1
            stack += [(chosen, left, size - 1), ((*chosen, size), left - size, size)]
        elif not _dominated(counts, mask, chosen, left):
            found[chosen] = left
    if not found:  # every one tried so far is dominated: take what best fit would
        chosen, left = (), room
        while size := _fitting(mask, left):
            while size and chosen.count(size) >= counts[size]:
                size = _fitting(mask, size - 1)
            if not size:
                break
            chosen, left = (*chosen, size), left - size
        found[chosen] = left
    return [f for f, _ in sorted(found.items(), key=lambda x: (x[1], [-s for s in x[0]]))], max(1, tried)


def least_bins(counts: list[int], capacity: int) -> int:
    """A number of sequences that no packing can go below.

    Two bounds: setting aside pieces below each threshold, and counting each piece as the share of a sequence that
    pieces of its length take at least, if a sequence holds k shares (for many k).
    """
    n = np.array(counts, "i8")
    sizes = np.arange(capacity + 1)
    held = n * sizes
    many, much = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(held)])
    half = capacity // 2
    small = np.arange(half + 1)
    above_half = many[-1] - many[half + 1]
    room = (many[capacity - small + 1] - many[half + 1]) * capacity - (much[capacity - small + 1] - much[half + 1])
    need = much[half + 1] - much[small] - room
    best = int((above_half + np.maximum(0, -(-need // capacity))).max())
    for k in range(1, 33):  # in units of 1 / (k * capacity)
        shares = (k + 1) * sizes
        units = np.where(shares % capacity == 0, k * sizes, shares // capacity * capacity)
        best = max(best, -(-int((n * units).sum()) // (k * capacity)))
    return best


def bin_completion(lengths: dict[int, int], capacity: int = CAPACITY, steps: int = SEARCH_STEPS) -> Bins:
    """Packs pieces, given as counts by length; returns (contents, how often) with as few sequences as found.

    Lengths must lie between 1 and the capacity.
    """
    if any(not 0 < s <= capacity for s in lengths):
        raise ValueError("lengths must lie between 1 and the capacity")
    full: Bins = [((capacity,), lengths[capacity])] if lengths.get(capacity) else []
    counts = [lengths.get(s, 0) if s < capacity else 0 for s in range(capacity + 1)]
    total = sum(s * n for s, n in enumerate(counts))
    if not total:
        return full
    least = least_bins(counts, capacity)
    best = best_fit_decreasing({s: n for s, n in enumerate(counts) if n}, capacity)
    used = sum(n for _, n in best)
    # Each entry: the choices to deviate at (number of the bin: rank of its filling), and how fillings are listed; depth-first, limited discrepancies.
    agenda: list[tuple[dict[int, int], bool]] = [({}, False)]
    nodes = SEARCH_NODES
    while agenda and used > least and steps and nodes > 0:
        steps -= 1
        swaps, exact = agenda.pop()
        left, mask, mirror = counts[:], sum(1 << s for s, n in enumerate(counts) if n), sum(1 << (capacity - s) for s, n in enumerate(counts) if n)
        bins, n_bins, waste, at, close, last = [], 0, 0, 0, [], max(swaps, default=-1)
        allowed = (used - 1) * capacity - total
        while mask:
            big = mask.bit_length() - 1
            left[big] -= 1
            if not left[big]:
                mask, mirror = mask ^ (1 << big), mirror ^ (1 << (capacity - big))
            options, tried = fillings(left, mask, mirror, capacity - big, exact)
            nodes -= tried
            pick = options[min(swaps.get(at, 0), len(options) - 1)]
            if at > last:
                close += [(at, k) for k in range(len(options) - 1, 0, -1)]
            contents = (big, *pick)
            times = min([(left[s] + (s == big)) // contents.count(s) for s in set(contents)])
            for s in contents:
                left[s] -= times - (s == big)
                if s == big:
                    big = 0  # its first one has been taken already
            for s in set(contents):
                if not left[s] and mask >> s & 1:
                    mask, mirror = mask ^ (1 << s), mirror ^ (1 << (capacity - s))
            bins.append((contents, times))
            n_bins += times
            waste += times * (capacity - sum(contents))
            at += 1
            if mask and waste > allowed:
                break
        else:
            if n_bins < used:
                best, used = bins, n_bins
        # The latest alternatives are tried first, so no more than the steps left can be reached.
        agenda = (agenda + [(swaps | {spot: k}, exact) for spot, k in close[-steps:]])[-steps:] if steps else []
        if len(swaps) == 0 and exact is False:
            agenda.append(({}, True))  # the other listing's own first packing comes next
    return full + best


def pieces_of(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: each document's ids with the end id, cut only if longer than ``capacity``.

    A longer document is cut so that all pieces but the first are full. Null texts count as empty
    (one piece of one id); repeated rows give repeated pieces; other columns are ignored.
    """
    bounded_batches(docs.sparkSession)

    def cut(batches):
        for batch in batches:
            out = []
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), document_ids(tokenizer_path, batch.column("text").to_pylist()), strict=True):
                n, start = len(ids) // 4, 0
                for piece in range(-(-n // capacity)):
                    length = capacity if piece or n % capacity == 0 else n % capacity
                    out.append((doc_id, piece, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])))
                    start += length
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(list(zip(*out)) or [[]] * 5, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to the rows of ``pieces_of``; offsets of a sequence have no gaps.

    Full pieces are sequences of their own. The others are dealt by a number that is written with them, so equal rows,
    however many, spread over all groups. An empty table gives no rows.
    """

    def place(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_number", kind="stable")
        sizes = pdf["length"].to_numpy()
        spots: dict[int, list[tuple[int, int]]] = {}
        bin_no = 0
        for contents, times in bin_completion({int(s): int(n) for s, n in zip(*np.unique(sizes, return_counts=True), strict=True)}, capacity):
            for _ in range(times):
                at = 0
                for s in contents:
                    spots.setdefault(s, []).append((bin_no, at))
                    at += s
                bin_no += 1
        placed = [spots[s].pop() for s in sizes.tolist()]
        pdf["sequence_id"] = [(int(key[0]) << 32) + b for b, _ in placed]
        pdf["offset"] = [o for _, o in placed]
        return pdf.drop(columns=["_group", "_number"])

    rest = ["piece", "start", "length", "ids_crc32"]
    rows = stored(pieces.select("doc_id", *rest, F.monotonically_increasing_id().alias("_number")), "pieces")
    loose = rows.where(F.col("length") < capacity)
    group = F.pmod(F.xxhash64("_number"), F.lit(max(1, -(-loose.count() // GROUP_PIECES))))
    # pandas has no null among integers, so a null id travels as a flag.
    loose = loose.select(F.coalesce("doc_id", F.lit(0)).alias("_id"), F.isnull("doc_id").alias("_null"), *rest, "_number", group.alias("_group"))
    placed = loose.groupBy("_group").applyInPandas(place, "_id long, _null boolean, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    placed = placed.select(F.when(~F.col("_null"), F.col("_id")).alias("doc_id"), *rest, "sequence_id", "offset")
    full = rows.where(F.col("length") == capacity).select("doc_id", *rest, (-1 - F.col("_number")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return placed.unionByName(full)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents with their places: see ``pieces_of`` and ``pack``."""
    return pack(pieces_of(docs, tokenizer_path, capacity), capacity)
