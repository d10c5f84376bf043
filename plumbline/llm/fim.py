"""Fill-in-the-middle transformation: texts are cut into prefix, middle and suffix, and put in another order between sentinels.

One table of states by bytes drives both passes. The state knows how many continuation bytes of a UTF-8 character are
to come, how much of a sentinel has been read and, for lines, whether a unit has just ended; a transition says
whether it begins a unit and whether it completes a sentinel. Texts are laid out in lanes of bounded length that
step through the table together. A lane inside a text begins in the state that its last ``WARM_UP`` bytes lead to, which
is the true one, as neither a character nor a sentinel reaches back further. The first pass counts what the transitions
of each lane emit; the second walks again only through the lanes that hold a cut.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import bounded_batches

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Bytes of a lane.
LANE = 1024
#: Bytes before a lane that fix its first state: one less than the longest character and sentinel have.
WARM_UP = 3
#: Of a hundred texts with a cut, those that are transformed, and of these the ones with the suffix first.
RATE, SPM_RATE = 90, 20

#: Where a transition keeps the next state (in steps of 256), the begin of a unit and the end of a sentinel.
_STATE, _UNIT, _SENTINEL = 0xFFFF, 1 << 16, 1 << 17


@dataclass(frozen=True)
class Automaton:
    """``table[state + byte]``: the packed transition; states are multiples of 256, the first one is 0."""

    table: np.ndarray

    def step(self, states: np.ndarray, column: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        moved = self.table[states + column]
        return moved & _STATE, moved


@lru_cache(4)
def automaton(unit: str = "char") -> Automaton:
    """The table for units of characters (code points) or lines (up to and with their line feed).

    A byte that breaks a character ends it and counts as any byte does; a stray continuation byte begins no character.
    """
    if unit not in ("char", "line"):
        raise ValueError(f"no units named {unit}")
    sentinels = [s.encode() for s in (PREFIX, SUFFIX, MIDDLE)]
    parts = sorted({s[:n] for s in sentinels for n in range(len(s))}, key=lambda s: (len(s), s))
    keys = [(need, part, fresh) for fresh in ((False,) if unit == "char" else (True, False)) for need, part in [(0, p) for p in parts] + [(n, b"") for n in (1, 2, 3)]]
    number = {k: i * 256 for i, k in enumerate(keys)}
    table = np.zeros(len(keys) * 256, np.int64)
    for (need, part, fresh), at in number.items():
        for byte in range(256):
            follows = 0x80 <= byte < 0xC0
            read = part + bytes([byte])
            found = any(read.endswith(s) for s in sentinels)
            rest = next(p for p in sorted(parts, key=len, reverse=True) if read.endswith(p)) if not found else b""
            left = need - 1 if follows and need else 0 if byte < 0xC0 else 1 if byte < 0xE0 else 2 if byte < 0xF0 else 3
            begins = fresh if unit == "line" else not follows
            after = number[(left, b"" if left else rest, unit == "line" and byte == 10)]
            table[at + byte] = after | (_UNIT if begins else 0) | (_SENTINEL if found else 0)
    return Automaton(table)


class Lanes:
    """The bytes of several texts in lanes, longest first, and what a pass over them has counted."""

    def __init__(self, texts: list[bytes], machine: Automaton):
        self.machine = machine
        self.lengths = np.array([len(t) for t in texts], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])
        # Room behind and before: lanes and warm-ups may reach over the ends, where their bytes don't count.
        self.data = np.frombuffer(b"\0" * WARM_UP + b"".join(texts) + b"\0" * LANE, np.uint8)
        n_lanes = -(-self.lengths // LANE)
        self.text = np.repeat(np.arange(len(texts)), n_lanes)
        self.first = np.concatenate([[0], np.cumsum(n_lanes)])
        place = (np.arange(len(self.text)) - self.first[self.text]) * LANE if len(self.text) else np.zeros(0, np.int64)
        self.begin = self.starts[self.text] + place
        self.size = np.minimum(LANE, self.lengths[self.text] - place)
        self.state = np.zeros(len(self.text), np.int64)
        inner = np.flatnonzero(place > 0)
        for back in range(WARM_UP, 0, -1):
            self.state[inner], _ = machine.step(self.state[inner], self.data[self.begin[inner] + WARM_UP - back])
        self.units = np.zeros(len(self.text), np.int64)
        self.sentinels = np.zeros(len(self.text), np.int64)
        # A line begins where its text does, so the first state of a text is that of a line's end; inside, the bytes tell.

    def _walk(self, lanes: np.ndarray):
        """Steps the lanes (longest first) together: yields the place, how many of them go on, and their transitions."""
        states, at, sizes = self.state[lanes].copy(), self.begin[lanes] + WARM_UP, self.size[lanes]
        alive = len(lanes)
        ends = -sizes
        for i in range(int(sizes[0]) if len(lanes) else 0):
            alive = int(np.searchsorted(ends, -i, "left"))
            states[:alive], moved = self.machine.step(states[:alive], self.data[at[:alive] + i])
            yield i, alive, moved

    def count(self) -> tuple[np.ndarray, np.ndarray]:
        """First pass: units and sentinels of each text."""
        order = np.argsort(-self.size, kind="stable")
        total = np.zeros(len(order), np.int64)
        for _, alive, moved in self._walk(order):
            total[:alive] += moved >> 16 & 1 | (moved >> 17 & 1) << 32
        self.units[order], self.sentinels[order] = total & 0xFFFFFFFF, total >> 32
        n = len(self.lengths)
        return tuple(np.bincount(self.text, c, n).astype(np.int64) for c in (self.units, self.sentinels))

    def cut(self, text: np.ndarray, units: np.ndarray) -> np.ndarray:
        """Second pass: the byte in each of the named texts where the unit of that number (from 0) begins; its end if there is none."""
        before = np.concatenate([[0], np.cumsum(self.units)])
        wanted = units + before[self.first[text]]  # counted over the lanes of all texts
        lane = np.searchsorted(before, wanted, "right") - 1
        found = self.lengths[text].copy()
        inside = np.flatnonzero((lane < self.first[text + 1]) & (lane >= self.first[text]))
        inside = inside[np.argsort(-self.size[lane[inside]], kind="stable")]
        lanes = lane[inside]
        left = wanted[inside] - before[lanes]
        for i, alive, moved in self._walk(lanes):
            begins = moved >> 16 & 1
            here = np.flatnonzero((left[:alive] == 0) & (begins == 1))
            found[inside[here]] = self.begin[lanes[here]] - self.starts[text[inside[here]]] + i
            left[:alive] -= begins
        return found


def draws(ids: list[int | None], seed: int = 1) -> np.ndarray:
    """Four numbers of 32 bits for each id, from the SHA-256 of seed and id; a null id counts as an empty text."""
    found = b"".join(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).digest()[:16] for i in ids)
    return np.frombuffer(found, ">u4").reshape(-1, 4).astype(np.int64)


def transformed(texts: list[bytes], ids: list[int | None], unit: str = "char") -> list[tuple[int, str, int | None, int | None, bytes]]:
    """``(units, form, units of the prefix, units of the middle, output)`` of each text."""
    lanes = Lanes(texts, automaton(unit))
    n, sentinels = lanes.count()
    h = draws(ids)
    ends = np.sort(h[:, :2] % (n + 1)[:, None], axis=1)
    plain = (n == 0) | (sentinels > 0) | (h[:, 2] % 100 >= RATE)
    forms = np.where(plain, "plain", np.where(h[:, 3] % 100 < SPM_RATE, "spm", "psm"))
    at = np.flatnonzero(~plain)
    cuts = np.zeros((len(texts), 2), np.int64)
    for side in (0, 1):
        cuts[at, side] = lanes.cut(at, ends[at, side])
    p, s, m = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))
    out = []
    for text, units, form, (a, b), (i, j) in zip(texts, n.tolist(), forms.tolist(), ends.tolist(), cuts.tolist(), strict=True):
        if form == "plain":
            out.append((units, form, None, None, text))
        else:
            parts = (p, text[:i], s, text[j:], m) if form == "psm" else (s, text[j:], p, text[:i], m)
            out.append((units, form, a, b - a, b"".join((*parts, text[i:j]))))
    return out


def transform(docs: DataFrame, unit: str = "char") -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` for each row of ``doc_id, text``; other columns are passed over.

    ``n`` counts the text's units (null text: empty). Prefix and middle end where the id's draws say. ``form`` is plain if the
    text is empty, holds a sentinel or is drawn so; else psm (``<P>`` prefix ``<S>`` suffix ``<M>`` middle) or spm (``<S>``
    suffix ``<P>`` prefix ``<M>`` middle). Sizes of parts are null for plain texts. Rows are judged alone, so repeated rows
    give repeated results and an empty table none. A null id draws as an empty text. A text of any length costs a few times
    its size in memory; batches are bounded.
    """
    bounded_batches(docs.sparkSession)

    def run(batches):
        names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            rows = transformed([x or b"" for x in batch.column("text").to_pylist()], ids, unit)
            columns = [ids, *(list(c) for c in zip(*rows, strict=True))] if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    found = given.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary")
    return found.withColumn("output", F.col("output").cast("string"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output of this form was made from. Its parts hold no sentinel, so each is found by its first place."""

    def between(text: Column, mark: str) -> tuple[Column, Column]:
        before = F.substring_index(text, mark, 1)
        return before, F.substr(text, F.char_length(before) + len(mark) + 1)

    first, rest = between(F.substr(output, F.lit(len(PREFIX) + 1)), SUFFIX)
    suffix, middle = between(rest, MIDDLE)
    psm = F.concat(first, middle, suffix)
    last, behind = between(F.substr(output, F.lit(len(SUFFIX) + 1)), PREFIX)
    prefix, center = between(behind, MIDDLE)
    return F.when(form == "psm", psm).when(form == "spm", F.concat(prefix, center, last)).otherwise(output)
