"""Splitting of text into the pieces that byte-level BPE merges separately, and a per-process memo.

Natural text repeats its words, so a tokenizer needs to see each piece only once per Python
worker. The memo maps a blank-delimited chunk to its packed ids; chunks are independent of their
neighbours as long as no two white-space characters touch, and texts in which they do take the plain
path. A batch's texts are cut and its distinct chunks found in columns, so Python sees each of those once.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Entries of one memo, in two generations: when the younger is full, it takes the older one's place.
MEMO_ENTRIES = 600_000
#: Characters that are cut into chunks at a time: bounds the columns of chunks. A longer text is cut alone.
RUN_CHARS = 1 << 21
#: Chunks longer than this are not kept.
MEMO_CHARS = 48

# The split pattern for texts of ASCII and Latin letters only, where the classes of `re` agree with
# \p{L}, \p{N} and White_Space, and the same pattern in Unicode properties for all others.
_LATIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_UNICODE = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
_OTHER = re.compile("[^\x01-\x1b\x20-\x7e\xa0-\xb1\xb4-\xb8\xba\xbb\xbf-\u024f]")
# Of white space, chunks may hold single blanks and line breaks only.
_UNCHUNKED = re.compile("[^\x01-\x08\n\x0e-\x1b\x20-\x7e\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-\u024f]")


def split(text: str) -> list[str]:
    """The pieces of a text, in order; joined they are the text."""
    return (_UNICODE if _OTHER.search(text) else _LATIN).findall(text)


#: Bits that note which chunks have been seen once: only chunks seen again are kept.
SEEN_BITS = 1 << 24


class Memo:
    """Packed ids of texts; each chunk that repeats is encoded about twice in a Python worker.

    ``encode`` gets whole texts and returns the packed ids of each. ``encode_chunks`` gets strings that
    begin with a blank or line break and end in no white space, so that none of them would change
    another's ids if they stood one after another.
    """

    def __init__(self, encode: Callable[[list[str]], list[bytes]], encode_chunks: Callable[[list[str]], list[bytes]] | None = None, entries: int = MEMO_ENTRIES):
        self.encode, self.encode_chunks = encode, encode_chunks or encode
        self.marks = dict(zip(",.;:!?", encode(list(",.;:!?")), strict=True))
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.entries = entries
        self.seen = bytearray(SEEN_BITS >> 3)

    def of_all(self, texts: list[str]) -> list[bytes]:
        """The packed ids of each text."""
        runs, held = [0], 0
        for i, text in enumerate(texts):
            held += len(text)
            if held > RUN_CHARS and i > runs[-1]:
                runs.append(i)
                held = len(text)
        return [ids for a, b in zip(runs, [*runs[1:], len(texts)], strict=True) for ids in self._of_run(texts[a:b])]

    def _of_run(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > self.entries // 2:
            self.known, self.older = {}, self.known
        out, chunked, plain = [b""] * len(texts), [], []
        for i, text in enumerate(texts):
            if text:
                whole = text[0] == " " or text[-1] in " \n" or "  " in text or " \n" in text or "\n " in text or "\n\n" in text or _UNCHUNKED.search(text)
                (plain if whole else chunked).append(i)
        # A chunk after a line break starts with \0 in place of it, any other after the first stood behind a blank.
        lists = pc.split_pattern(pc.replace_substring(pa.array([texts[i] for i in chunked], pa.string()), "\n", " \0"), " ")
        starts_at, chunks = lists.offsets.to_numpy(), lists.values
        behind = np.ones(len(chunks), bool)
        behind[starts_at[:-1]] = False
        firsts = chunks.take(pa.array(starts_at[:-1])).to_pylist()
        coded = pc.dictionary_encode(chunks.filter(pa.array(behind)))
        distinct, which = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        values = self._of_chunks(distinct)
        starts = self.encode(firsts + [texts[i] for i in plain])
        pool, sizes = np.frombuffer(b"".join(values), "<u4"), np.fromiter(map(len, values), np.int32, len(values)) // 4
        at = np.cumsum(sizes, dtype=np.int32) - sizes
        sizes = sizes[which]
        ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int32)])
        ids = pool[np.repeat(at[which] - ends[:-1].astype(np.int32), sizes) + np.arange(ends[-1], dtype=np.int32)]
        cuts = ends[starts_at - np.arange(len(starts_at))].tolist()
        for i, start, a, b in zip(chunked, starts, cuts, cuts[1:], strict=False):
            out[i] = start + ids[a:b].tobytes()
        for i, value in zip(plain, starts[len(chunked) :], strict=True):
            out[i] = value
        return out

    def _of_chunks(self, chunks: list[str]) -> list[bytes]:
        """The packed ids of distinct chunks; a line break at their beginning is written as \\0, a blank is left out."""
        known, older, marks, seen = self.known, self.older, self.marks, self.seen
        values = list(map(known.get, chunks))
        fresh, new = [], []
        for i in [i for i, value in enumerate(values) if value is None]:
            chunk = chunks[i]
            value = older.get(chunk)
            if value:
                known[chunk] = values[i] = value
                continue
            new.append(i)
            mark = marks.get(chunk[-1:])
            # A mark behind a letter is a piece of its own.
            core = (known.get(chunk[:-1]) or older.get(chunk[:-1])) if mark and chunk[-2:-1].isalpha() else None
            if core:
                values[i] = core + mark
            else:
                fresh.append(i)
        whole = ["\n" + c[1:] if c[:1] == "\0" else " " + c for c in map(chunks.__getitem__, fresh)]
        for i, value in zip(fresh, self.encode_chunks(whole), strict=True):
            values[i] = value
        for i in new:
            chunk = chunks[i]
            h = hash(chunk) & (SEEN_BITS - 1)
            bit = 1 << (h & 7)
            if not seen[h >> 3] & bit:
                seen[h >> 3] |= bit
            elif len(chunk) <= MEMO_CHARS:
                known[chunk] = values[i]
        return values
