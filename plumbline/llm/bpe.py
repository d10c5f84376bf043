"""Byte-level BPE by prefix dynamic programming.

For each prefix of a byte string the encoding of that prefix ends in exactly one token. The table of
these last tokens is all that is needed: the encoding of the whole is read off it backwards, an append
only extends it, and an edit recomputes it from the edit on until it agrees with the old one again.
The last token of a prefix is the one token that ends there and stands validly behind the last token
of the prefix before it; a pair is valid if merging its two sides would keep the boundary.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from plumbline.llm.common import bounded_batches
from plumbline.llm.pieces import Memo, split

_NEVER = 1 << 62


class Vocabulary:
    """The ranks of a vocabulary file, with the merge that makes each token."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.texts = [b""] * (max(ranks.values()) + 1)
        for text, rank in ranks.items():
            self.texts[rank] = text
        self.longest = max(map(len, ranks))
        #: The two tokens whose merge makes a token; a token that no merge makes stands for itself.
        self.halves = [(t, t) for t in range(len(self.texts))]
        self.merged: dict[tuple[int, int], int] = {}
        self.valid: dict[int, bool] = {}
        self.reachable = bytearray(len(self.texts))
        for text, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(text) == 1:
                self.reachable[rank] = 1
                continue
            parts = self._by_merging(text, rank)
            if len(parts) == 2:
                self.halves[rank] = (parts[0], parts[1])
                self.merged[parts[0], parts[1]] = rank
                self.reachable[rank] = 1

    @staticmethod
    @lru_cache(4)
    def load(path: str) -> Vocabulary:
        with open(path, "rb") as f:
            return Vocabulary({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})

    def _by_merging(self, text: bytes, below: int) -> list[int]:
        """Merges the lowest rank first, only with ranks under ``below``: slow, for building the table."""
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 2:
            pairs = [(self.ranks.get(a + b, _NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))]
            rank, i = min(pairs)
            if rank >= below:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def stands(self, left: int, right: int) -> bool:
        """Whether the texts of two tokens, joined, are encoded as just these two."""
        key = left << 32 | right
        known = self.valid.get(key)
        if known is None:
            if len(self.valid) > 400_000:
                self.valid.clear()
            known = self.valid[key] = self._stands(left, right)
        return known

    def _stands(self, left: int, right: int) -> bool:
        # Undoes merges on both sides of the boundary, the latest first. Before an undone merge took place,
        # the tokens then at the boundary must not have had a merge that comes earlier.
        before = _NEVER
        a, b = left, right
        while True:
            if self.merged.get((a, b), _NEVER) < before:
                return False
            whole_a, whole_b = self.halves[a][1] == a, self.halves[b][0] == b
            if whole_a and whole_b:
                return True
            # At equal ranks the merge further left came first, so the right side's is undone first.
            if whole_b or (not whole_a and a > b):
                before, a = a, self.halves[a][1]
            else:
                before, b = b + 1, self.halves[b][0]


class PrefixTable:
    """The last token of each prefix of one byte string."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data = vocabulary, b""
        self.last: list[int] = []
        self.append(data)

    def _extend(self, end: int) -> int:
        """The last token of the prefix of ``end`` bytes, from those of the shorter prefixes."""
        v, data, last = self.vocabulary, self.data, self.last
        for n in range(min(end, v.longest), 0, -1):
            token = v.ranks.get(data[end - n : end])
            if token is not None and v.reachable[token] and (n == end or v.stands(last[end - n - 1], token)):
                return token
        raise ValueError("the vocabulary lacks a byte")

    def append(self, more: bytes) -> None:
        """Adds bytes; nothing that stands already is computed again."""
        start = len(self.data)
        self.data += more
        for end in range(start + 1, len(self.data) + 1):
            self.last.append(self._extend(end))

    def replace(self, start: int, end: int, new: bytes) -> int:
        """Puts ``new`` in place of the bytes from ``start`` to ``end``; returns how many entries were computed."""
        old_last, shift = self.last, start + len(new) - end
        self.data = self.data[:start] + new + self.data[end:]
        self.last = old_last[:start]
        same, done = 0, 0
        for at in range(start + 1, len(self.data) + 1):
            self.last.append(self._extend(at))
            done += 1
            # An entry depends on those of the last `longest` prefixes and bytes: once so many agree, all later ones do.
            same = same + 1 if at > start + len(new) and self.last[-1] == old_last[at - shift - 1] else 0
            if same >= self.vocabulary.longest:
                self.last += old_last[at - shift :]
                break
        return done

    def tokens(self) -> list[int]:
        out, at = [], len(self.data)
        while at:
            out.append(self.last[at - 1])
            at -= len(self.vocabulary.texts[out[-1]])
        return out[::-1]


def encode_piece(vocabulary: Vocabulary, piece: bytes) -> list[int]:
    """The ids of one piece: the token that it is, else by its prefix table."""
    whole = vocabulary.ranks.get(piece)
    return [whole] if whole is not None else PrefixTable(vocabulary, piece).tokens()


def encode(vocabulary: Vocabulary, text: str) -> list[int]:
    return [t for piece in split(text) for t in encode_piece(vocabulary, piece.encode())]


def decode(vocabulary: Vocabulary, ids) -> bytes:
    return b"".join(map(vocabulary.texts.__getitem__, ids))


class EditableText:
    """The encoding of a text that grows and changes; only pieces near a change are encoded again."""

    def __init__(self, vocabulary: Vocabulary, text: str = ""):
        self.vocabulary, self.text = vocabulary, text
        self.pieces = split(text)
        self.ids = [encode_piece(vocabulary, p.encode()) for p in self.pieces]

    def append(self, more: str) -> int:
        return self.replace(len(self.text), len(self.text), more)

    def replace(self, start: int, end: int, new: str) -> int:
        """Replaces characters; returns the number of pieces encoded again."""
        # A match looks one character past its end at most: earlier pieces stay.
        keep = at = 0
        while keep < len(self.pieces) and at + len(self.pieces[keep]) + 1 < start:
            at += len(self.pieces[keep])
            keep += 1
        self.text = self.text[:start] + new + self.text[end:]
        shift, fresh, old = len(new) - (end - start), [], {}
        place = at
        for i in range(keep, len(self.pieces)):
            if place >= end:
                old[place + shift] = i
            place += len(self.pieces[i])
        resumed, here = len(self.pieces), at
        for piece in split(self.text[at:]):
            if here in old:  # from a shared boundary on, the split depends on the text behind it alone
                resumed = old[here]
                break
            fresh.append(piece)
            here += len(piece)
        self.pieces[keep:resumed] = fresh
        self.ids[keep:resumed] = [encode_piece(self.vocabulary, p.encode()) for p in fresh]
        return len(fresh)

    def tokens(self) -> list[int]:
        return [t for ids in self.ids for t in ids]


#: Pieces whose ids a worker remembers.
PIECES = 400_000


class PieceEncoder:
    """Packed ids of strings by their pieces; each distinct piece goes through a prefix table once."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.known: dict[str, bytes] = {}

    def __call__(self, texts: list[str]) -> list[bytes]:
        known, out = self.known, []
        if len(known) > PIECES:
            known.clear()
        for text in texts:
            parts = []
            for piece in split(text):
                ids = known.get(piece)
                if ids is None:
                    ids = np.array(encode_piece(self.vocabulary, piece.encode()), "<u4").tobytes()
                    if len(piece) <= 48:
                        known[piece] = ids
                parts.append(ids)
            out.append(b"".join(parts))
        return out


@lru_cache(4)
def _memo(path: str) -> Memo:
    return Memo(PieceEncoder(Vocabulary.load(path)))


def encode_texts(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and ``ids``, the token ids of each whole ``text`` as packed little-endian unsigned 32-bit integers.

    Null and empty texts have no ids; repeated rows are encoded alike; other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    kinds = dict(docs.dtypes)

    def run(batches):
        memo = _memo(path)
        for batch in batches:
            ids = memo.of_all([x or "" for x in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(ids, pa.binary())], names=[*keep, "ids"])

    return docs.select(*keep, "text").mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "ids binary"]))


def digests(encoded: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``n_tokens, ids_sha256, decoded_sha256`` of the packed ``ids`` of ``encode_texts``, decoded again."""
    kinds = dict(encoded.dtypes)

    def run(batches):
        vocabulary = Vocabulary.load(path)
        decimal = [str(t).encode() for t in range(len(vocabulary.texts))]
        for batch in batches:
            found = []
            for packed in batch.column("ids").to_pylist():  # one text at a time: lists of ids are large
                ids = np.frombuffer(packed, "<u4").tolist()
                texts = hashlib.sha256(b",".join(map(decimal.__getitem__, ids))), hashlib.sha256(decode(vocabulary, ids))
                found.append((len(ids), *(t.hexdigest() for t in texts)))
            columns = list(zip(*found, strict=True)) or [[]] * 3
            values = [pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *values], names=[*keep, "n_tokens", "ids_sha256", "decoded_sha256"])

    return encoded.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "n_tokens long, ids_sha256 string, decoded_sha256 string"]))
