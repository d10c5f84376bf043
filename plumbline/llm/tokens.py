"""Token ids of whole texts by a ``tokenizers`` file, as packed little-endian unsigned 32-bit integers."""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np

from plumbline.llm.pieces import Memo

#: Texts that look like special tokens are ordinary text, and one thread per Spark core is enough.
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


def _plain_byte_level(spec: dict) -> bool:
    """Whether texts fall into pieces of the usual byte-level pattern, with nothing before or after."""
    pre = spec.get("pre_tokenizer") or {}
    return (
        not spec.get("normalizer")
        and pre.get("type") == "ByteLevel"
        and not pre.get("add_prefix_space")
        and pre.get("use_regex", True)
        and all(t.get("special") for t in spec.get("added_tokens", []))
    )


#: Entries of the memo beside the library's own vocabulary.
TOKENIZER_ENTRIES = 400_000
#: How byte-level vocabularies write a blank.
BLANK = "\u0120"
#: Chunks that are encoded as one text.
JOINED_CHUNKS = 4096


class TextTokenizer:
    """Encodes texts with the tokenizers library; chunks seen before come from a memo."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.memo = None
        if _plain_byte_level(spec):
            # The same model for pieces that stand between blanks, whose bytes are written as the vocabulary does.
            self.pieces = Tokenizer(self.library.model)
            self.pieces.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
            self.memo = Memo(self._whole, self._chunks, TOKENIZER_ENTRIES)
            # The vocabulary writes each byte as one character.
            self.lengths = np.zeros(max(spec["model"]["vocab"].values()) + 1, "i8")
            for token, i in spec["model"]["vocab"].items():
                self.lengths[i] = len(token)

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _chunks(self, chunks: list[str]) -> list[bytes]:
        """Encodes chunks that don't touch as one text; the bytes that tokens stand for tell them apart."""
        out: list[bytes] = [b""] * len(chunks)
        words, others = [], []
        for i, chunk in enumerate(chunks):  # a blank and ASCII letters are one piece
            (words if chunk[0] == " " and chunk.isascii() and chunk[1:].isalpha() else others).append(i)
        for library, blank, places in ((self.pieces, f" {BLANK}", words), (self.library, "", others)):
            for at in range(0, len(places), JOINED_CHUNKS):
                group = [chunks[i] for i in places[at : at + JOINED_CHUNKS]]
                joined = "".join(group)
                sizes = list(map(len, group if joined.isascii() else map(str.encode, group)))
                ids = np.array(library.encode_batch_fast([joined.replace(" ", blank) if blank else joined], add_special_tokens=False)[0].ids, "<u4")
                ends = np.searchsorted(np.cumsum(self.lengths[ids]), np.cumsum(sizes), "left") * 4 + 4
                packed = ids.tobytes()
                cuts = [0, *ends.tolist()]
                for i, a, b in zip(places[at : at + JOINED_CHUNKS], cuts, cuts[1:], strict=False):
                    out[i] = packed[a:b]
        return out

    def packed(self, texts: list[str]) -> list[bytes]:
        return self.memo.of_all(texts) if self.memo else self._whole(texts)


@lru_cache(4)
def tokenizer(path: str) -> TextTokenizer:
    """One tokenizer per file and Python worker."""
    return TextTokenizer(path)


#: The id that closes a document.
END = (0).to_bytes(4, "little")


def document_ids(path: str, texts: list[str | None]) -> list[bytes]:
    """The packed ids of each document with its end id; a null text is empty."""
    return [ids + END for ids in tokenizer(path).packed([x or "" for x in texts])]
