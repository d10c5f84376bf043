"""Full-text query syntax: barewords, AND, OR, NOT. Words that fall into several terms are phrases."""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass

import regex

from plumbline.functions.text import DROPPED, WORD, fold_text

_BAREWORD = re.compile(r"[A-Za-z0-9_\x80-\U0010ffff]+")
_WORD = regex.compile(WORD)


@dataclass(frozen=True)
class Query:
    """``phrases``: lists of terms, one for each bareword. ``clauses``: a text matches if it has all needed phrases of one and none of its banned ones."""

    phrases: list[list[str]]
    clauses: list[tuple[list[int], list[int]]]


def sanitize(query: str) -> str:
    cleaned = ("".join(c for c in w if c not in DROPPED).lstrip("-") for w in query.split())
    return " ".join(w for w in cleaned if w)


def _splits(items: list, word: str) -> list[list]:
    out: list[list] = [[]]
    for item in items:
        if item == word:
            out.append([])
        else:
            out[-1].append(item)
    return out


def parse(query: str) -> Query | None:
    """The parsed query; None where the syntax is broken, so that nothing matches by words."""
    items = query.split()
    phrases: list[list[str]] = []

    def leaf(word: str) -> list[tuple[frozenset, frozenset]] | None:
        terms = _WORD.findall(fold_text(word))
        if not terms:
            return None  # says nothing beside other words
        phrases.append(terms)
        return [(frozenset([len(phrases) - 1]), frozenset())]

    def both(a, b):
        return [(x[0] | y[0], x[1] | y[1]) for x in a for y in b]

    def negated(a):
        return [(frozenset(i for i, yes in pick if not yes), frozenset(i for i, yes in pick if yes)) for pick in itertools.product(*([*((i, True) for i in need), *((i, False) for i in ban)] for need, ban in a))]

    if not items or any(not _BAREWORD.fullmatch(w) for w in items):
        return None
    found = []
    for either in _splits(items, "OR"):
        every = None
        for part in _splits(either, "AND"):
            kept = None
            for n, side in enumerate(_splits(part, "NOT")):
                if not side:
                    return None
                leaves = [x for x in map(leaf, side) if x is not None]
                joined = []
                if leaves:
                    joined = leaves[0]
                    for x in leaves[1:]:
                        joined = both(joined, x)
                if n == 0:
                    kept = joined
                elif joined:
                    kept = both(kept, negated(joined))
            every = kept if every is None else both(every, kept)
        found += every or []
    clauses = [(sorted(need), sorted(ban)) for need, ban in found if need and not need & ban]
    return Query(phrases, clauses)
