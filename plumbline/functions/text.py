"""Scalar string functions as Spark columns."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Latin letters whose canonical decomposition is one base letter and one mark, mapped to the base letter in lower case.
FOLDED = {
    chr(c): unicodedata.normalize("NFD", chr(c))[0].lower()
    for c in range(0xC0, 0x250)
    if len(unicodedata.normalize("NFD", chr(c))) == 2 and unicodedata.combining(unicodedata.normalize("NFD", chr(c))[1])
}
_FROM, _TO = "".join(FOLDED), "".join(FOLDED.values())
WORD = r"[\p{L}\p{N}\p{Co}]+"
#: What a search query loses: these characters anywhere, hyphens in front.
DROPPED = '"()*+^:{}~'


def fold(text: Column) -> Column:
    """Lower case without single diacritics."""
    return F.regexp_replace(F.translate(F.lower(text), _FROM, _TO), r"\p{Mn}", "")


def fold_text(text: str) -> str:
    """``fold`` for a Python string."""
    return "".join(c for c in text.lower().translate(str.maketrans(FOLDED)) if unicodedata.category(c) != "Mn")


def tokens(text: Column) -> Column:
    """The folded words of a text, in order."""
    return F.regexp_extract_all(fold(text), F.lit(WORD), F.lit(0))


def words(text: Column) -> Column:
    """What lies between white space."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def sanitize_query(query: Column) -> Column:
    cleaned = F.transform(words(query), lambda w: F.regexp_replace(F.translate(w, DROPPED, ""), "^-+", ""))
    return F.array_join(F.filter(cleaned, lambda w: w != ""), " ")


def query_terms(query: Column) -> Column:
    """Lower-case words of three bytes or more."""
    return F.filter(words(F.lower(query)), lambda t: F.octet_length(t) >= 3)


def heading_boost(heading: Column, terms: Column, most: Column | float) -> Column:
    """``most`` times the share of terms that the heading holds as substrings."""
    most = most if isinstance(most, Column) else F.lit(float(most))
    hits = F.size(F.filter(terms, lambda t: F.contains(F.lower(heading), t)))
    return F.when((F.size(terms) > 0) & (most != 0), most * hits / F.size(terms)).otherwise(F.lit(0.0))


def normalise_path(path: Column) -> Column:
    """Slashes for backslashes, without one leading ``./``."""
    return F.regexp_replace(F.translate(path, "\\", "/"), r"^\./", "")


def title(markdown: Column) -> Column:
    """The first line that starts with ``# ``, indented or not; null without one."""
    found = F.trim(F.regexp_extract(markdown, r"(?md)^[^\S\n]*# [^\S\n]*(\S[^\n]*)$", 1))
    return F.when(found != "", found)


def is_markdown(path: Column) -> Column:
    return path.rlike(r"(?:^|/)[^/]+\.md$")


def under(path: Column, root: Column | str) -> Column:
    """The root itself or below it."""
    root = root if isinstance(root, Column) else F.lit(root)
    return (path == root) | F.startswith(path, F.concat(root, F.lit("/")))


def prompt_passes(prompt: Column) -> Column:
    return F.size(words(prompt)).between(5, 150)


def bytes_to_tokens(n: Column) -> Column:
    return F.round(n / F.lit(4.0)).cast("long")


def human_count(n: Column) -> Column:
    """999, 1.0K, 1.5M: quotients are rounded by their exact binary value, halves to even."""

    def tenths(scale: int, unit: str) -> Column:
        quotient = n / F.lit(float(scale))
        # What lies behind the point is a multiple of 2 ** -52, so products with whole numbers are exact in decimals.
        behind = ((quotient - F.floor(quotient)) * F.lit(float(1 << 52))).cast("long").cast("decimal(18,0)") * F.lit(scale).cast("decimal(8,0)")
        off = behind - (n % scale).cast("decimal(8,0)") * F.lit(1 << 52).cast("decimal(18,0)")
        down, rest, half = F.floor(n / F.lit(scale // 10)), n % (scale // 10), scale // 20
        up = (rest > half) | ((rest == half) & ((off > 0) | ((off == 0) & (down % 2 == 1))))
        shown = down + up.cast("long")
        return F.concat(F.floor(shown / 10).cast("string"), F.lit("."), (shown % 10).cast("string"), F.lit(unit))

    return F.when(n < 1000, n.cast("string")).when(n < 1_000_000, tenths(1000, "K")).otherwise(tenths(1_000_000, "M"))


def iso_time(seconds: Column) -> Column:
    """UTC, to the second; times before 1970 count as its start."""
    return F.date_format(F.timestamp_seconds(F.greatest(seconds, F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def score_bar(score: Column, width: int = 40) -> Column:
    n = F.least(F.round(score * width), F.lit(width)).cast("int")
    return F.concat(F.repeat(F.lit("█"), n), F.repeat(F.lit("░"), F.lit(width) - n))


def first_lines(text: Column, n: int) -> Column:
    return F.array_join(F.slice(F.split(text, "\n"), 1, n), "\n")
