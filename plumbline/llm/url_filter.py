"""URL rules in a sorted array of digests.

The index of a rule list is one file: sorted 64-bit xxhash keys, then for each key the rule's
verdict and its full string. Python workers memory-map it, probe all candidates of a batch with one
vectorised binary search, and confirm the stored string, so that two rules with one digest or a
stranger with a rule's digest cannot give a wrong verdict.
"""

from __future__ import annotations

import mmap
import os
import tempfile
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import bounded_batches, keyed, quoted, stored, unused

#: Largest index that is sent to every executor; longer lists are joined as a table.
INDEX_BYTES = 256 << 20
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
_MAGIC = b"urlrules"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


def parse(url: str | None) -> tuple[str, str]:
    """(host, path) of a url; both empty without ``://``."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.partition("://")[2]
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host, path = rest[:end], rest[end:]
    return host.translate(_LOWER), path[: min((i for i in map(path.find, "?#") if i >= 0), default=len(path))]


def seal(rules: list[Rule]) -> bytes:
    """The index file of a rule list. Of rules for the same host and path, blocking wins."""
    one: dict[tuple[str, str], Rule] = {}
    for r in rules:
        if r.verdict not in ("allow", "block"):
            raise ValueError(f"unknown verdict {r.verdict}")
        if (r.host, r.path) not in one or r.verdict == "block":
            one[r.host, r.path] = r
    entries = sorted((xxhash.xxh64_intdigest(_key(r.host, r.path)), _key(r.host, r.path), r) for r in one.values())
    strings = [k for _, k, _ in entries]
    ends = np.cumsum([0, *map(len, strings)], dtype="<u8")
    shapes = np.array(sorted({(len(r.host), len(r.path)) for r in one.values()}), "<u4").reshape(-1, 2)
    head = np.array([len(entries), len(shapes)], "<u8")
    keys = np.array([k for k, _, _ in entries], "<u8")
    blocks = np.array([r.verdict == "block" for _, _, r in entries], np.uint8)
    return _MAGIC + head.tobytes() + keys.tobytes() + ends.tobytes() + shapes.tobytes() + blocks.tobytes() + b"".join(strings)


def _key(host: str, path: str) -> bytes:
    return f"{host}\0{path}".encode("utf-8", "surrogatepass")


class Index:
    """A sealed index, memory-mapped."""

    def __init__(self, sealed: bytes):
        # A nameless file: the pages belong to the system's cache and go with the worker.
        fd, name = tempfile.mkstemp()
        os.unlink(name)
        with os.fdopen(fd, "r+b") as f:
            f.write(sealed)
            f.flush()
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        if self.map[:8] != _MAGIC:
            raise ValueError("not an index of url rules")
        n, m = np.frombuffer(self.map, "<u8", 2, 8).tolist()
        at = 24
        self.keys = np.frombuffer(self.map, "<u8", n, at)
        self.ends = np.frombuffer(self.map, "<u8", n + 1, at + 8 * n)
        at += 16 * n + 8
        self.shapes = [tuple(x) for x in np.frombuffer(self.map, "<u4", 2 * m, at).reshape(-1, 2).tolist()]
        at += 8 * m
        self.blocks = np.frombuffer(self.map, np.uint8, n, at)
        self.strings = at + n

    def stored(self, i: int) -> bytes:
        return self.map[self.strings + int(self.ends[i]) : self.strings + int(self.ends[i + 1])]

    def probe(self, candidates: list[bytes]) -> np.ndarray:
        """The entry of each candidate string, -1 for none."""
        out = np.full(len(candidates), -1, "i8")
        if not len(self.keys) or not candidates:
            return out
        digests = np.array([xxhash.xxh64_intdigest(c) for c in candidates], "<u8")
        low, high = np.searchsorted(self.keys, digests), np.searchsorted(self.keys, digests, "right")
        for i in np.flatnonzero(low < high):
            out[i] = next((j for j in range(low[i], high[i]) if self.stored(j) == candidates[i]), -1)
        return out

    def judge(self, urls: list[str | None]) -> list[tuple[str, str, str | None, str]]:
        """(host, path, rule or None, verdict) of each url; the longest rule that fits wins, without one a url is allowed."""
        parsed = [parse(u) for u in urls]
        owner: list[int] = []
        candidates: list[bytes] = []
        for i, (host, path) in enumerate(parsed):
            for h, p in self.shapes:
                if len(host) >= h and len(path) >= p and h and (len(host) == h or host[-h - 1] == "."):
                    owner.append(i)
                    candidates.append(_key(host[-h:], path[:p]))
        best: dict[int, tuple[int, int, int]] = {}
        for i, c, entry in zip(owner, candidates, self.probe(candidates).tolist(), strict=True):
            if entry >= 0:
                host, _, path = c.decode("utf-8", "surrogatepass").partition("\0")
                best[i] = max(best.get(i, (-1, -1, -1)), (len(host) + len(path), len(host), entry))
        out = []
        for i, (host, path) in enumerate(parsed):
            entry = best[i][2] if i in best else -1
            rule = self.stored(entry).decode("utf-8", "surrogatepass").replace("\0", "", 1) if entry >= 0 else None
            out.append((host, path, rule, "block" if entry >= 0 and self.blocks[entry] else "allow"))
        return out


def _by_join(pages: DataFrame, rules: list[Rule], keep: tuple[str, ...]) -> DataFrame:
    """``judge_urls`` for rules that are too many for every executor: urls and rules are dealt by digest and confirmed by their strings.

    A url meets the rules' hosts by its own and those above it, then their rules by the beginnings of its path that are as long as
    some rule's of that host.
    """
    spark = pages.sparkSession
    table = spark.createDataFrame([(r.host, r.path, r.verdict) for r in rules], "host string, path string, verdict string")
    table = stored(table.groupBy("host", "path").agg(F.max("verdict").alias("verdict")), "rules")  # of both, block
    key = unused(pages.columns, "row")
    rows = keyed(pages, key)
    rest = F.when(F.contains("url", F.lit("://")), F.substr("url", F.locate("://", F.col("url")) + 3)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(F.coalesce(rest, F.lit("")), "^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(F.coalesce(rest, F.lit("")), "^[^/?#]*([^?#]*)", 1)
    parts = stored(rows.select(F.col(key).alias("_row"), *(F.col(c).alias(f"k{i}") for i, c in enumerate(quoted(list(keep)))), host.alias("host"), path.alias("path")), "urls")
    labels = F.split("host", "[.]", -1)
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.array_join(F.slice(labels, n, F.size(labels)), "."))
    digest = lambda h, p: F.xxhash64(h, p).alias("digest")
    lengths = table.groupBy(F.col("host").alias("its_host")).agg(F.collect_set(F.char_length("path")).alias("lengths"))
    met = parts.select("_row", "path", F.explode(above).alias("its_host")).where("its_host <> ''").join(lengths, "its_host")
    fits = met.select("_row", "path", "its_host", F.explode(F.filter("lengths", lambda n: n <= F.char_length("path"))).alias("n"))
    asked = fits.select("_row", "its_host", F.substr("path", F.lit(1), F.col("n")).alias("its_path")).withColumn("digest", digest("its_host", "its_path"))
    known = table.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), F.col("verdict"), digest("host", "path"))
    found = asked.join(known, "digest").where("its_host = rule_host AND its_path = rule_path")
    rule = F.concat("rule_host", "rule_path")
    best = found.groupBy("_row").agg(F.max(F.struct(F.char_length(rule).alias("n"), F.char_length("rule_host").alias("h"), rule.alias("rule"), "verdict")).alias("best"))
    out = parts.join(best, "_row", "left").select(*(f"k{i}" for i in range(len(keep))), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit("allow")).alias("verdict"))
    return out.toDF(*keep, "host", "path", "rule", "verdict")


def judge_urls(pages: DataFrame, rules: list[Rule], keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """The columns ``keep`` and ``host, path, rule, verdict`` of every row, by its ``url``.

    A rule fits its host and all subdomains if the url's path starts with the rule's; the longest rule
    wins (by host and path together, then by host). A null url or one without ``://`` has an empty host
    and path, fits no rule and is allowed. Repeated rows are judged alike; other columns are ignored, whatever their names; an empty
    table gives no rows. Urls may have any length. Rules whose index is larger than ``INDEX_BYTES`` are joined instead.
    """
    spark = pages.sparkSession
    bounded_batches(spark)
    sealed = seal(rules)
    if len(sealed) > INDEX_BYTES:
        return _by_join(pages, rules, keep)
    shared = spark.sparkContext.broadcast(sealed)
    # Columns go through Python by number, whatever their names hold.
    chosen = pages.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(quoted(list(keep)))), F.col("url").cast("string").alias("u"))
    fields = [T.StructField(n, T.StringType()) for n in ("host", "path", "rule", "verdict")]

    def judge(batches):
        index = Index(shared.value)
        for batch in batches:
            found = list(zip(*index.judge(batch.column("u").to_pylist()), strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(list(x), pa.string()) for x in found)], names=[*batch.schema.names[:-1], "host", "path", "rule", "verdict"])

    return chosen.mapInArrow(judge, T.StructType([*chosen.schema.fields[:-1], *fields])).toDF(*keep, "host", "path", "rule", "verdict")
