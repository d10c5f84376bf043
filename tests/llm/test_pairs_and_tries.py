"""Fill-in-the-middle, the Jaccard join and the prefix trie against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.llm import fim, jaccard, minhash, queries, tokens, trie
from tests.llm.test_llm import DOCS, LONG, ODD, brute_components

# --- fill in the middle

SOUP = st.text(alphabet=st.one_of(st.sampled_from("<PSM>aé日🙂\n"), st.characters(exclude_categories=["Cs"])), max_size=60)


@settings(max_examples=150, deadline=None)
@given(st.lists(SOUP, max_size=8), st.sampled_from([4, 7, 1024]), st.sampled_from(["char", "line"]), st.integers(0, 80))
def test_automaton_counts_and_cuts(sample, lane, unit, at):
    """Units, sentinels and the bytes of cuts are those of Python's own strings, however short the lanes."""
    before, fim.LANE = fim.LANE, lane
    try:
        lanes = fim.Lanes([t.encode() for t in sample], fim.automaton(unit))
        units, sentinels = lanes.count()
        parts = [list(t) if unit == "char" else re.findall(r"[^\n]*\n|[^\n]+", t) for t in sample]
        assert units.tolist() == [len(p) for p in parts]
        assert sentinels.tolist() == [len(re.findall("<[PSM]>", t)) for t in sample]
        want = [len("".join(p[: min(at, len(p))]).encode()) for p in parts]
        assert lanes.cut(np.arange(len(sample)), np.minimum(at, units)).tolist() == want
    finally:
        fim.LANE = before


def test_broken_bytes_are_counted():
    units, _ = fim.Lanes([b"\xff\x80a\xe6\x97b", b"\x80\x80", b""], fim.automaton()).count()
    assert units.tolist() == [4, 0, 0]
    with pytest.raises(ValueError, match="units"):
        fim.automaton("word")


def brute_middle(i, text):
    text = text or ""
    h = [int(hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(text) + 1), h[1] % (len(text) + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(text), "plain", None, None, text, text
    if h[3] % 100 < 20:
        return len(text), "spm", a, b - a, "<S>" + text[b:] + "<P>" + text[:a] + "<M>" + text[a:b], text
    return len(text), "psm", a, b - a, "<P>" + text[:a] + "<S>" + text[b:] + "<M>" + text[a:b], text


def test_fill_in_middle(spark):
    source = random.Random(1)
    rows = [(i, "".join(source.choice("ab<PSM>é日🙂\n ") for _ in range(source.randrange(90)))) for i in range(300)]
    rows += [(300, "x<" * 30), (301, "<S" * 5), (302, None), (303, ""), (304, "日" * 70_000), (304, "日" * 70_000), (None, "no id"), (305, "a <M> b")]
    docs = spark.createDataFrame([(i, t, "o", 1, "f") for i, t in rows], "doc_id long, text string, output string, n long, form string").repartition(3)
    made = fim.transform(docs).withColumn("again", fim.restored(F.col("output"), F.col("form")))
    got = [tuple(r) for r in made.collect()]
    assert sorted(got, key=str) == sorted(((i, *brute_middle(i, t)) for i, t in rows), key=str)
    assert {g[2] for g in got} == {"plain", "psm", "spm"}
    assert fim.transform(docs.limit(0)).count() == 0


# --- Jaccard join


def families():
    """Groups around and below the threshold, copies, a long text, common passages and short texts."""
    source, rows = random.Random(11), []
    passage = [f"p{k}" for k in range(60)]
    for i in range(260):
        words = [f"f{i % 4}.{k}" for k in range((30, 80, 200, 12)[i % 4])]
        for _ in range(source.randint(0, 6)):
            words[source.randrange(len(words))] = f"w{source.randrange(9)}"
        rows.append((i, " ".join(words)))
    for i in range(260, 330):
        rows.append((i, " ".join([*passage, *(f"{i}.{k}" for k in range(source.randrange(40)))])))
    rows += [(400 + i, " ".join(source.choice("ab") for _ in range(source.randrange(1, 9)))) for i in range(60)]
    rows += [(500, LONG), (501, LONG + " x"), (502, "A b C d E f"), (503, "a B c D e F"), (504, None), (505, ""), (506, " \n")]
    source.shuffle(rows)
    return rows


@pytest.mark.parametrize("heavy", [None, 1, 20, 10**9])
def test_jaccard_join(spark, tmp_path, monkeypatch, heavy):
    """The components are those of all pairs, wherever the boundary between light and heavy sets lies."""
    if heavy:
        monkeypatch.setattr(jaccard, "boundary", lambda *_: heavy)
    monkeypatch.setattr(jaccard, "ROWS", 50)
    rows = families() if heavy != 10**9 else [(i, t) for i, t in families() if len(t or "") < 1000]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "d"))
    got = jaccard.similar_documents(spark.read.parquet(str(tmp_path / "d")), 5, 80).collect()
    want = brute_components(rows, 5, 80)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert len(set(c for _, c in want.values())) > 30


def test_jaccard_join_of_odd_rows(spark, tmp_path):
    spark.createDataFrame(ODD, DOCS).coalesce(2).write.parquet(str(tmp_path / "odd"))
    got = jaccard.similar_documents(spark.read.parquet(str(tmp_path / "odd"))).collect()
    assert len(got) == len(ODD)
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[2]["component_id"] == 1 and by_id[None]["component_id"] == 1 and by_id[7]["component_id"] == 6
    assert by_id[3]["n_shingles"] == 0 and by_id[4]["component_id"] == 4
    assert sum(r["kept"] for r in got if r["doc_id"] == 9) == 1
    assert jaccard.similar_documents(spark.createDataFrame([], DOCS)).count() == 0
    with pytest.raises(ValueError, match="half"):
        jaccard.similar_documents(spark.createDataFrame([], DOCS), percent=50)


def test_boundary_is_the_cheapest(spark):
    """Short lists favour heavy sets, long ones light sets; the boundary is a bin's first size."""
    sizes = [12] * 50 + [40] * 50
    rows = [(i, n, list(range(i * 1000, i * 1000 + n - jaccard.shared_at_least(n, 80) + 2))) for i, n in enumerate(sizes)]
    firsts = spark.createDataFrame(rows, "node long, n long, firsts array<long>")
    few, many = (np.full(1 << jaccard.BUCKET_BITS, n, np.int32) for n in (1, 10_000))
    assert jaccard.boundary(firsts, 80, few) <= 12
    assert jaccard.boundary(firsts, 80, many) > 40


def test_marks_lose_no_link(spark):
    """Bits of sets of any two sizes differ in no more places than the sets do."""
    source = np.random.default_rng(3)
    sets = [np.unique(source.integers(0, 2**63, n, dtype=np.uint64)) for n in (1, 20, 90, 400)]
    sets += [np.union1d(s[: len(s) * 9 // 10], source.integers(0, 2**63, 2, dtype=np.uint64)) for s in sets]
    for x in sets:
        for y in sets:
            a, b = (np.frombuffer(minhash.marks(s), np.uint8)[None, :] for s in (x, y))
            least = min(a.shape[1], b.shape[1])
            a, b = (v if v.shape[1] == least else minhash.folded(v, least) for v in (a, b))
            assert np.bitwise_count(a ^ b).sum() <= len(np.setxor1d(x, y))


def test_long_texts_below_the_threshold_are_told_apart_by_marks(spark, tmp_path):
    """Of long edited copies at 0.83 no pair gets as far as the comparison of full sets at 0.85."""
    source, base, rows = random.Random(4), [f"w{k}" for k in range(3000)], []
    for i in range(40):
        words = list(base)
        for k in source.sample(range(3000), 47):
            words[k] = f"{i}.{k}"
        rows.append((i, " ".join(words)))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    nodes = minhash.features(docs.withColumn("_row", F.struct(F.lit(0).cast("long").alias("file"), F.col("doc_id").alias("at"))), 3).withColumn("node", F.col("doc_id"))
    pairs = spark.range(40).toDF("a").crossJoin(spark.range(40).toDF("b")).where("a < b")
    left = minhash.plausible(pairs, nodes.select("node", "n", "marks"), 85).count()
    assert left < 0.1 * 780
    assert {r["component_id"] for r in minhash.near_duplicates(docs, 3, 85).collect()} == set(range(40))


# --- prefix trie


def brute_trie(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [t[2:] for t in sorted(ts)] for c, ts in convs.items()}
    made = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = convs.get(int(c - np.fmod(c, 20)), [])
        made[c] = tuple(base[:h] + own[h:])
    members = {}
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    out = []
    for path, convs_of in members.items():
        below = [p for p in members if p[: len(path)] == path]
        children = [p for p in below if len(p) == len(path) + 1]
        saved = sum((len(members[p]) - 1) * (len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0) for p in below)
        leaves = sum(not any(q != p and q[: len(p)] == p for q in below) for p in below)
        ends = ",".join(str(c) for c in sorted(c for c in convs_of if len(made[c]) == len(path)))
        parent = min(members[path[:-1]]) if path else None
        out.append((min(convs_of), len(path), parent, len(convs_of), len(children), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


SCHEMA = "conv_id long, turn long, role string, text string, node string, key string, depth long"


@pytest.mark.parametrize("segment", [1024, 2])
def test_prefix_trie(spark, monkeypatch, segment):
    """Shared beginnings, nulls, ties, repeated rows, ids beyond a family and below zero, and conversations over several segments and runs."""
    monkeypatch.setattr(trie, "SEGMENT", segment)
    monkeypatch.setattr(trie, "RUN_BYTES", 5 if segment == 2 else 1 << 20)
    source, rows = random.Random(9), []
    for c in [*range(70), 200, 219, -1, -20, -25, 10**12]:
        for k in range(source.randrange(1, 7)):
            rows.append((c, k if source.random() < 0.9 else None, source.choice(["user", "assistant", None]), source.choice(["a b", "", None, "c", " \n"])))
    rows += rows[:5] + [(None, 0, "user", "x"), (3, 1, "userx", ""), (3, 1, "user", "x")]
    rows += [(500, k, "user", "same") for k in range(40)] + [(501, k, "user", "same") for k in range(45)]
    source.shuffle(rows)
    table = spark.createDataFrame([(*r, "n", "k", 7) for r in rows], SCHEMA).repartition(3)
    got = sorted((tuple(r) for r in trie.prefix_trie(table).collect()), key=str)
    assert got == brute_trie(rows)
    assert trie.prefix_trie(table.limit(0)).count() == 0


def test_numbering_of_a_key_over_many_tasks(spark, monkeypatch):
    """One key holds nearly all rows: every task numbers a part of it."""
    rows = spark.range(0, 5000, 1, 6).select(F.when(F.col("id") % 50 == 0, F.col("id")).otherwise(F.lit(7)).alias("k"), (F.col("id") * 7919 % 5000).alias("o"))
    got = trie.numbered(rows, "k", ["o"], {"o": F.col("o")}, "place").collect()
    of_key = sorted((r["o"], r["place"]) for r in got if r["k"] == 7)
    assert [p for _, p in of_key] == list(range(len(of_key))) and len(of_key) == 4900
    assert all(r["place"] == 0 for r in got if r["k"] != 7)


@pytest.mark.parametrize("last", [0, 8])
def test_components_of_a_chain_take_few_rounds(spark, monkeypatch, last):
    """Nodes numbered along a chain: rounds that take the least node around would shrink it by two nodes each."""
    chain, star = [(i, i + 1) for i in range(60)], [(2**40 + 7, 2**40 + i) for i in range(1, 20)]
    loop = [(-i, -(i % 9) - 1) for i in range(1, 10)]
    written = []
    monkeypatch.setattr(minhash, "LAST_LINKS", last, raising=False)
    real = minhash.stored
    monkeypatch.setattr(minhash, "stored", lambda df, name, *more: (written.append(name), real(df, name, *more))[1])
    links = chain + star + loop + [(5, 4), (900, 901), (33, 33)]
    label = {x: x for link in links for x in link if link[0] != link[1]}
    for _ in label:
        for x, y in links:
            label[x] = label[y] = min(label[x], label[y])
    found = minhash.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert len(found) == len(label) and {r["node"]: r["label"] for r in found} == label
    assert len(written) <= 30


def test_new_words_skip_the_pattern_of_the_library():
    """Blanks and ASCII letters are encoded by the model alone, other chunks by the whole library; ids are the library's."""

    class Watched:
        def __init__(self, library):
            self.library, self.asked = library, []

        def encode_batch_fast(self, texts, **more):
            self.asked += texts
            return self.library.encode_batch_fast(texts, **more)

    found = tokens.TextTokenizer(queries.IDS_FILE)
    texts = ["one gamma delta, it's Ġone\nünder gamma. zeta9", "", "two  blanks", "a\x00b \x00c", "gamma, " + "z" * 60 + ", q", " x", "gamma! delta gamma"] * 3
    want = [np.array(found.library.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]
    found.library = watched = Watched(found.library)
    for _ in range(3):
        assert found.packed(texts) == want
    watched.asked.clear()
    assert b"".join(found._chunks([" freshly", " nine9", " Möbel", "\nfreshly", " it's", " freshly"])) == np.array(watched.library.encode(" freshly nine9 Möbel\nfreshly it's freshly").ids, "<u4").tobytes()
    assert "".join(watched.asked) == " nine9 Möbel\nfreshly it's"
