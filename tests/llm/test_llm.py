"""The training-data operators against brute force, exact round trips and held-out accuracy."""

import base64
import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.llm import ann, boosting, bpe, chat, exact_dedup, html_extract, langid, minhash, packing, pieces, queries, token_store, tokens, url_filter
from plumbline.llm.common import join_groups, keyed, stored
from plumbline.llm.dom import Dom

DOCS = "doc_id long, text string, lang string, _row string, digest string"
LONG = "word " * 20_000 + "end"
ODD = [
    (1, "Hello World", "en", "x", "y"), (2, "hello world", "en", None, None), (3, None, None, "x", "y"), (4, "", "en", "x", "y"), (5, " \n ", "en", "x", "y"),
    (6, LONG, "en", "x", "y"), (7, LONG, "de", "x", "y"), (None, "hello WORLD", "en", "x", "y"), (8, "１２３ ٣ ½", None, "x", "y"), (9, "42", "en", "x", "y"), (9, "42", "en", "x", "y"),
]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("odd") / "docs")
    spark.createDataFrame(ODD, DOCS).coalesce(2).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").toPandas()


def reference_ids(texts):
    library = tokens.tokenizer(queries.IDS_FILE).library
    return [x.ids + [0] for x in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]


texts = st.lists(st.text(alphabet=st.one_of(st.sampled_from("aàé bc\n\t'sß日🙂12½_-,.\x1c\x85 "), st.characters(exclude_categories=["Cs"])), max_size=30), max_size=6)


@settings(max_examples=150, deadline=None)
@given(texts)
def test_packed_ids_equal_the_library(sample):
    t = tokens.tokenizer(queries.IDS_FILE)
    assert [np.frombuffer(x, "<u4").tolist() for x in t.packed(sample)] == [x.ids for x in t.library.encode_batch(sample, add_special_tokens=False)]


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary.load(queries.BPE_FILE)


@pytest.fixture(scope="module")
def tik(vocabulary):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})


@settings(max_examples=150, deadline=None)
@given(sample=texts)
def test_bpe_equals_tiktoken(vocabulary, tik, sample):
    for text, packed in zip(sample, bpe._memo(queries.BPE_FILE).of_all(sample), strict=True):
        want = tik.encode_ordinary(text)
        assert bpe.encode(vocabulary, text) == want == np.frombuffer(packed, "<u4").tolist()
        assert bpe.decode(vocabulary, want) == text.encode()


@settings(max_examples=100, deadline=None)
@given(text=st.text("ab the\n's1é", max_size=40), start=st.integers(0, 40), size=st.integers(0, 4), new=st.text("ab \n's1", max_size=4))
def test_bpe_edits(vocabulary, tik, text, start, size, new):
    start = min(start, len(text))
    edited = bpe.EditableText(vocabulary, text)
    edited.replace(start, min(len(text), start + size), new)
    assert edited.tokens() == tik.encode_ordinary(text[:start] + new + text[start + size :])
    table = bpe.PrefixTable(vocabulary, text.encode())
    table.append(new.encode())
    assert table.tokens() == bpe.PrefixTable(vocabulary, (text + new).encode()).tokens()


def test_bpe_query(spark, sf_dir, documents, tik):
    got = queries.op2_byte_bpe(spark, sf_dir).toPandas().set_index("doc_id")
    for i, text in zip(documents.doc_id, documents.text, strict=True):
        ids = tik.encode_ordinary(text or "")
        want = len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()
        assert tuple(got.loc[i][["n_tokens", "ids_sha256", "decoded_sha256"]]) == want


def test_url_rules():
    index = url_filter.Index(url_filter.seal(queries.URL_RULES))
    got = index.judge(["http://A.Example.NET/en/x?q", "http://x.net", "http://x.net/", "http://example.com/de/a#b", "http://badexample.com/de/", "ftp://w.org/fr/1", None, "x/y", "http://net/a"])
    assert [(r, v) for _, _, r, v in got] == [("example.net/en/", "allow"), (None, "allow"), ("net/", "block"), ("example.com/de/", "block"), (None, "allow"), ("org/fr/", "allow"), (None, "allow"), (None, "allow"), ("net/", "block")]
    assert got[0][:2] == ("a.example.net", "/en/x") and got[6][:2] == ("", "")
    assert url_filter.Index(url_filter.seal([])).judge(["http://a.b/"]) == [("a.b", "/", None, "allow")]


def test_url_digest_collisions_are_confirmed():
    index = url_filter.Index(url_filter.seal([url_filter.Rule("a.b", "/", "block")]))
    index.keys = np.array([url_filter.xxhash.xxh64_intdigest(b"stranger")], "<u8")
    assert index.probe([b"stranger"]).tolist() == [-1]


def brute_components(docs, width, percent):
    sets = {}
    for i, text in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").encode().lower().decode())
        sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((find(a), find(b)))
                    parent[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(spark, tmp_path, documents, width, percent):
    source = random.Random(3)
    rows = list(zip(documents.doc_id.tolist(), documents.text.tolist(), strict=True))[:120]
    base = "".join(source.choice("abcdefgh ") for _ in range(2000)).split()
    for i in range(150):  # a dense family of copies, each a little different
        copy = list(base)
        for _ in range(source.randint(0, 14)):
            copy[source.randrange(len(copy))] = f"w{source.randrange(99)}"
        rows.append((10_000 + i, " ".join(copy)))
    rows += [(20_001, None), (20_002, ""), (20_003, "a b"), (20_004, "A  b"), (20_005, "a")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    got = minhash.near_duplicates(spark.read.parquet(str(tmp_path / "d")), width, percent).collect()
    want = brute_components(rows, width, percent)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_duplicates_of_odd_rows(odd, empty):
    got = minhash.near_duplicates(odd, 3, 85).collect()
    assert len(got) == len(ODD)
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[2]["component_id"] == 1 and by_id[None]["component_id"] == 1 and by_id[7]["component_id"] == 6
    assert by_id[3]["n_shingles"] == 0 and by_id[4]["component_id"] == 4
    assert sum(r["kept"] for r in got if r["doc_id"] == 9) == 1
    assert minhash.near_duplicates(empty).count() == 0


def test_perfect_hash():
    digests = [hashlib.sha256(str(i).encode()).digest() for i in range(5000)]
    table = exact_dedup.PerfectHash(np.frombuffer(b"".join(digests[:4000]), np.uint8).reshape(-1, 32))
    slots = table.lookup(np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 32))
    assert sorted(slots[:4000]) == list(range(4000)) and (slots[4000:] == -1).all()
    assert exact_dedup.PerfectHash(np.zeros((0, 32), np.uint8)).lookup(np.ones((1, 32), np.uint8)).tolist() == [-1]


def test_exact_duplicates_of_odd_rows(odd, empty):
    got = {(r["doc_id"], r["kept"]): r for r in exact_dedup.deduplicate(odd).collect()}
    assert got[2, True]["group_size"] == 3 and got[1, False]["keep_id"] == 2 and got[None, False]["keep_id"] == 2
    assert got[4, True]["group_size"] == 2 and got[3, False]["keep_id"] == 4
    assert (9, True) in got and (9, False) in got
    assert exact_dedup.deduplicate(empty).count() == 0
    assert exact_dedup.deduplicate(odd, history=odd).where("kept").count() >= 1


def test_join_groups(spark):
    rows = spark.range(5000).withColumn("k", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")))
    groups = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    assert join_groups(rows, groups, "k", "n", 5000).agg(F.sum("n")).first()[0] == 1667**2 + 3333


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 6), max_size=20))
def test_packing_is_whole_and_tight(lengths):
    bins = packing.bin_completion(lengths, 64)
    held = collections.Counter()
    for contents, times in bins:
        assert sum(contents) <= 64
        held.update({s: contents.count(s) * times for s in set(contents)})
    assert held == collections.Counter(lengths)
    n = sum(t for _, t in bins)
    counts = [lengths.get(s, 0) for s in range(65)]
    assert n <= len(packing.best_fit_decreasing(lengths, 64)) and n >= packing.least_bins(counts, 64)


def test_packing_query(spark, sf_dir, documents):
    got = queries.op6_packing(spark, sf_dir).toPandas()
    ids = dict(zip(documents.doc_id, reference_ids(documents.text), strict=True))
    for i, part in got.groupby("doc_id"):
        part = part.sort_values("piece")
        assert part.piece.tolist() == list(range(len(part))) and part.length.sum() == len(ids[i])
        assert part.start.tolist() == [0, *np.cumsum(part.length)[:-1]] and (part.length[1:] == 2048).all() and part.length.max() <= 2048
        for r in part.itertuples():
            assert zlib.crc32(np.array(ids[i][r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
    for _, part in got.groupby("sequence_id"):
        part = part.sort_values("offset")
        assert part.offset.tolist() == [0, *np.cumsum(part.length)[:-1]] and part.length.sum() <= 2048
    assert got.sequence_id.nunique() <= 1.02 * -(-got.length.sum() // 2048) + 1


def test_packing_of_odd_rows(odd, empty):
    got = packing.pack_documents(odd, queries.IDS_FILE).toPandas()
    assert len(got[got.doc_id == 9]) == 2 and got.doc_id.isna().sum() == 1 and got[got.doc_id == 3].length.tolist() == [1]
    assert packing.pack_documents(empty, queries.IDS_FILE).count() == 0


def test_token_store(spark, sf_dir, documents, odd, empty, tmp_path):
    got = queries.op9_token_store(spark, sf_dir).toPandas().set_index("doc_id")
    start = 0
    for i, ids in zip(documents.doc_id, reference_ids(documents.text), strict=True):
        assert tuple(got.loc[i][["start", "n_tokens", "ids_crc32"]]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    token_store.write_store(odd, str(tmp_path / "s"), queries.IDS_FILE)
    assert [len(r["tokens"]) for r in token_store.lookup(spark, str(tmp_path / "s"), [9, 3]).collect() if r["doc_id"] == 3] == [1]
    assert token_store.read_store(spark, str(tmp_path / "s")).count() == len(ODD)
    token_store.write_store(empty, str(tmp_path / "e"), queries.IDS_FILE)
    assert token_store.checksums(token_store.read_store(spark, str(tmp_path / "e"))).count() == 0


said = st.text(alphabet=st.sampled_from("a\\#</turn>: \né"), max_size=20)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(said, said), max_size=5))
def test_chat_template_reads_back(turns):
    assert list(chat.read_turns("".join(chat.format_turn(r, t)[0] for r, t in turns))) == turns


def test_chat_query(spark, sf_dir):
    got = queries.op7_chat_format(spark, sf_dir).toPandas().set_index("conv_id")
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").toPandas()
    for i, part in rows.sort_values(["conv_id", "turn"]).groupby("conv_id"):
        turns = hashlib.sha256("".join(f"{r}\n{t or ''}\n" for r, t in zip(part.role, part.text, strict=True)).encode()).hexdigest()
        loss = "".join(t or "" for r, t in zip(part.role, part.text, strict=True) if r == "assistant")
        assert tuple(got.loc[i][["n_turns", "turns_sha256", "loss_chars", "loss_sha256"]]) == (len(part), turns, len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert got.loc[-7].loss_chars == 26


def test_chat_layouts(spark):
    assert chat.canonical_turns({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}], "extra": 1}) == [("user", "q"), ("assistant", "a")]
    assert chat.canonical_turns({"system": "s", "conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}) == [("system", "s"), ("user", "q"), ("assistant", "a")]
    assert chat.canonical_turns({"instruction": "do", "input": "this", "output": "done"}) == [("user", "do\n\nthis"), ("assistant", "done")]
    assert chat.canonical_turns({"unknown": 1}) is None
    records = spark.createDataFrame([(1, '{"prompt":"q","response":"a"}'), (2, None), (3, "{"), (4, "[]")], "conv_id long, record string")
    assert [(r["conv_id"], r["role"]) for r in chat.turns_of_json(records).collect()] == [(1, "user"), (1, "assistant")]
    rows = spark.createDataFrame([(1, None, None, None), (1, 0, "assistant", None), (None, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    assert {r["conv_id"]: r["n_turns"] for r in chat.read_back(chat.format_conversations(rows)).collect()} == {1: 2, None: 1}
    assert chat.read_back(chat.format_conversations(rows.limit(0))).count() == 0


def test_language_id(spark, sf_dir, documents, odd, empty):
    got = queries.op8_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    out = got[got.held_out]
    assert (out.lang_pred == out.lang).mean() > 0.98 and got.score.between(0, 1).all()
    assert all(h == (zlib.crc32(str(i).encode()) % 4 == 2) for i, h in zip(got.doc_id, got.held_out, strict=True))
    model = langid.train(odd)
    found = {r["doc_id"]: r["lang_pred"] for r in langid.identify(odd, model, ["doc_id", "_row"]).collect()}
    assert found[3] == found[4] == found[5] == found[8] == found[9] == "und" and found[1] in ("en", "de")
    assert langid.identify(empty, model, ["doc_id"]).count() == 0
    assert langid.train(empty).predict(["text"])[0][0] == "und"


def test_html_on_made_up_pages():
    mark = html_extract._MARK
    sources = html_extract.made_up_pages(150, seed=77)
    got = html_extract.main_texts([s.replace(mark, "") for s in sources], html_extract.fitted())
    want = [" ".join("".join((t if mark in t or not t.strip() else "") if t is not None else " " for _, t in Dom(s).texts).split()).replace(mark, "") for s in sources]
    assert np.mean([g == w for g, w in zip(got, want, strict=True)]) > 0.9


def test_html_query(spark, sf_dir):
    import html

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").toPandas().set_index("page_id")
    for r in queries.op1_html_extract(spark, sf_dir).collect():
        inside = re.search(r"<article>(.*)</article>", pages.html[r["page_id"]], re.S)[1]
        want = " ".join(html.unescape(re.sub(r"</?b>", "", re.sub(r"</?(?:p|h1|br)>", " ", inside))).split())
        assert (r["text"], r["n_chars"]) == (want, len(want))


def test_html_edges(spark):
    trees = html_extract.fitted()
    assert html_extract.main_texts([None, "", "<p", "<", "<!-- x", "<script>a"], trees) == ["", "", "", html_extract.main_texts(["<"], trees)[0], "", ""]
    page = "<nav><a href=x>Menu</a></nav><article><p>One &amp; two</p><p>three<div class=comments><p>not this</p></div></article><footer>No</footer>"
    assert html_extract.main_texts([page], trees) == ["One & two three"]
    rows = spark.createDataFrame([(1, None, None), (2, "u", page)], "page_id long, url string, html string")
    assert [r["n_chars"] for r in html_extract.extract(rows).orderBy("page_id").collect()] == [0, 15]
    assert html_extract.extract(rows.limit(0)).count() == 0


def test_decoding_is_the_best_consistent_labelling():
    page = html_extract.Page("<div><p>a</p><div><p>b</p></div></div>")
    source = np.random.default_rng(1)
    for _ in range(50):
        scores = source.normal(size=len(page.nodes))
        keep = page.kept(scores)
        best = -1e9
        inner = page.nodes[1:]
        for m in range(1 << len(inner)):
            k = {0: True} | {n: bool(m >> i & 1) for i, n in enumerate(inner)}
            if all(not k[n] or k[page.parent[n]] for n in inner):
                best = max(best, sum(scores[i] if k[n] else -scores[i] for i, n in enumerate(page.nodes)))
        assert np.isclose(best, sum(scores[i] if keep[n] else -scores[i] for i, n in enumerate(page.nodes)))


def test_boosting_learns():
    x = np.random.default_rng(0).normal(size=(2000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    assert ((boosting.fit(x, y).scores(x) > 0) == y).mean() > 0.97


def test_ann(spark, sf_dir):
    got = queries.op10_ann(spark, sf_dir).toPandas()
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").toPandas()
    x = np.stack(e.embedding).astype(float)
    hits = total = 0
    for i in e.vec_id[e.vec_id % 20 == 0]:
        mine = got[got.query_id == i].sort_values("rank")
        scores = x @ x[e.vec_id.tolist().index(i)]
        assert np.allclose(mine.score, [scores[e.vec_id.tolist().index(v)] for v in mine.vec_id], atol=1e-12)
        want = [v for v in e.vec_id.to_numpy()[np.lexsort((e.vec_id, -scores))] if v != i][:20]
        hits += len(set(want) & set(mine.vec_id))
        total += 20
        assert mine["rank"].tolist() == list(range(1, 21))
    assert hits / total >= 0.9


def test_ann_radius_is_complete():
    codes = np.random.default_rng(2).integers(0, 2**32, (500, ann.SUBSTRINGS), dtype=np.uint32)
    index, far = ann.SubstringIndex(codes), ann.hamming(codes[:5], codes)
    for q in range(5):
        for radius in (0, 90, 110, 256):
            assert index.within(codes[q], radius).tolist() == np.flatnonzero(far[q] <= radius).tolist()


def test_ann_of_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [float("inf"), 1.0]), (20, [0.0, 2.0]), (None, [1.0, 1.0]), (8, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1)
    got = ann.nearest(df).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["vec_id"]) for r in got] == [(0, 1), (0, 2), (0, 20), (20, 0), (20, 1), (20, 2)]
    assert ann.nearest(df.limit(0)).count() == 0


def test_pieces_join_to_the_text():
    for t in ("a  b\n c", "x²½ 3", "it's", "日本 語"):
        assert "".join(pieces.split(t)) == t


def test_pipeline(spark, sf_dir, documents):
    import corpus_pipeline

    got = corpus_pipeline.run(spark, sf_dir).toPandas()
    lowered = {}
    for i, t in zip(documents.doc_id, documents.text, strict=True):
        key = (t or "").encode().lower()
        lowered[key] = max(lowered.get(key, -1), i)
    kept = [(i, t) for i, t in zip(documents.doc_id, documents.text, strict=True) if t and any(c.isalpha() for c in t) and lowered[t.encode().lower()] == i]
    want = {i for i, (_, c) in brute_components(kept, 5, 80).items() if i == c}
    assert set(got.doc_id) == want


def test_near_duplicates_between_two_crowded_families(spark, tmp_path):
    """One pair at the threshold joins two families whose members all stand nearer to their own."""
    source = random.Random(5)
    x = [f"c{i}" for i in range(400)]
    y = x[:368] + [f"y{i}" for i in range(32)]  # 366 of 398 + 32 shingles of 3 words are shared: 0.851
    rows = [(1, " ".join(x)), (2, " ".join(y))]
    for i in range(1200):
        copy = list(x if i % 2 else y)
        for k in range(2):
            copy[source.randrange(360)] = f"{i}.{k}"
        rows.append((10 + i, " ".join(copy)))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    got = minhash.near_duplicates(spark.read.parquet(str(tmp_path / "d")), 3, 85).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(rows, 3, 85)


def test_near_duplicates_in_a_shared_template(spark, tmp_path):
    """Thousands of texts at about 0.7 around pairs at the threshold."""
    source = random.Random(6)
    template = [f"t{i}" for i in range(170)]
    rows = []
    for i in range(1500):
        own = [f"{i}.{k}" for k in range(32)]
        rows.append((2 * i, " ".join(template + own)))
        if i % 10 == 0:  # shares 184 of 200 + 16 shingles: 0.852
            rows.append((2 * i + 1, " ".join(template + own[:16] + [f"{i}.{k}." for k in range(16)])))
    source.shuffle(rows)
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    got = minhash.near_duplicates(spark.read.parquet(str(tmp_path / "d")), 3, 85).collect()
    want = {i: 2 * (i // 2) for i, _ in rows}
    assert {r["doc_id"]: r["component_id"] for r in got} == want


@pytest.mark.parametrize("block", [4096, 5])
def test_missed_links_alone(spark, tmp_path, monkeypatch, block):
    """The exact join finds every link without the forest, with common shingles dealt in blocks as well."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    source = random.Random(7)
    rows = []
    for i in range(60):
        words = [f"f{i % 3}.{k}" for k in range(80)]
        for _ in range(source.randint(0, 9)):
            words[source.randrange(80)] = f"w{source.randrange(9)}"
        rows.append((i, " ".join(words)))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    docs = keyed(spark.read.parquet(str(tmp_path / "d")), "_row")
    found = minhash.features(docs, 3).dropDuplicates(["digest"]).cache()
    named = {r["doc_id"]: r["doc_id"] for r in found.collect()}
    members = found.select(F.col("doc_id").alias("node"), "n", "parity", F.col("doc_id").alias("label"))
    sets_of = minhash.shingles(docs.join(found.select("_row"), "_row", "left_semi").withColumn("node", F.col("doc_id")), 3)
    postings = minhash.postings_of(sets_of, 80, minhash.common_shingles(sets_of))
    met = minhash.met_by_prefix(postings, members, 80, "all")
    got = {tuple(sorted((r["a"], r["b"]))) for r in minhash.confirmed(met, sets_of, 80).collect()}
    sets = {i: set(minhash.shingle_set(t, 3).tolist()) for i, t in rows if i in named.values()}
    want = {(i, j) for i in sets for j in sets if i < j and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    assert got == want and want


def test_hidden_links_connect_as_all_links_do(spark):
    """Nearest pairs of labels first, then the rest: the components are those of all links."""
    source = random.Random(8)
    rows = []
    for i in range(50):
        words = [f"f{i % 2}.{k}" for k in range(80)]
        for _ in range(source.randint(0, 12)):
            words[source.randrange(80)] = f"w{source.randrange(9)}"
        rows.append((i, " ".join(words)))
    docs = keyed(spark.createDataFrame(rows, "doc_id long, text string"), "_row")
    found = minhash.features(docs, 3)
    members = stored(found.select(F.col("doc_id").alias("node"), "n", "parity", "marks", (F.col("doc_id") - F.col("doc_id") % 2).alias("label")), "members")
    sets_of = stored(minhash.shingles(docs.withColumn("node", F.col("doc_id")), 3), "sets")
    links = minhash.hidden_links(members, sets_of, 85).collect()
    parent = {i: i - i % 2 for i in range(50)}
    want = dict(parent)
    sets = {i: set(minhash.shingle_set(t, 3).tolist()) for i, t in rows}

    def join(of, pairs):
        for a, b in pairs:
            low, high = sorted((of[a], of[b]))
            of.update({k: low for k, v in of.items() if v == high})

    join(want, [(i, j) for i in sets for j in sets if i < j and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])])
    join(parent, [(r["a"], r["b"]) for r in links])
    assert parent == want and len(set(want.values())) < 25


def test_components_of_long_chains(spark):
    """Paths, stars and cycles, joined by their least nodes; names in any order."""
    source = random.Random(2)
    names = source.sample(range(10_000), 300)
    links = [(names[i], names[i + 1]) for i in range(99)] + [(names[100], names[i]) for i in range(101, 200)] + [(names[200 + i], names[200 + (i + 1) % 100]) for i in range(100)]
    got = {r["node"]: r["label"] for r in minhash.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: min(names[k - k % 100 : k - k % 100 + 100]) for k, n in enumerate(names)}


@pytest.mark.parametrize("operator", ["near", "exact"])
def test_keys_hold_when_the_cluster_changes(spark, tmp_path, operator):
    """Rows judged under one number of splits are the ones kept under another."""
    import corpus_pipeline

    rows = [(i, f"text {i // 3} of three " + " ".join(f"{i // 3}.{k}" for k in range(40))) for i in range(900)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(40).write.parquet(str(tmp_path / "d"))
    stage = getattr(corpus_pipeline, operator)
    try:
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", "4")
        kept = stage(spark, spark.read.parquet(str(tmp_path / "d")), "")
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", "16")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
        assert sorted(r["doc_id"] for r in kept.collect()) == [3 * i + (2 if operator == "exact" else 0) for i in range(300)]
    finally:
        spark.conf.unset("spark.sql.leafNodeDefaultParallelism")
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_stages_keep_columns_of_any_name(spark, tmp_path):
    """Nulls, empty texts, repeated rows, no rows, and columns whose names clash with the operators' own."""
    import corpus_pipeline

    names = ["a.b", "__text", "tick`s", "found_score", "_row", "row", "digest", "kept", "label", "text_of_row"]
    rows = [(i, t, lang, "s", 1, *["x"] * len(names)) for i, t, lang in [(1, "the cat sat on the mat " * 3, "en"), (1, "the cat sat on the mat " * 3, "en"), (2, "die Katze saß auf der Matte " * 3, "de"), (3, None, "en"), (4, "", None), (5, "½ ²", "en"), (None, "the dog ran to the door " * 3, "en")]]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join("`" + n.replace("`", "``") + "` string" for n in names)
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    for (name, stage), ids in zip(corpus_pipeline.STAGES[:3], ([1, 1, 2, None], [1, 2, 3, 5, None], [1, 2, 3, 4, 5, None]), strict=True):
        out = stage(spark, docs, "")
        assert out.columns == docs.columns, name
        got = [r["doc_id"] for r in out.collect()]
        if name == "exact dedup":
            ids = [1, 2, 4, 5, None]  # null and empty texts are equal
        if name == "near dedup":
            ids = [1, 2, 3, 4, 5, None]
        assert sorted(got, key=str) == sorted(ids, key=str), name
        assert stage(spark, docs.limit(0), "").count() == 0
    packed = corpus_pipeline.pack(spark, docs, "").collect()
    assert len(packed) == len(rows)


def test_letters_are_letters(spark):
    """Numbers that look like letters are none."""
    model = langid.fit(["the cat sat on the mat", "die Katze saß auf der Matte"], ["en", "de"])
    assert [p[0] for p in model.predict(["½ ² ¾", "①② Ⅷ", "x", "ª"])][:2] == ["und", "und"]
    assert "und" not in [p[0] for p in model.predict(["x", "ª", "漢"])]


def test_chat_layouts_in_combination(spark):
    assert chat.canonical_turns({"system": "s", "prompt": "q", "response": "a"}) == [("system", "s"), ("user", "q"), ("assistant", "a")]
    assert chat.canonical_turns({"system": "s", "instruction": "do", "input": "this", "output": "done"}) == [("system", "s"), ("user", "do\n\nthis"), ("assistant", "done")]
    assert chat.canonical_turns({"messages": [{"role": "user", "content": "q"}], "prompt": "q"}) == [("user", "q")]
    assert chat.canonical_turns({"prompt": "q", "completion": "a", "text": "qa"}) == [("user", "q"), ("assistant", "a")]
    records = spark.createDataFrame([(1, '{"strange":1}')], "conv_id long, record string")
    assert [tuple(r) for r in chat.turns_of_json(records).collect()] == [(1, None, None, '{"strange":1}')]


def test_chat_tables_of_other_layouts(spark):
    """The selected mapping names the columns; columns of other layouts, null and repeated rows and long texts do no harm."""
    long = "### x \\ </turn>" * 50_000
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", long), (2, 0, "user", None), (2, 0, "user", None), (None, None, None, "t")]
    plain = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = sorted(map(str, chat.read_back(chat.format_conversations(plain)).collect()))
    assert len(want) == 3
    other = plain.toDF("conversation_id", "position", "from", "value")
    crowded = plain.selectExpr("*", "'x' AS prompt", "'y' AS system", "'z' AS content", "1 AS `a.b`", "2 AS segment")
    for table in (other, plain.toDF("conversation_id", "position", "role", "content"), crowded):
        assert sorted(map(str, chat.read_back(chat.format_conversations(table)).collect())) == want
    with pytest.raises(ValueError, match="no mapping"):
        chat.format_conversations(plain.drop("turn"))


def test_chat_roles_of_tables(spark):
    """Other layouts' names of the roles are put through the same table as those of JSON records."""
    rows = [(1, 0, "human", "q"), (1, 1, "gpt", "a"), (2, 0, None, "x"), (2, 1, "narrator", "y")]
    other = spark.createDataFrame(rows, "conversation_id long, position long, from string, value string")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(other)).collect()}
    assert (got[1]["loss_chars"], got[2]["loss_chars"]) == (1, 0)
    assert got[1]["turns_sha256"] == hashlib.sha256(b"user\nq\nassistant\na\n").hexdigest()
    assert got[2]["turns_sha256"] == hashlib.sha256(b"\nx\nnarrator\ny\n").hexdigest()


RULES = [url_filter.Rule(*r) for r in (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.net", "/en/", "block"), ("a.b", "", "allow"), ("b", "/x", "block"), ("", "/", "block"), ("é.org", "/ü", "block"))]
URLS = ["http://NET/", "x://a.example.net/en/q?z", "x://example.net/de", "x://a.b", "x://c.a.b/x?y", "x://b/x#", "x://ab/x", "x://", "no", None, "", "x://É.org/ü", "x://é.org/üa", "x://.net/", "x://net:80/", "a://b://net/", "x://b/x" + "/y" * 40_000]


def test_long_rule_lists_are_joined(spark, monkeypatch):
    """Rules beyond what every executor gets give the same verdicts; nulls, long urls, repeated rows, an empty table, clashing names."""
    rows = [(i, u, "h", "p", 1, "v", "k") for i, u in enumerate(URLS)] + [(0, URLS[0], "h", "p", 1, "v", "k"), (None, URLS[1], None, None, None, None, None)]
    pages = spark.createDataFrame(rows, "`page.id` long, url string, host string, path string, row long, verdict string, digest string").withColumn("page_id", F.col("`page.id`"))
    want = sorted(map(str, url_filter.judge_urls(pages, RULES, ("page_id", "digest", "page.id")).collect()))
    monkeypatch.setattr(url_filter, "INDEX_BYTES", 10)
    assert sorted(map(str, url_filter.judge_urls(pages, RULES, ("page_id", "digest", "page.id")).collect())) == want
    assert len(want) == len(URLS) + 2 and sum("block" in w for w in want) >= 6
    for table in (pages.limit(0),):
        assert url_filter.judge_urls(table, RULES).count() == 0


def test_byte_bpe_of_odd_rows(odd, empty, tik):
    """Null, empty, long and repeated texts, an empty table, columns of other names."""
    got = [tuple(r)[:4] for r in bpe.digests(bpe.encode_texts(odd, queries.BPE_FILE), queries.BPE_FILE).collect()]
    want = []
    for i, text, *_ in ODD:
        ids = tik.encode_ordinary(text or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(got, key=str) == sorted(want, key=str)
    assert bpe.digests(bpe.encode_texts(empty, queries.BPE_FILE), queries.BPE_FILE).count() == 0


def test_html_of_deep_and_repeated_pages(spark):
    """A very deep and a very long page, repeated rows, and columns of other names."""
    deep = "<div>" * 3000 + "<p>" + "These words stand far below all else, and there are quite a few of them. " * 5 + "</p>" + "</div>" * 3000
    long = "<body><article>" + "".join(f"<p>Paragraph {i} tells its part of a long story, one of very many here.</p>" for i in range(5000)) + "</article></body>"
    rows = [(1, "u", deep, "x"), (2, "u", long, "x"), (2, "u", long, "x"), (None, None, None, None)]
    got = {}
    for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect():
        got.setdefault(r["page_id"], []).append(r)
        assert r["n_chars"] == len(r["text"])
    assert len(got[2]) == 2 and got[2][0] == got[2][1] and "Paragraph 4999" in got[2][0]["text"] and got[None][0]["text"] == ""
    assert len(got[1]) == 1


def test_token_files_are_skipped_by_their_ids(spark, tmp_path):
    """A look for one document reads the stripes whose statistics and Bloom filters leave it open, and finds null ids and ties."""
    rows = [(i, f"text number {i}") for i in range(2000)] + [(7, "again"), (None, "no id")]
    token_store.write_store(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), str(tmp_path / "s"), queries.IDS_FILE)
    store = token_store.read_store(spark, str(tmp_path / "s"))
    assert store.where("doc_id = 7").count() == 2 and store.where("doc_id IS NULL").count() == 1
    found = token_store.lookup(spark, str(tmp_path / "s"), [7, 1999])
    assert found.count() == 3 and "PushedFilters: [In(doc_id, [" in found._jdf.queryExecution().toString()
    start = 0
    for r in token_store.checksums(store).orderBy(F.col("doc_id").asc_nulls_last(), "start").collect():
        assert r["start"] >= 0
        start += r["n_tokens"]
    assert start == sum(len(x) for x in reference_ids([t for _, t in rows]))
