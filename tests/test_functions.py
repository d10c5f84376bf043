import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline import config
from plumbline.errors import ConfigError
from plumbline.functions import fts
from plumbline.functions.markdown import chunk_markdown, sections, sentence_end, split_words, tail
from plumbline.operators.gates import roots_of, under_indexed_root
from plumbline.operators.retrieval import mmr_order
from plumbline.operators.windows import chunk_windows
from plumbline.plans.embedding import truncate_and_normalise


@pytest.mark.parametrize(
    ("raw", "clean"),
    [("rust programming", "rust programming"), ('"hello world"', "hello world"), ("foo* AND bar", "foo AND bar"), ("(one OR two)", "one OR two"), ("-bad token", "bad token"), ("---triple", "triple"), ("", ""), ('""()', "")],
)
def test_sanitize(raw, clean):
    assert fts.sanitize(raw) == clean


def test_query_syntax():
    assert fts.parse("a b").clauses == [([0, 1], [])]
    assert fts.parse("a OR b").clauses == [([0], []), ([1], [])]
    assert fts.parse("a NOT b").clauses == [([0], [1])]
    assert fts.parse("unique_token_xyz").phrases == [["unique", "token", "xyz"]]
    assert fts.parse("how does it work?") is None and fts.parse("multi-tenant") is None
    assert fts.parse("AND a") is None and fts.parse("") is None
    assert fts.parse("—").clauses == []


def test_sections_and_context():
    text = "# A\n\nbody of a that is long enough to stand alone as a chunk here\n\n## B\n\nmore text in b that is long enough too, surely it is so\n\n### C\n\ndeep text that is also long enough to be on its own, yes\n\n# D\n\nlast one is also long enough to be a chunk of its own here\n"
    chunks = chunk_markdown(text, 1000, 100)
    assert [c.heading_context for c in chunks] == ["A", "A > B", "A > B > C", "D"]
    assert chunk_markdown("", 1000, 100) == [] and chunk_markdown("  \n ", 1000, 100) == []
    assert chunk_markdown("# My Title", 1000, 100)[0].heading_context == "My Title"
    assert all(0 <= c.start_byte <= c.end_byte <= len(text.encode()) for c in chunks)


def test_chunk_sizes():
    sentence = "This sentence is exactly about seventy bytes long, or so one would say. "
    many = chunk_markdown(sentence * 9, 200, 50)
    assert len(many) > 1 and all(len(c.content.encode()) <= 260 for c in many)
    assert len(chunk_markdown("word" * 100, 50, 10)) > 1
    merged = chunk_markdown("# T\n\n" + "long text " * 20 + "\n\n## Tiny\n\nShort.\n", 1000, 100)
    assert len(merged) == 1 and merged[0].content.endswith("Short.")
    assert [c.content for c in split_words("aa bb cc", 5, 2, 0, "")] == ["aa bb", "bb cc"]
    assert tail("héé", 3) == "éé" and sentence_end("One! Two. Three", 12) == 5


def test_fences_are_no_headings():
    assert [c.heading_context for c in sections("# A\n\n```\n# not\n```\n")] == ["A"]


def assembled(spark, parts, target, most, radius=9):
    """The context of a part among those of its document, between parts of another."""
    rows = [(10 * d + i, d, i, x) for d in (0, 1, 2) for i, x in enumerate(parts if d == 1 else ["other"] * 4)]
    chunks = spark.createDataFrame(rows, "id long, document_id long, chunk_index long, content string")
    return chunk_windows(chunks, chunks.where(F.col("id") == 10 + target).select("id"), radius, most).first()["context"]


def test_context_windows(spark):
    """Sides grow in turns, left first, and end at the first part that doesn't fit; all of it is decided by the frame's lengths."""
    assert assembled(spark, ["a", "b", "c"], 1, 100) == "a\n\nb\n\nc"
    assert assembled(spark, ["a", "b", "c"], 0, 100) == "a\n\nb\n\nc"
    assert assembled(spark, ["a", "b", "c", "d", "e"], 2, 100, radius=1) == "b\n\nc\n\nd"
    assert assembled(spark, ["a", "x" * 50, "b", "c", "d"], 2, 12) == "b\n\nc\n\nd"  # the left side ends, whatever lies beyond
    assert assembled(spark, ["aa", "b", "cc"], 1, 6) == "aa\n\nb"
    assert assembled(spark, ["x", "abcdefghij", "y"], 1, 4) == "abcd"
    assert assembled(spark, ["x", "abcd", "y"], 1, 4) == "abcd"
    assert assembled(spark, ["ééééé"], 0, 3) == "ééé"
    assert assembled(spark, [None, "b", None], 1, 10) == "\n\nb\n\n"
    chunks = spark.createDataFrame([(1, 1, 0, "a"), (2, 1, 0, "b"), (3, 1, 1, "c")], "id long, document_id long, chunk_index long, content string")
    got = {r["target_id"]: r["context"] for r in chunk_windows(chunks, chunks.select("id"), 0, 99).collect()}
    assert got == {1: "a\n\nb", 2: "a\n\nb", 3: "c"}


def test_mmr():
    assert mmr_order([], [], 3, 0.7) == []
    assert len(mmr_order([0.5, 0.4], [[1, 0], [0, 1]], 5, 0.7)) == 2
    assert mmr_order([0.6, 0.9, 0.3], [[1], [1], [1]], 1, 1.0) == [1]
    assert mmr_order([0.5, 0.5], [[], []], 1, 0.7) == [1]  # ties go to the last


def test_vectors():
    x = truncate_and_normalise(np.array([[3.0, 4.0, 9.0], [0, 0, 0]]), 2)
    assert np.allclose(x, [[0.6, 0.8], [0, 0]])


def test_config():
    assert config.from_toml("") == config.EngineConfig()
    for bad in ({"embedding_dim": 32}, {"embedding_dim": 769}, {"model_id": "x"}, {"max_chunk_tokens": 0}, {"max_chunk_tokens": 100, "chunk_overlap_chars": 400}):
        with pytest.raises(ConfigError):
            config.EngineConfig(**bad).validated()
    assert config.EngineConfig().with_overrides(model="all-minilm-l6-v2").embedding_dim == 384


@pytest.mark.parametrize(
    ("target", "cwd", "paths", "form"),
    [
        ("docs/sub/new.md", None, ["docs/foo.md"], "docs/sub/new.md"),
        ("node_modules/pkg/README.md", None, ["docs/foo.md"], None),
        ("/proj/docs/new.md", "/proj", ["docs/foo.md"], "docs/new.md"),
        ("/proj/docs/new.md", None, ["docs/foo.md"], None),
        ("/proj/docs/new.md", "/proj", ["/proj/docs/foo.md"], "/proj/docs/new.md"),
        ("/proj/CHANGELOG.md", "/proj", ["README.md"], None),
        ("/proj/docs/new.md", None, ["/proj/docs/sub/seed.md"], None),
        ("/bar.md", None, ["/foo.md"], None),
    ],
)
def test_under_indexed_root(spark, target, cwd, paths, form):
    assert under_indexed_root(target, cwd, spark.createDataFrame([(p,) for p in paths], "path string")) == form


def test_roots_of(spark):
    """The longest root wins; a root's own path, slashes at the end, the topmost folder, repeated rows and nulls."""
    paths = [("/a/b/c.md", 1), ("/a/b", 2), ("/ab/c.md", 3), ("x/y.md", 4), ("x/y.md", 4), (None, 5), ("z", 6)]
    table = spark.createDataFrame(paths, "path string, n long")
    roots = spark.createDataFrame([("/a",), ("/a/b/",), ("x",), ("/a/b/c.md/d",), (None,)], "root string")
    got = sorted((r["n"], r["root"]) for r in roots_of(table, roots).collect())
    assert got == [(1, "/a/b/"), (2, "/a/b/"), (4, "x"), (4, "x")]
    top = spark.createDataFrame([("/",)], "root string")
    assert sorted(r["n"] for r in roots_of(table, top).collect()) == [1, 2, 3]


def test_sections_follow_commonmark():
    def texts(markdown):
        return [(s.content, s.heading_context) for s in sections(markdown)]

    assert texts("- aaa\n- bbb") == [("aaa bbb", "")]
    assert texts("- aaa\n\n- bbb") == [("aaa\n\n bbb", "")]
    assert texts("- a\n  - b\n  - c\n- d") == [("a b c d", "")]
    assert texts("a &amp; b") == [("a  &  b", "")]
    assert texts("> # H\n> x\nlazy") == [("H x\n lazy", "H")]
    assert texts("[x]: http://u\n\n[x] and [y]") == [("x  and  [ y ]", "")]
    assert texts("    code\n\nTop\n===\ntext") == [("code", ""), ("Top text", "Top")]
    assert texts("- a\n\n  ~~~\n  # no heading\n  ~~~") == [("a\n\n # no heading", "")]
    assert texts("<div>\nraw\n</div>\n\ntext \\*q [l](u)") == [("text  *q  l", "")]
    assert texts("") == texts("\n \n") == []
