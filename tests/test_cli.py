"""The command line from end to end, in one session."""

import json

import numpy as np
import pytest

from plumbline import cli
from plumbline.config import EngineConfig
from plumbline.plans.bank import Bank
from plumbline.plans.embedding import HashEmbedder, Shared


@pytest.fixture
def run(spark, tmp_path, capsys):
    def call(*args):
        code = cli.main(["--db", str(tmp_path / "bank"), "--dim", "64", *args])
        return code, capsys.readouterr().out

    return call


def test_command_line(run, tmp_path):
    root = tmp_path / "docs"
    root.mkdir()
    (root / "a.md").write_text("# Alpha\n\nThe first text speaks about apples.\n\n## More\n\n" + "Pears are spoken of as well, further down. " * 3)
    (root / "b.md").write_text("No heading here, and nothing but plums in it, plums and plums again.")
    assert run("status") == (1, f"No index at {tmp_path / 'bank'}. Run 'index' first.\n")
    code, out = run("index", str(root), "--dry-run")
    assert code == 1 and out.startswith("2 added")
    code, out = run("index", str(root))
    assert code == 0 and out.startswith("2 added, 0 modified, 0 unchanged, 0 error, 0 removed; ")
    assert run("index", str(root), "--dry-run") == (0, "0 added, 0 modified, 2 unchanged, 0 error, 0 removed; 0 chunks written\n")
    code, out = run("search", "plums", "-k", "1", "--output", "json")
    hit = json.loads(out)[0]
    assert hit["file_path"].endswith("b.md") and hit["score"] == 1.0 and "plums" in hit["content"] and "bar" not in hit
    code, out = run("search", "pears spoken", "-k", "2", "-C")
    assert "a.md § Alpha" in out and "█" in out and "(with 1 before and after)" in out
    code, out = run("window", str(hit["id"]), "--max-chars", "10")
    assert out == "No heading\n"
    stats = json.loads(run("status", "--output", "json")[1])
    assert stats["documents"] == 2 and stats["index_bytes"] > 0 and "documents" in run("status")[1]
    code, out = run("chunks", str(root / "b.md"))
    assert out.startswith("[0] (no heading) (0–")
    rows = json.loads(run("savings", "--output", "json")[1])
    assert next(r for r in rows if r["source"] is None)["searches"] == 2
    assert "2 searches since" in run("savings")[1] and run("savings", "--history", "1")[1].count("\n") >= 2
    assert len(json.loads(run("savings", "--history", "5", "--output", "json")[1])) == 2


def test_a_passing_index(spark):
    """An index for a test: it works as any, in a folder of the session's own."""
    bank = Bank.passing(spark, EngineConfig(embedding_dim=64), Shared(HashEmbedder))
    docs = spark.createDataFrame([("a.md", "# A\n\nplums"), ("b.md", None)], "path string, content string")
    assert bank.index_documents(docs).counts == {"added": 2}
    assert bank.search(["plums"], 3).count() == 1 and bank.stats()["empty_documents"] == 1


def test_a_shared_embedder_is_made_once():
    made = []

    def make():
        made.append(1)
        return HashEmbedder()

    one, two = Shared(make), Shared(make)
    assert np.array_equal(one.encode(["a b"]), HashEmbedder().encode(["a b"])) and np.array_equal(two.encode(["c"]), HashEmbedder().encode(["c"]))
    assert made == [1]
