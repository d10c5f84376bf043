import pytest

from plumbline.config import EngineConfig
from plumbline.errors import DimensionMismatch, NotFound
from plumbline.plans.bank import Bank, BankSet, format_results
from plumbline.streaming.watch import watch

CONFIG = EngineConfig(embedding_dim=64)


def body(word: str) -> str:
    return f"# {word.title()}\n\n" + f"{word} is what this document speaks about, at some length and in plain words. " * 2


def test_index_and_search(spark, tmp_path):
    root = tmp_path / "docs"
    root.mkdir()
    for w in ("alpha", "beta", "gamma"):
        (root / f"{w}.md").write_text(body(w))
    (root / "empty.md").write_text("")
    (root / "bad.md").write_bytes(b"\xff\xfe")
    bank = Bank(spark, str(tmp_path / "bank"), CONFIG)
    report = bank.index_path(str(root))
    assert report.counts == {"added": 4, "error": 1} and report.chunks == 3
    assert bank.index_path(str(root)).counts == {"unchanged": 4, "error": 1}
    (root / "beta.md").write_text(body("delta"))
    (root / "gamma.md").unlink()
    assert bank.index_path(str(root), dry_run=True).removed == 1
    report = bank.index_path(str(root))
    assert report.counts == {"unchanged": 2, "modified": 1, "error": 1} and report.removed == 1
    hits = bank.search(["delta"], 2).orderBy("mmr_pos").collect()
    assert hits[0]["file_path"].endswith("beta.md") and hits[0]["score"] == 1.0
    assert "Delta" in bank.context(hits[0]["id"])
    assert bank.stats()["documents"] == 3 and bank.stats()["empty_documents"] == 1
    assert format_results([]) == "No results found."
    with pytest.raises(NotFound):
        bank.context(10**12)
    with pytest.raises(DimensionMismatch):
        Bank(spark, str(tmp_path / "bank"), EngineConfig(embedding_dim=128))
    bank.append_log("cli", "delta", 2, 10, 100, ts=100)
    assert bank.log().count() == 1
    bank.vacuum()
    assert bank.table("documents").count() == 3


def test_in_memory_documents_and_sets(spark, tmp_path):
    banks = BankSet()
    for name, word in (("cats", "meow"), ("dogs", "bark")):
        bank = Bank(spark, str(tmp_path / name), CONFIG)
        docs = spark.createDataFrame([(f"{name}.pdf", body(word), "hash-1")], "path string, content string, content_hash string")
        assert bank.index_documents(docs).counts == {"added": 1}
        assert bank.index_documents(docs).counts == {"unchanged": 1}
        assert bank.index_documents(docs, force=True).counts == {"modified": 1}
        banks.mount(name, bank)
    best = banks.search(["bark"], 2).orderBy("rank").first()
    assert best["source_db"] == "dogs" and best["score"] == 1.0
    assert banks.unmount("cats") and banks.labels() == ["dogs"]


def test_watch(spark, tmp_path):
    root = tmp_path / "docs"
    root.mkdir()
    (root / "a.md").write_text(body("alpha"))
    bank, seen = Bank(spark, str(tmp_path / "bank"), CONFIG), []
    query = watch(bank, [str(root)], on_report=lambda r: seen.append(r.counts), debounce_ms=100)
    try:
        (root / "b.md").write_text(body("beta"))
        for _ in range(200):
            if any("added" in c for c in seen[1:]):
                break
            query.awaitTermination(1)
    finally:
        query.stop()
    assert bank.table("documents").count() == 2
