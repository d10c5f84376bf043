import io
import json
import re

import pytest

from plumbline.config import EngineConfig
from plumbline.errors import Conflict, DuplicatePath, NotFound, PayloadError
from plumbline.functions import render
from plumbline.plans.bank import Bank, BankSet
from plumbline.service import LogWriter, Tools, index_edited, passes_gate, payload_field, run_hook
from plumbline.sources import files
from plumbline.streaming.watch import Watcher, changes, listing

CONFIG = EngineConfig(embedding_dim=64)


def body(word: str) -> str:
    return f"# {word.title()}\n\n" + f"{word} is what this document speaks about, at some length and in plain words. " * 2


def test_payloads():
    assert payload_field('{"tool_input": {"file_path": "a.md"}, "cwd": "/x"}', "tool_input.file_path") == ("a.md", "/x")
    assert payload_field('{"prompt": "p", "cwd": 3}', "prompt") == ("p", None)
    for bad in ("", "[]", "{}", '{"prompt": 1}', '{"prompt": null}'):
        with pytest.raises(PayloadError):
            payload_field(bad, "prompt")


def test_tools_and_hooks(spark, tmp_path, capsys):
    root = tmp_path / "docs"
    root.mkdir()
    (root / "a.md").write_text(body("alpha"))
    (root / "bad.md").write_bytes(b"\xff")
    banks = BankSet()
    bank = Bank(spark, str(tmp_path / "bank"), CONFIG)
    banks.mount("docs", bank)
    tools = Tools(banks)
    assert tools.status().startswith("Documents: 0\nChunks: 0\n") and tools.status().endswith("Last indexed: never")
    assert tools.search("alpha") == "No results found."
    assert tools.index(str(tmp_path / "none")).startswith("Error: path not found")
    told = tools.index(str(root))
    assert told.startswith("1 added") and "Errors:\n  - " in told and "bad.md" in told
    assert "a.md" in tools.search("alpha", 500)
    tools.log.close()
    assert [r["source"] for r in bank.log().orderBy("id").collect()] == ["mcp", "mcp"]
    (root / "a.md").write_text(body("omega"))
    payload = json.dumps({"tool_input": {"file_path": str(root / "a.md")}, "cwd": str(tmp_path)})
    assert index_edited(bank, payload).counts == {"modified": 1}
    assert index_edited(bank, json.dumps({"tool_input": {"file_path": "/elsewhere/a.md"}})) is None
    assert index_edited(bank, json.dumps({"tool_input": {"file_path": str(root / "a.txt")}})) is None
    shown = []
    assert run_hook("search", json.dumps({"prompt": "what does omega speak about in plain words"}), lambda: bank, shown.append) == 0
    assert shown and re.match(r"\S+a\.md( § .*)? \(score: 0\.\d\d\)\n> ", shown[0])
    assert run_hook("search", '{"prompt": "too short"}', lambda: bank, shown.append) == 0 and len(shown) == 1
    assert run_hook("index", "broken", lambda: bank) == 0 and "hook index" in capsys.readouterr().err


def test_gates_need_no_session(monkeypatch, tmp_path):
    """A hook that has nothing to do starts no session."""
    from plumbline import cli

    assert passes_gate("search", '{"prompt": "what does this text speak about"}') and not passes_gate("search", '{"prompt": "yes"}')
    assert passes_gate("index", '{"tool_input": {"file_path": "x/a.md"}}') and not passes_gate("index", '{"tool_input": {"file_path": "x/a.txt"}}')
    assert passes_gate("index", "broken")
    monkeypatch.setattr(cli, "SparkSession", None)
    monkeypatch.setattr("sys.stdin", io.StringIO('{"prompt": "yes"}'))
    assert cli.main(["--db", str(tmp_path), "hook", "search"]) == 0


def test_many_searches_make_few_files(spark, tmp_path):
    """Searches logged while a batch is written share the next one; none is there twice, and sizes are those on disk."""
    bank = Bank(spark, str(tmp_path / "bank"), CONFIG)
    (tmp_path / "a.md").write_text("x" * 1000)
    log = LogWriter(bank)
    hits = [{"file_path": str(tmp_path / "a.md"), "content": "é"}, {"file_path": str(tmp_path / "a.md"), "content": "y"}, {"file_path": "gone.md", "content": "z"}]
    for i in range(1000):
        log.append("cli", f"q{i}", 5, hits)
    log.close()
    rows = bank.log().collect()
    assert sorted(r["query"] for r in rows) == sorted(f"q{i}" for i in range(1000))
    assert {(r["result_bytes"], r["baseline_bytes"]) for r in rows} == {(4, 1000)}
    assert len(list((tmp_path / "bank" / "log").glob("batch=*"))) < 50


def test_documents_one_by_one(spark, tmp_path):
    bank = Bank(spark, str(tmp_path / "bank"), CONFIG)
    first = bank.insert_document("a.md", "h1", "A", 10)
    assert bank.insert_document("b.md", "h2") == first + 1
    with pytest.raises(DuplicatePath):
        bank.insert_document("a.md", "h3")
    bank.update_document_hash("a.md", "h9", 12)
    assert {r["path"]: (r["content_hash"], r["file_size"]) for r in bank.table("documents").collect()} == {"a.md": ("h9", 12), "b.md": ("h2", 0)}
    with pytest.raises(NotFound):
        bank.update_document_hash("c.md", "h")
    docs = spark.createDataFrame([("c.md", body("gamma"))], "path string, content string")
    bank.index_documents(docs)
    doc = bank.table("documents").where("path = 'c.md'").first()["id"]
    assert bank.delete_chunks(doc) == 1 and bank.table("documents").count() == 3 and bank.table("chunks").count() == 0


def test_a_second_writer_is_refused(spark, tmp_path):
    """Of two changes made from one state the later counts for nothing, and what it has written goes."""
    bank = Bank(spark, str(tmp_path / "bank"), CONFIG)
    begun = bank.version()
    other = Bank(spark, str(tmp_path / "bank"), CONFIG)
    other.version = lambda: begun  # it has looked before the first one's commit
    bank.insert_document("a.md", "h")
    with pytest.raises(Conflict):
        other.insert_document("b.md", "h")
    assert [r["path"] for r in bank.table("documents").collect()] == ["a.md"]
    assert len(list((tmp_path / "bank" / "documents").glob("part=*/gen=*"))) == 1


def test_old_schema_is_migrated(spark, tmp_path):
    """An index without words gets those of its chunks, and finds the same as one that had them from the start."""
    bank = Bank(spark, str(tmp_path / "bank"), CONFIG)
    bank.index_documents(spark.createDataFrame([(f"{w}.md", body(w)) for w in ("alpha", "beta", "gamma")], "path string, content string"))
    want = sorted(map(str, bank.search(["beta speaks"], 3).collect()))
    state = bank._state()
    state["schema_version"] = "1"
    del state["tables"]["words"]
    bank._commit(bank.version() + 1, state)
    assert bank.index().spans.count() == 0
    again = Bank(spark, str(tmp_path / "bank"), CONFIG)
    assert again.metadata()["schema_version"] == "3" and again.table("documents").count() == 3
    assert sorted(map(str, again.search(["beta speaks"], 3).collect())) == want


def test_a_change_rewrites_only_its_part(spark, tmp_path):
    """One changed file: one part of each table gets a new generation; ids are never given twice; progress is told."""
    root = tmp_path / "docs"
    root.mkdir()
    for i in range(12):
        (root / f"{i}.md").write_text(body(f"word{i}"))
    bank, told = Bank(spark, str(tmp_path / "bank"), CONFIG, parts=8), []
    bank.index_path(str(root), progress=told.append)
    assert told[0] == 0 and told[-1] == 1 and told == sorted(told) and any(0.2 < x <= 0.8 for x in told)
    before, ids = bank._state(), {r["id"] for r in bank.table("documents").collect()}
    (root / "3.md").write_text(body("changed"))
    (root / "4.md").unlink()
    report = bank.index_diff([str(root / "3.md")], [str(root / "4.md")])
    assert report.counts == {"modified": 1} and report.removed == 1
    after = bank._state()
    parts = {bank._part_of(str(root / f"{i}.md")) for i in (3, 4)}
    for name in ("documents", "chunks", "words"):
        changed = {p for p in range(8) if before["tables"][name].get(str(p)) != after["tables"][name].get(str(p))}
        assert changed == parts
    fresh = {r["id"] for r in bank.table("documents").collect()} - ids
    assert len(fresh) == 1 and min(fresh) > max(ids) and bank.table("documents").count() == 11
    assert bank.search(["changed speaks"], 1).first()["file_path"].endswith("3.md")
    chunks = bank.table("chunks")
    assert bank.index().spans.selectExpr("explode(ids) AS id").join(chunks, "id", "full").where("content IS NULL OR document_id IS NULL").count() == 0
    bank.vacuum()
    assert bank.table("documents").count() == 11 and bank.search(["word5 speaks"], 1).first()["file_path"].endswith("5.md")


def test_files_are_scanned_in_folders(spark, tmp_path, monkeypatch):
    """Hidden, empty and underscored files count, links and other names don't; a file that can't be read is an error row."""
    monkeypatch.setattr(files, "FOLDERS", 3)
    for name, text in {"a.md": "A", ".hidden.md": "h", "_part.md": "p", "empty.md": "", "x/b.md": "é", "x/.y/c.md": "C", "x/.y/z/d.md": "D", "e.MD": "no", ".md": "no", "f.txt": "no"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    (tmp_path / "bad.md").write_bytes(b"\xff")
    (tmp_path / "big.md").write_text("b" * 100)
    (tmp_path / "link.md").symlink_to(tmp_path / "a.md")
    (tmp_path / "linked").symlink_to(tmp_path / "x")
    found = {r["path"]: r for r in files.scan(spark, str(tmp_path), max_size=50).collect()}
    text = {k.removeprefix(str(tmp_path) + "/"): r["content"] for k, r in found.items()}
    assert text == {"a.md": "A", ".hidden.md": "h", "_part.md": "p", "empty.md": "", "x/b.md": "é", "x/.y/c.md": "C", "x/.y/z/d.md": "D", "bad.md": None, "big.md": None}
    assert "too large: 100 bytes (max 50)" in found[str(tmp_path / "big.md")]["error"] and found[str(tmp_path / "bad.md")]["error"]
    assert sorted(r["path"] for r in files.scan(spark, "file://" + str(tmp_path / "x"), content=False).collect()) == sorted("file://" + str(tmp_path / "x" / n) for n in ("b.md", ".y/c.md", ".y/z/d.md"))
    assert [r["content"] for r in files.scan(spark, str(tmp_path / "x" / "b.md")).collect()] == ["é"]
    assert files.scan(spark, str(tmp_path), recursive=False).count() == 6
    named = files.read_files(spark, [str(tmp_path / "a.md"), str(tmp_path / "gone.md")], 50).collect()
    assert [bool(r["error"]) for r in named] == [False, True]


def test_changes_lead_to_their_roots(spark, tmp_path):
    roots = [str(tmp_path / x) for x in ("one", "two")]
    for r in roots:
        (tmp_path / r).mkdir()
    (tmp_path / "one" / "a.md").write_text("x")
    before = spark.createDataFrame(listing(spark, roots).collect(), "root string, path string, modified long, file_size long")
    (tmp_path / "two" / "b.md").write_text("y")
    assert [(r["root"], r["kind"]) for r in changes(before, listing(spark, roots)).collect()] == [(roots[1], "added")]
    (tmp_path / "one" / "a.md").unlink()
    assert sorted(r["kind"] for r in changes(before, listing(spark, roots)).collect()) == ["added", "removed"]


def test_a_watcher_goes_on_where_it_stopped(spark, tmp_path, monkeypatch):
    """Changes made while nothing watched are found by the next watcher, once; a root that fails is tried again."""
    root = tmp_path / "docs"
    root.mkdir()
    for name in ("a", "b", "c"):
        (root / f"{name}.md").write_text(body(name))
    bank, seen = Bank(spark, str(tmp_path / "bank"), CONFIG), []
    first = Watcher(bank, [str(root)], on_report=lambda r: seen.append((r.counts, r.removed)))
    assert first.tick() == {str(root): 3} and first.tick() == {}
    (root / "a.md").write_text(body("changed"))
    (root / "b.md").unlink()
    (root / "d.md").write_text(body("d"))
    second = Watcher(bank, [str(root)], on_report=lambda r: seen.append((r.counts, r.removed)))
    with monkeypatch.context() as m:
        m.setattr(bank, "apply", lambda *_: 1 / 0)
        assert second.tick() == {str(root): 3}
    assert second.tick() == {str(root): 3} and second.tick() == {}
    assert seen == [({"added": 3}, 0), ({"added": 1, "modified": 1}, 1)]
    assert sorted(r["path"][-4:] for r in bank.table("documents").collect()) == ["a.md", "c.md", "d.md"]
    assert len(second._numbers()) == 1


def test_rendering(spark):
    hits = render.shown(spark.createDataFrame([("a.md", "A > B", 0.5, "\n".join("abcdefghij"), "x")], "file_path string, heading_context string, score double, content string, source_db string"))
    hits = [r.asDict() for r in hits.collect()]
    shown = render.results(hits, "q")
    assert "1 found" in shown and "█" * 20 + "░" * 20 + " 0.500" in shown and "h\n… 2 more lines\n" in shown and "[x]" not in shown
    assert "a.md § A > B" in shown and "(with 2 before and after)\nw\n" in render.results(hits, "q", ["w"], 2)
    assert "a.md [y]" in render.results([hits[0], hits[0] | {"source_db": "y", "heading_context": ""}], "q")
    stats = {"documents": 0, "chunks": 0, "total_bytes": 0, "empty_documents": 0, "index_bytes": 1 << 20, "last_indexed_at": None, "embedding_dim": 64}
    told = render.status(stats, "p", "m")
    assert "— a document" in told and "1.0 MB" in told and "never" in told and "⚠" not in told
    assert "⚠" in render.status(stats | {"documents": 2, "empty_documents": 1}, "p", "m")
    schema = "id long, ts long, source string, query string, top_k long, result_bytes long, baseline_bytes long"
    log = spark.createDataFrame([(1, -5, "cli", "q" * 60, 5, 6, 4000), (2, 90000, "other", "r", 2, 34, 6000)], schema)
    assert render.savings(log.limit(0)) == render.history(log.limit(0), 3) == render.NOTHING
    told = render.savings(log)
    assert "2 searches since 1970-01-01 (1 cli); 250.0 times fewer" in told and re.search(r"whole files +2.5K +\$0.01", told) and re.search(r"delivered +10 ", told)
    past = render.history(log, 5).splitlines()
    assert past[0].split() == ["time", "from", "hits", "tokens", "saved", "query"] and len(past) == 3
    assert past[2].split() == ["1970-01-01T00:00:00Z", "cli", "5", "2", "998", "q" * 49 + "…"]


def test_exports():
    import plumbline

    assert all(getattr(plumbline, name) for name in plumbline.__all__) and not hasattr(plumbline, "nothing")


def test_the_entry_needs_no_session():
    """What the driver imports stands before any session."""
    import subprocess
    import sys
    from pathlib import Path

    there = Path(__file__).resolve().parent.parent
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()))"], cwd=there, capture_output=True, text=True, timeout=120, check=False)
    assert done.returncode == 0 and int(done.stdout) > 50, done.stderr
