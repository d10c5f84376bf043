"""What editors and agents call: tools that answer in text, hooks that never fail, and a log written beside the search."""

from __future__ import annotations

import json
import logging
import os
import posixpath
import sys
import threading
import uuid
from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor

from pyspark.sql import functions as F

from plumbline.errors import EngineError, PayloadError
from plumbline.plans.bank import Bank, BankSet, Report, format_results, log_row
from plumbline.sources import files

logger = logging.getLogger(__name__)


# --- payloads and hooks


def payload_field(payload: str, path: str) -> tuple[str, str | None]:
    """The text at a dotted path of a JSON object, and the object's ``cwd`` if it is a text."""
    try:
        root = json.loads(payload)
    except ValueError as e:
        raise PayloadError(f"the payload is not valid JSON: {e}") from e
    if not isinstance(root, dict):
        raise PayloadError("the payload is not an object")
    value: object = root
    for name in path.split("."):
        value = value.get(name) if isinstance(value, dict) else None
    if not isinstance(value, str):
        raise PayloadError(f"the payload has no {path}")
    cwd = root.get("cwd")
    return value, cwd if isinstance(cwd, str) else None


def index_edited(bank: Bank, payload: str) -> Report | None:
    """Re-indexes the file a tool has edited, if it is Markdown below a root that the index knows; else None.

    A file known by a relative path is read below the payload's ``cwd`` and keeps that path.
    """
    target, cwd = payload_field(payload, "tool_input.file_path")
    if not files.is_markdown_name(posixpath.basename(target.replace("\\", "/"))):
        return None
    known = bank.known_form(target, cwd)
    if known is None:
        return None
    at = known if known.startswith("/") else os.path.join(cwd or ".", known)
    return bank.apply(files.read_files(bank.spark, [at], bank.config.max_file_size).withColumn("path", F.lit(known)))


def search_prompt(bank: Bank, payload: str) -> str | None:
    prompt, _ = payload_field(payload, "prompt")
    return bank.hook_search(prompt)


def passes_gate(kind: str, payload: str) -> bool:
    """Whether a hook has anything to do, as far as the payload tells: asked before a session is started. Broken payloads pass, to be reported."""
    try:
        value, _ = payload_field(payload, "prompt" if kind == "search" else "tool_input.file_path")
    except PayloadError:
        return True
    return 5 <= len(value.split()) <= 150 if kind == "search" else files.is_markdown_name(posixpath.basename(value.replace("\\", "/")))


def run_hook(kind: str, payload: str, bank: Callable[[], Bank], show: Callable[[str], None] = print) -> int:
    """The hook ``index`` or ``search`` on a payload. Always 0: whatever fails is told to stderr only."""
    try:
        if kind == "index":
            index_edited(bank(), payload)
        elif block := search_prompt(bank(), payload):
            show(block)
    except Exception as e:  # noqa: BLE001  a hook must not stop the editor
        print(f"hook {kind}: {e}", file=sys.stderr)
    return 0


# --- log


class LogWriter:
    """Appends to the log of searches in a thread of its own; a failure warns and fails nothing.

    Searches that come while one batch is being written go into the next one together, so many searches make few files.
    """

    def __init__(self, bank: Bank):
        self.bank, self._pool = bank, ThreadPoolExecutor(1, "search-log")
        self._waiting: list[tuple] = []
        self._lock, self._name, self._batches = threading.Lock(), uuid.uuid4().hex, 0

    def _write(self) -> None:
        with self._lock:
            rows, self._waiting = self._waiting, []
        if not rows:
            return  # an earlier batch took them along
        self._batches += 1
        for left in (1, 0):
            try:
                self.bank.append_logs(f"{self._name}-{self._batches}", rows)
                return
            except Exception as e:  # noqa: BLE001  the searches have succeeded
                if not left:
                    logger.warning("%d searches were not logged: %s", len(rows), e)

    def append(self, source: str, query: str, top_k: int, hits: list[dict]) -> Future:
        """Logs a search: the bytes of its hits, and those of the files it spared, as they are on disk; missing files count nothing."""
        read = sum(files.size_on_disk(p) for p in {h["file_path"] for h in hits})
        with self._lock:
            self._waiting.append(log_row(source, query, top_k, sum(len(h["content"].encode()) for h in hits), read))
        return self._pool.submit(self._write)

    def close(self) -> None:
        """Waits for what is still being written."""
        self._pool.shutdown(wait=True)


# --- tools


class Tools:
    """``search``, ``index`` and ``status`` as an agent's tools: text in answer, ``Error: …`` where they fail."""

    def __init__(self, banks: BankSet):
        self.banks, self.primary = banks, banks.banks[0][1]
        self.log = LogWriter(self.primary)

    def search(self, query: str, top_k: int | None = None) -> str:
        k = min(5 if top_k is None else top_k, self.primary.config.max_top_k)
        try:
            hits = [r.asDict() for r in self.banks.search([query], k).orderBy("rank").collect()]
        except Exception as e:  # noqa: BLE001
            return f"Error: {e}"
        self.log.append("mcp", query, k, hits)
        return format_results(hits)

    def index(self, path: str, recursive: bool = True, force: bool = False, progress: Callable[[float], None] = lambda _: None) -> str:
        if not os.path.exists(path):
            return f"Error: path not found: {path}"
        try:
            report = self.primary.index_path(path, recursive, force, progress=progress)
        except Exception as e:  # noqa: BLE001
            return f"Error: {e}"
        lines = [f"  - {r['path']}: {r['error']}" for r in report.errors.orderBy("path").toLocalIterator()] if report.errors else []
        return "\n".join([report.summary(), "", "Errors:", *lines]) if lines else report.summary()

    def status(self) -> str:
        try:
            s = self.primary.stats()
        except (EngineError, OSError) as e:
            return f"Error: {e}"
        rows = [("Documents", s["documents"]), ("Chunks", s["chunks"]), ("Database size", f"{s['index_bytes']} bytes"), ("Model", self.primary.config.model_id)]
        return "\n".join(f"{name}: {value}" for name, value in [*rows, ("Embedding dim", s["embedding_dim"]), ("Last indexed", s["last_indexed_at"] or "never")])
