"""An index of documents as Parquet tables, and several of them as one.

Tables are dealt into parts by the hash of a document's path, each part of a table a folder per generation: ``part=…/gen=…``.
A change reads and rewrites the parts that its documents fall into and leaves the others as they are. It takes effect
by one small file, the next commit, which names the generation of every part and is created only if it isn't there: of two
writers one is refused, readers see the old state or the new, and what a failed run has written counts for nothing.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark import InheritableThread
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.config import EngineConfig
from plumbline.errors import Conflict, DimensionMismatch, DuplicatePath, ModelMismatch, NotFound, StorageError
from plumbline.functions.text import normalise_path, under
from plumbline.operators import analytics, diff, gates, postings, retrieval, windows
from plumbline.operators.chunking import chunked
from plumbline.operators.postings import INDEX, TextIndex
from plumbline.plans.embedding import Embedder, HashEmbedder, with_embeddings
from plumbline.sources import files
from plumbline.storage import delete, discard, scratch, stored

SCHEMA_VERSION = "3"
TABLES = {
    "documents": "id long, path string, content_hash string, title string, indexed_at string, file_size long",
    "chunks": "id long, document_id long, content string, heading_context string, start_byte long, end_byte long, chunk_index long, embedding array<float>",
}
LOG = "id long, ts long, source string, query string, top_k long, result_bytes long, baseline_bytes long"
#: Parts of a new index.
PARTS = 16
#: Seconds between looks at how far a write has come.
POLL_SECONDS = 0.1


def now() -> str:
    return time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())


@dataclass
class Report:
    """How many files each outcome had, what was written, and a table ``path, error`` of those that failed."""

    counts: dict[str, int]
    removed: int = 0
    chunks: int = 0
    bytes: int = 0
    errors: DataFrame | None = None

    def summary(self) -> str:
        parts = [f"{self.counts.get(k, 0)} {k}" for k in ("added", "modified", "unchanged", "error")]
        return f"{', '.join(parts)}, {self.removed} removed; {self.chunks} chunks written"


class Bank:
    """One index. ``root`` may be any path that Spark can write."""

    def __init__(self, spark: SparkSession, root: str, config: EngineConfig | None = None, embedder: Embedder | None = None, parts: int = PARTS):
        self.spark, self.root, self.config = spark, root.rstrip("/"), config or EngineConfig()
        self.embedder = embedder or HashEmbedder()
        if not self._commits():
            fresh = {"schema_version": SCHEMA_VERSION, "embedding_dim": self.config.embedding_dim, "model_id": self.config.model_id, "parts": parts, "next_id": 0}
            try:
                self._commit(0, fresh | {"tables": {n: {} for n in (*TABLES, "words")}})
            except Conflict:  # another has just made it
                pass
        meta = self.metadata()
        if int(meta["schema_version"]) > int(SCHEMA_VERSION):
            raise StorageError(f"the index has schema {meta['schema_version']}, newer than {SCHEMA_VERSION}")
        if int(meta["embedding_dim"]) != self.config.embedding_dim:
            raise DimensionMismatch(f"the index has {meta['embedding_dim']} dimensions, not {self.config.embedding_dim}")
        if meta["model_id"] != self.config.model_id:
            raise ModelMismatch(f"the index was made with {meta['model_id']}, not {self.config.model_id}")
        if meta["schema_version"] != SCHEMA_VERSION:
            self._migrate()

    @classmethod
    def passing(cls, spark: SparkSession, config: EngineConfig | None = None, embedder: Embedder | None = None) -> Bank:
        """An index in the session's shared folder, for tests and trials."""
        return cls(spark, scratch(spark, "bank"), config, embedder)

    # --- storage

    def _fs(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _commits(self) -> list[int]:
        """The numbers of the commits that are there, ascending."""
        fs = self._fs()
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(self._path("commits"))) if fs.exists(self._path("commits")) else []

    def version(self) -> int:
        """What names the state that readers see now."""
        return self._commits()[-1]

    def _state(self, version: int | None = None) -> dict:
        at = self._path(f"commits/{self.version() if version is None else version:020d}")
        stream = self._fs().open(at)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def metadata(self) -> dict[str, str]:
        return {k: str(v) for k, v in self._state().items() if k in ("schema_version", "embedding_dim", "model_id")}

    def _commit(self, version: int, state: dict) -> None:
        """Puts a state into effect as commit ``version``; refused if there is one of that number."""
        fs, at = self._fs(), self._path(f"commits/{version:020d}")
        if fs.exists(at):
            raise Conflict("another writer has changed the index; try again")
        fs.mkdirs(self._path("commits"))
        try:
            stream = fs.create(at, False)  # fails if another writer has made it since
        except Exception as e:
            raise Conflict("another writer has changed the index; try again") from e
        stream.write(bytearray(json.dumps(state).encode()))
        stream.close()

    @staticmethod
    def _current(generations: dict[str, str]) -> Column:
        """Whether a row's folder belongs to the state: decided by its path, before a file is read."""
        if not generations:
            return F.lit(False)
        known = F.create_map(*(F.lit(x) for part, gen in generations.items() for x in (int(part), gen)))
        return F.col("part").isin([int(p) for p in generations]) & (known[F.col("part")] == F.col("gen"))

    def _stored(self, name: str, schema: str, state: dict) -> DataFrame:
        self._fs().mkdirs(self._path(name))
        rows = self.spark.read.schema(f"{schema}, part int, gen string").parquet(f"{self.root}/{name}")
        return rows.where(self._current(state["tables"].get(name, {}))).drop("gen")

    def table(self, name: str) -> DataFrame:
        return self._stored(name, TABLES[name], self._state()).drop("part")

    def index(self) -> TextIndex:
        """The words of all chunks."""
        return TextIndex.of(self._stored("words", INDEX, self._state()).drop("part"))

    def _part(self, path: Column, state: dict) -> Column:
        return F.pmod(F.xxhash64(path), F.lit(state["parts"])).cast("int")

    def _write(self, name: str, rows: DataFrame, parts: list[int], gen: str, state: dict) -> None:
        """Makes ``rows`` (with ``part``) the new content of ``parts`` of a table, for the commit that will hold ``state``."""
        by = ["part", "gen", *(["bucket"] if name == "words" else [])]
        writer = rows.withColumn("gen", F.lit(gen)).write.mode("append").partitionBy(*by)
        (writer.option("parquet.block.size", str(postings.ROW_GROUP)) if name == "words" else writer).parquet(f"{self.root}/{name}")
        state["tables"].setdefault(name, {}).update({str(p): gen for p in parts})

    def _write_words(self, parts: list[int], gen: str, version: int, state: dict) -> None:
        """Indexes the words of the chunks in ``parts`` as the commit will hold them."""
        chunks = self._stored("chunks", TABLES["chunks"], state).where(F.col("part").isin(parts))
        words = stored(postings.tokenised(chunks, "part"), "tokens")
        self._write("words", postings.index_rows(words, version), parts, gen, state)
        discard(words)

    def _generation(self, version: int) -> str:
        return f"{version:010d}-{uuid.uuid4().hex[:8]}"

    def _migrate(self) -> None:
        """Brings an older index up to date: the words of all chunks are indexed; the log begins with its first entry."""
        version, state = self.version() + 1, self._state()
        parts = sorted(int(p) for p in state["tables"]["chunks"])
        state["schema_version"] = SCHEMA_VERSION
        if parts:
            self._write_words(parts, self._generation(version), version, state)
        self._commit(version, state)

    def vacuum(self) -> None:
        """Deletes what belongs to earlier states alone."""
        fs, last, state = self._fs(), self.version(), self._state()
        for name, generations in state["tables"].items():
            for part in fs.listStatus(self._path(name)) if fs.exists(self._path(name)) else []:
                number = part.getPath().getName().removeprefix("part=")
                for gen in fs.listStatus(part.getPath()) if part.isDirectory() and number.isdigit() else []:
                    if gen.getPath().getName() != f"gen={generations.get(number)}":
                        fs.delete(gen.getPath(), True)
        for n in self._commits():
            if n != last:
                fs.delete(self._path(f"commits/{n:020d}"), False)

    # --- ingestion

    def _followed(self, write: Callable[[], None], progress: Callable[[float], None]) -> None:
        """Runs ``write`` and tells how many of its tasks are done: from 0.2 to 0.8."""
        sc, group, failed = self.spark.sparkContext, uuid.uuid4().hex, []

        def run() -> None:
            try:
                sc.setJobGroup(group, "writing an index")
                write()
            except BaseException as e:  # noqa: BLE001  raised again by the caller's thread
                failed.append(e)

        thread = InheritableThread(target=run)
        thread.start()
        told, tracker = 0.2, sc.statusTracker()
        while thread.is_alive():
            thread.join(POLL_SECONDS)
            stages = {s for j in tracker.getJobIdsForGroup(group) if (info := tracker.getJobInfo(j)) for s in info.stageIds}
            known = [x for s in stages if (x := tracker.getStageInfo(s))]
            total = sum(x.numTasks for x in known)
            at = 0.2 + 0.6 * sum(x.numCompletedTasks for x in known) / total if total else 0.2
            if at > told:
                progress(told := at)
        if failed:
            raise failed[0]

    def apply(self, incoming: DataFrame, removed: DataFrame | None = None, force: bool = False, dry_run: bool = False, progress: Callable[[float], None] = lambda _: None) -> Report:
        """Brings the index up to ``incoming`` (see ``files.described``) and drops the ``removed`` paths.

        Changed documents are deleted and inserted anew, so their ids change; ids are never given twice. A path given twice counts
        twice in the report; the later text by hash stays. Rows with an error change nothing. What comes in is read once
        and kept in the shared folder, so that documents, chunks and words are made from the same rows.
        """
        progress(0.0)
        begun, state = self.version(), self._state()
        version, gen = begun + 1, self._generation(begun + 1)
        documents, chunks = (self._stored(n, TABLES[n], state) for n in TABLES)
        judged = stored(diff.changes(incoming, documents, force), "judged")
        counts = {r["status"]: r["files"] for r in diff.report(judged).collect()}
        none = self.spark.createDataFrame([], "path string")
        gone = stored((removed.select(normalise_path(F.col("path")).alias("path")).distinct() if removed is not None else none).join(documents, "path", "left_semi"), "gone")
        report = Report(counts, gone.count())
        if counts.get("error"):
            report.errors = judged.where("status = 'error'").select("path", "error")
        if dry_run or not (report.removed or counts.get("added") or counts.get("modified")):
            return report
        last = Window.partitionBy("path").orderBy(F.desc("content_hash"))
        fresh = judged.where(F.col("status").isin("added", "modified")).withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")
        fresh = fresh.withColumns({"id": F.monotonically_increasing_id() + state["next_id"], "indexed_at": F.lit(now()), "part": self._part(F.col("path"), state)})
        fresh = stored(fresh, "fresh")
        dropped = stored(fresh.select("path").unionByName(gone).distinct(), "dropped")
        parts = sorted(r["part"] for r in dropped.select(self._part(F.col("path"), state).alias("part")).distinct().collect())
        touched = F.col("part").isin(parts)
        kept = documents.where(touched).join(dropped, "path", "left_anti")
        kept_chunks = chunks.where(touched).join(kept.select(F.col("id").alias("document_id")), "document_id", "left_semi")
        after = (fresh.agg(F.max("id")).first()[0] or 0) + state["next_id"] + 1
        pieces = stored(chunked(fresh.withColumnRenamed("id", "document_id"), ["document_id", "part"], self.config.max_chunk_bytes, self.config.chunk_overlap_chars).withColumn("id", F.monotonically_increasing_id() + after), "pieces")
        report.bytes, report.chunks = fresh.agg(F.coalesce(F.sum("file_size"), F.lit(0))).first()[0], pieces.count()
        state["next_id"] = (pieces.agg(F.max("id")).first()[0] or after) + 1
        progress(0.2)
        columns = {n: [*(c.split()[0] for c in s.split(", ")), "part"] for n, s in TABLES.items()}
        new = with_embeddings(pieces, "content", self.embedder, self.config.model_id, self.config.embedding_dim)

        def write() -> None:
            self._write("chunks", kept_chunks.select(columns["chunks"]).unionByName(new.select(columns["chunks"])), parts, gen, state)

        self._followed(write, progress)
        self._write("documents", kept.select(columns["documents"]).unionByName(fresh.select(columns["documents"])), parts, gen, state)
        self._write_words(parts, gen, version, state)
        progress(0.9)
        self._commit_or_undo(version, gen, state)
        for done in (gone, fresh, dropped, pieces, *([] if report.errors else [judged])):
            discard(done)
        progress(1.0)
        return report

    def _commit_or_undo(self, version: int, gen: str, state: dict) -> None:
        try:
            self._commit(version, state)
        except Conflict:
            for name, generations in state["tables"].items():
                for part, its in generations.items():
                    if its == gen:
                        delete(self.spark, f"{self.root}/{name}/part={part}/gen={gen}")
            raise

    def index_path(self, root: str, recursive: bool = True, force: bool = False, dry_run: bool = False, progress: Callable[[float], None] = lambda _: None) -> Report:
        """Indexes Markdown files below ``root``; documents under it whose files are gone leave the index, others stay."""
        if not files.exists(root):
            raise NotFound(root)
        incoming = files.described(files.scan(self.spark, root, recursive, self.config.max_file_size))
        at = root.replace("\\", "/").removeprefix("./").rstrip("/")
        known = self.table("documents").where(under(F.col("path"), at) if at not in ("", ".") else F.lit(True))
        return self.apply(incoming, files.missing(known), force, dry_run, progress)

    def index_documents(self, docs: DataFrame, removed: DataFrame | None = None, force: bool = False) -> Report:
        """Indexes documents that are given with their texts (``path, content`` and perhaps ``content_hash, title``), without a size limit."""
        return self.apply(files.described(docs), removed, force)

    def index_diff(self, changed: list[str], removed: list[str], force: bool = False) -> Report:
        """Re-reads the changed files and drops the removed ones."""
        gone = self.spark.createDataFrame([(p,) for p in removed], "path string")
        return self.apply(files.read_files(self.spark, changed, self.config.max_file_size), gone, force)

    # --- single documents

    def _change(self, tables: dict[str, Callable[[DataFrame], DataFrame]], parts: list[int], words: bool = False, **more: int) -> None:
        """Rewrites ``parts`` of tables by functions of their rows, as one commit."""
        begun, state = self.version(), self._state()
        version, gen, before = begun + 1, self._generation(begun + 1), json.loads(json.dumps(state))
        for name, change in tables.items():
            rows = self._stored(name, TABLES[name], before).where(F.col("part").isin(parts))
            self._write(name, change(rows), parts, gen, state)
        if words:
            self._write_words(parts, gen, version, state)
        self._commit_or_undo(version, gen, state | more)

    def _part_of(self, path: str) -> int:
        return self.spark.range(1).select(self._part(F.lit(path), self._state())).first()[0]

    def insert_document(self, path: str, content_hash: str, title: str | None = None, file_size: int = 0) -> int:
        """Adds a document without chunks and gives its id; a path that is there already is an error."""
        if self.table("documents").where(F.col("path") == path).limit(1).count():
            raise DuplicatePath(path)
        new, part = self._state()["next_id"], self._part_of(path)
        row = self.spark.createDataFrame([(new, path, content_hash, title, now(), file_size, part)], TABLES["documents"] + ", part int")
        self._change({"documents": lambda rows: rows.unionByName(row)}, [part], next_id=new + 1)
        return new

    def update_document_hash(self, path: str, content_hash: str, file_size: int | None = None) -> None:
        here = F.col("path") == path
        if not self.table("documents").where(here).limit(1).count():
            raise NotFound(path)
        new = {"content_hash": F.lit(content_hash), "indexed_at": F.lit(now())} | ({} if file_size is None else {"file_size": F.lit(file_size).cast("long")})
        self._change({"documents": lambda rows: rows.withColumns({c: F.when(here, v).otherwise(F.col(c)) for c, v in new.items()})}, [self._part_of(path)])

    def delete_chunks(self, document_id: int) -> int:
        """Takes the chunks of a document out, leaves the document, and gives their number."""
        there = F.col("document_id") == document_id
        found = self._stored("chunks", TABLES["chunks"], self._state()).where(there).groupBy("part").count().collect()
        if found:
            self._change({"chunks": lambda rows: rows.where(~there)}, [r["part"] for r in found], words=True)
        return sum(r["count"] for r in found)

    def known_form(self, target: str, cwd: str | None) -> str | None:
        """The form of ``target`` under which the index knows its folder; None if it lies outside."""
        return gates.under_indexed_root(target, cwd, self.table("documents"))

    # --- search

    def queries(self, texts: list[str]) -> DataFrame:
        rows = self.spark.createDataFrame(list(enumerate(texts)), "query_id long, query string")
        return with_embeddings(rows, "query", self.embedder, self.config.model_id, self.config.embedding_dim, query=True)

    def search_raw(self, queries: DataFrame | list[str], top_k: int = 5) -> DataFrame:
        """``query_id, id, score, mmr_pos, content, heading_context, file_path`` with scores as fused and boosted."""
        queries = self.queries(queries) if isinstance(queries, list) else queries
        chunks = self.table("chunks")
        hits = retrieval.hybrid(chunks, self.index(), queries, top_k, self.config)
        paths = self.table("documents").select(F.col("id").alias("document_id"), F.col("path").alias("file_path"))
        return hits.join(chunks.select("id", "document_id", "content", "heading_context"), "id").join(paths, "document_id").drop("document_id")

    def search(self, queries: DataFrame | list[str], top_k: int = 5) -> DataFrame:
        """The same, the best score of each query being 1."""
        return retrieval.normalised(self.search_raw(queries, top_k))

    def search_limited(self, queries: DataFrame | list[str], top_k: int) -> DataFrame:
        """A tool's search: never more than ``max_top_k`` hits, in the order of the reranking."""
        return self.search(queries, min(top_k, self.config.max_top_k))

    def contexts(self, chunk_ids: list[int], radius: int = 1, most: int = 2000) -> dict[int, str]:
        """The context of each chunk that there is."""
        asked = self.spark.createDataFrame([(i,) for i in chunk_ids], "id long")
        return {r["target_id"]: r["context"] for r in windows.chunk_windows(self.table("chunks"), asked, radius, most).collect()}

    def context(self, chunk_id: int, radius: int = 1, most: int = 2000) -> str:
        found = self.contexts([chunk_id], radius, most)
        if chunk_id not in found:
            raise NotFound(f"no chunk {chunk_id}")
        return found[chunk_id]

    def hook_search(self, prompt: str, least: float = 0.02) -> str | None:
        """The best hit as a quoted block, if the prompt has 5 to 150 words and the raw score reaches ``least``."""
        if not 5 <= len(prompt.split()) <= 150:
            return None
        best = self.search_raw([prompt], 1).first()
        return hook_block(best.asDict()) if best and best["score"] >= least else None

    # --- inspection and log

    def stats(self) -> dict:
        current = [(n, p, g) for n, its in self._state()["tables"].items() for p, g in its.items()]
        places = [self._path(f"{n}/part={p}/gen={g}") for n, p, g in current]
        size = sum(self._fs().getContentSummary(at).getLength() for at in places if self._fs().exists(at))
        return analytics.stats(self.table("documents"), self.table("chunks")).first().asDict() | {"index_bytes": size, "embedding_dim": self.config.embedding_dim}

    def chunks_of(self, path: str) -> DataFrame:
        doc = self.table("documents").where(F.col("path") == path).select(F.col("id").alias("document_id"))
        return self.table("chunks").join(doc, "document_id", "left_semi").orderBy("chunk_index")

    def document_hashes(self) -> DataFrame:
        return self.table("documents").select("path", "content_hash")

    def log(self) -> DataFrame:
        if not self._fs().exists(self._path("log")):
            return self.spark.createDataFrame([], LOG)
        return self.spark.read.schema(LOG + ", batch string").parquet(f"{self.root}/log").drop("batch")

    def append_logs(self, batch: str, rows: list[tuple]) -> None:
        """Adds rows (``LOG``) to the log as one file. A batch that is written again, after a failure, replaces what it left."""
        self.spark.createDataFrame(rows, LOG).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/log/batch={batch}")

    def append_log(self, source: str, query: str, top_k: int, result_bytes: int, baseline_bytes: int, ts: int | None = None) -> None:
        self.append_logs(uuid.uuid4().hex, [log_row(source, query, top_k, result_bytes, baseline_bytes, ts)])


def log_row(source: str, query: str, top_k: int, result_bytes: int, baseline_bytes: int, ts: int | None = None) -> tuple:
    return time.time_ns(), int(time.time()) if ts is None else ts, source, query, top_k, result_bytes, baseline_bytes


def hook_block(hit: dict, most: int = 500) -> str:
    """Where a hit is from and its score, then its text as a quote."""
    text = hit["content"] if len(hit["content"].encode()) <= most else hit["content"][:most] + "…"
    head = f"{hit['file_path']}" + (f" § {hit['heading_context']}" if hit["heading_context"] else "")
    return "\n".join([f"{head} (score: {hit['score']:.2f})", *(f"> {line}" for line in text.splitlines())])


def format_results(hits: list[dict]) -> str:
    """Hits as Markdown."""
    if not hits:
        return "No results found."
    out = []
    for i, h in enumerate(hits, 1):
        section = f"**Section:** {h['heading_context']}\n" if h["heading_context"] else ""
        out.append(f"### Result {i} — score: {h['score']:.3f}\n{section}**File:** {h['file_path']}\n\n{h['content']}\n\n---\n")
    return "\n".join(out)


class BankSet:
    """Several indexes searched as one."""

    def __init__(self) -> None:
        self.banks: list[tuple[str, Bank]] = []

    def mount(self, label: str, bank: Bank) -> None:
        self.banks.append((label, bank))

    def unmount(self, label: str) -> bool:
        """Takes the first index of that label out."""
        for i, (name, _) in enumerate(self.banks):
            if name == label:
                del self.banks[i]
                return True
        return False

    def labels(self) -> list[str]:
        return [name for name, _ in self.banks]

    def search(self, texts: list[str], top_k: int = 5) -> DataFrame:
        return retrieval.merged({name: bank.search_raw(texts, top_k) for name, bank in self.banks}, top_k)
