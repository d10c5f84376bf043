"""Markdown files and in-memory documents as DataFrames."""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from plumbline.functions.text import normalise_path, title

FOUND = "path string, content string, file_size long, modified long, error string"
#: Folders that a scan is split into at least, if there are as many; splits of the files that lie in one folder.
FOLDERS, SPLITS = 64, 4
#: Rows and bytes of a batch.
BATCH_ROWS, BATCH_BYTES = 256, 16 << 20


def file_system(path: str) -> tuple[arrow_fs.FileSystem, str]:
    """What opens a path, and the path's name there: a plain path is a local one."""
    return arrow_fs.FileSystem.from_uri(path) if "://" in path else (arrow_fs.LocalFileSystem(), path)


def is_markdown_name(name: str) -> bool:
    return name.endswith(".md") and name != ".md"


def listed(system: arrow_fs.FileSystem, folder: str) -> tuple[list[arrow_fs.FileInfo], list[str]]:
    """The Markdown files right in a folder, whatever their names, and its folders. Links are not followed; what can't be read is empty."""
    try:
        found = sorted(system.get_file_info(arrow_fs.FileSelector(folder)), key=lambda i: i.path)
    except OSError:
        return [], []
    local = isinstance(system, arrow_fs.LocalFileSystem)
    plain = [i for i in found if not (local and os.path.islink(i.path))]
    return [i for i in plain if i.type == arrow_fs.FileType.File and is_markdown_name(i.base_name)], [i.path for i in plain if i.type == arrow_fs.FileType.Directory]


@dataclass
class Folder(InputPartition):
    """A folder to walk, or one split of the files right in it."""

    path: str
    whole: bool
    split: int = 0


class MarkdownReader(DataSourceReader):
    """Scans folders in parallel: the driver looks only as deep as it takes to find enough of them."""

    def __init__(self, options: dict[str, str]):
        self.root = options["path"]
        self.recursive = options.get("recursive", "true") == "true"
        self.content = options.get("content", "true") == "true"
        self.most = int(options.get("max_size", 1 << 62))

    def partitions(self) -> list[Folder]:
        system, root = file_system(self.root)
        level, above = [root], []
        while level and len(level) < FOLDERS and self.recursive:
            above += level
            level = [f for folder in level for f in listed(system, folder)[1]]
        if not self.recursive:
            level, above = [], [root]
        return [Folder(f, False, i) for f in above for i in range(SPLITS)] + [Folder(f, True) for f in level]

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        system, root = file_system(self.root)
        info = system.get_file_info(root)
        if info.type == arrow_fs.FileType.File:  # a file is itself
            infos = iter([info] if partition.split == 0 else [])
        elif partition.whole:
            infos = self._walked(system, partition.path)
        else:
            infos = (i for i in listed(system, partition.path)[0] if crc32(i.base_name.encode("utf-8", "surrogateescape")) % SPLITS == partition.split)
        rows, size = [], 0
        for i in infos:
            rows.append(self._row(system, i, self.root[: len(self.root) - len(root)] if "://" in self.root else ""))
            size += len(rows[-1][1] or "")
            if len(rows) == BATCH_ROWS or size >= BATCH_BYTES:
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)

    def _walked(self, system: arrow_fs.FileSystem, folder: str) -> Iterator[arrow_fs.FileInfo]:
        left = [folder]
        while left:
            files, folders = listed(system, left.pop())
            yield from files
            left += folders

    def _row(self, system: arrow_fs.FileSystem, info: arrow_fs.FileInfo, scheme: str) -> tuple:
        text, size, error = None, info.size, None
        if self.content:
            try:
                text, size = read_text(system, info.path, self.most)
            except (OSError, ValueError) as e:
                size, error = None, str(e)
        return scheme + info.path, text, size, info.mtime_ns, error


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["path", "content", "file_size", "modified", "error"])


def read_text(system: arrow_fs.FileSystem, path: str, most: int) -> tuple[str, int]:
    """A file's text and size; one that is too large, missing or not UTF-8 raises an error."""
    size = system.get_file_info(path).size
    if size is not None and size > most:
        raise ValueError(f"file too large: {size} bytes (max {most})")
    with system.open_input_stream(path) as f:
        data = f.read()
    return data.decode(), len(data)


class MarkdownFiles(DataSource):
    """``spark.read.format("markdown_files").load(folder)``: a row per Markdown file; one that can't be read has an ``error`` instead of a text.

    Options: ``recursive`` (true), ``content`` (true; false lists names, sizes and times alone), ``max_size`` in bytes.
    """

    @classmethod
    def name(cls) -> str:
        return "markdown_files"

    def schema(self) -> str:
        return FOUND

    def reader(self, schema) -> MarkdownReader:
        return MarkdownReader(dict(self.options))


def scan(spark: SparkSession, root: str, recursive: bool = True, max_size: int = 1 << 62, content: bool = True) -> DataFrame:
    """The Markdown files below a folder of any file system that Arrow opens, read where the folders are dealt to."""
    spark.dataSource.register(MarkdownFiles)
    options = {"recursive": str(recursive).lower(), "content": str(content).lower(), "max_size": str(max_size)}
    return spark.read.format("markdown_files").options(**options).load(root)


def exists(path: str) -> bool:
    system, name = file_system(path)
    return system.get_file_info(name).type != arrow_fs.FileType.NotFound


def size_on_disk(path: str) -> int:
    """A file's bytes; 0 if there is none."""
    system, name = file_system(path)
    info = system.get_file_info(name)
    return info.size or 0 if info.type == arrow_fs.FileType.File else 0


def missing(paths: DataFrame) -> DataFrame:
    """Those of ``paths`` (path) that are there no more."""
    return paths.select("path").mapInPandas(lambda frames: (f[[not exists(p) for p in f["path"]]] for f in frames), "path string")


def read_files(spark: SparkSession, paths: list[str] | DataFrame, max_size: int) -> DataFrame:
    """A row per named file; one that is too large, missing or not UTF-8 has an ``error`` instead of a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for path in batch.column("path").to_pylist():
                try:
                    system, name = file_system(path)
                    rows.append((path, *read_text(system, name, max_size), None, None))
                except (OSError, ValueError) as e:
                    rows.append((path, None, None, None, str(e)))
                size += len(rows[-1][1] or "")
                if size >= BATCH_BYTES:
                    yield _batch(rows)
                    rows, size = [], 0
            if rows:
                yield _batch(rows)

    named = paths if isinstance(paths, DataFrame) else spark.createDataFrame([(p,) for p in paths], "path string")
    return described(named.select("path").mapInArrow(run, FOUND))


def described(docs: DataFrame) -> DataFrame:
    """Adds normalised path, hash and title where the caller gave none."""
    given = lambda c: F.col(c) if c in docs.columns else F.lit(None).cast("string")
    size = F.coalesce(F.col("file_size"), F.octet_length("content").cast("long")) if "file_size" in docs.columns else F.octet_length("content").cast("long")
    return docs.select(
        normalise_path(F.col("path")).alias("path"), "content", F.coalesce(given("content_hash"), F.sha2("content", 256)).alias("content_hash"), size.alias("file_size"),
        F.coalesce(given("title"), title(F.col("content"))).alias("title"), given("error").alias("error"),
    )
