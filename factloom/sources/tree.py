"""Report trees as a Python data source: ``path, category, body`` of many small JSON files (A1, A3, B1).

Reading plans its partitions from a listing of the tree, files together up to
``PARTITION_BYTES``; conditions on ``category`` are pushed into the listing, so that
only directories of wanted categories are walked and only their files are read.
Writing puts each row's body under its path in a folder beside the tree; the commit
moves it into place, so a tree appears whole or not at all, and a task that is tried
again writes the same files again. Paths that lead out of the tree are an error.

``reports.documents`` reads trees of any store that Spark knows; this source needs one
that Arrow's file systems know.
"""

from __future__ import annotations

import posixpath
import re
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    In,
    InputPartition,
    WriterCommitMessage,
)

from factloom.operators.adapters import CATEGORIES, EXCLUDED

SCHEMA = "path string, category string, body string"
#: Bytes and files that a partition holds; a file counts as ``FILE_BYTES`` more.
PARTITION_BYTES, FILE_BYTES = 32 << 20, 64 << 10


def category(path: str) -> str | None:
    """The category of a path below the root; null if excluded or of none."""
    slashed = "/" + path
    return None if EXCLUDED in slashed else next((name for name, part in CATEGORIES if part in slashed), None)


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    fs, root = pafs.FileSystem.from_uri(path) if re.match(r"[a-z0-9]+:", path) else (pafs.LocalFileSystem(), path)
    return fs, root.rstrip("/")


class _Files(InputPartition):
    def __init__(self, paths: list[str]) -> None:
        super().__init__(paths)
        self.paths = paths


class TreeReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root = options["path"]
        self.wanted: set[str | None] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("category",):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted = values if self.wanted is None else self.wanted & values
            else:
                yield f

    def _listed(self, fs: pafs.FileSystem, root: str, folder: str) -> Iterator[pafs.FileInfo]:
        """Wanted files below a folder; folders that can't hold any aren't walked."""
        for info in sorted(fs.get_file_info(pafs.FileSelector(folder)), key=lambda i: i.path):
            inside = info.path[len(root) + 1 :]
            if info.type == pafs.FileType.Directory:
                if self._may_hold(inside + "/"):
                    yield from self._listed(fs, root, info.path)
            elif inside.endswith(".json") and (self.wanted is None or category(inside) in self.wanted):
                yield info

    def _may_hold(self, folder: str) -> bool:
        """Whether files below a folder may be wanted: the part that decides may still come if it stands earlier in the order."""
        if self.wanted is None:
            return True
        if EXCLUDED in "/" + folder:
            return None in self.wanted
        first = next((i for i, (_, part) in enumerate(CATEGORIES) if part in "/" + folder), len(CATEGORIES))
        return None in self.wanted or any(name in self.wanted for name, _ in CATEGORIES[: first + 1])

    def partitions(self) -> list[InputPartition]:
        fs, root = _open(self.root)
        out: list[list[str]] = [[]]
        size = 0
        for info in self._listed(fs, root, root):
            cost = (info.size or 0) + FILE_BYTES
            if out[-1] and size + cost > PARTITION_BYTES:
                out.append([])
                size = 0
            out[-1].append(info.path[len(root) + 1 :])
            size += cost
        return [_Files(paths) for paths in out]

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        fs, root = _open(self.root)
        names = ["path", "category", "body"]
        rows: list[tuple[str, str | None, str]] = []
        size = 0
        for path in partition.paths:
            with fs.open_input_stream(f"{root}/{path}", compression=None) as f:
                body = f.read().decode("utf-8", "replace")
            rows.append((path, category(path), body))
            size += len(body)
            if size > 1 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], names=names)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], names=names)


class TreeWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool) -> None:
        self.root, self.overwrite = options["path"].rstrip("/"), overwrite
        self.aside = f"{self.root}.writing-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, aside = _open(self.aside)
        known: set[str] = set()
        for batch in iterator:
            at = {n: batch.schema.get_field_index(n) for n in ("path", "body")}
            for path, body in zip(batch.column(at["path"]).to_pylist(), batch.column(at["body"]).to_pylist(), strict=True):
                clean = posixpath.normpath(path or "..")
                if clean.startswith(("/", "..")) or clean == ".":
                    raise ValueError(f"not a path below the tree: {path!r}")
                folder = posixpath.dirname(f"{aside}/{clean}")
                if folder not in known:
                    fs.create_dir(folder, recursive=True)
                    known.add(folder)
                with fs.open_output_stream(f"{aside}/{clean}", compression=None) as out:
                    out.write((body or "").encode())
        return WriterCommitMessage()

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, root = _open(self.root)
        _, aside = _open(self.aside)
        fs.create_dir(aside, recursive=True)  # also without rows
        if fs.get_file_info(root).type != pafs.FileType.NotFound:
            if not self.overwrite:
                fs.delete_dir(aside)
                raise FileExistsError(f"there is a tree at {self.root}")
            fs.delete_dir(root)
        fs.move(aside, root)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, aside = _open(self.aside)
        if fs.get_file_info(aside).type != pafs.FileType.NotFound:
            fs.delete_dir(aside)


class TreeSource(DataSource):
    """``spark.read.format("report_tree")`` and ``df.write.format("report_tree")``."""

    @classmethod
    def name(cls) -> str:
        return "report_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return TreeReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return TreeWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TreeSource)


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """``path, category, body`` of the JSON files of a tree."""
    register(spark)
    return spark.read.format("report_tree").load(root)


def write_tree(docs: DataFrame, root: str, overwrite: bool = False) -> None:
    """Each ``body`` as a file under its ``path`` below the root."""
    register(docs.sparkSession)
    docs.select("path", "body").write.format("report_tree").mode("overwrite" if overwrite else "append").save(root)
