"""Source trees and JSON lists as data sources of Spark: tasks list, read and write; a list appears whole or not at all.

``spark.read.format("source_tree")`` and ``df.write.format("json_list")`` after ``register(spark)``. Paths are in a folder
that the driver and all executors see.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

from pyspark import TaskContext
from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

# Folders whose files are no sources of a repository.
SKIP_DIRS = (".git", ".venv", "venv", "env", "__pycache__", "node_modules", ".mypy_cache", ".pytest_cache", ".ruff_cache", "build", "dist", ".eggs", ".tox")
SUFFIXES = (".py", ".pyi")
FILES = "repo_id string, path string, source string"
#: Partitions of a tree, if it has as many folders.
PARTITIONS = 256


@dataclass(frozen=True)
class Folder:
    """A folder relative to the root, with all that is below it or with its own files alone."""

    path: str
    deep: bool


class Folders(InputPartition):
    def __init__(self, folders: list[Folder]):
        super().__init__(folders)


def _below(folder: str) -> list[str]:
    """Names of the folders in a folder, in order; links are not followed."""
    with os.scandir(folder) as found:
        return sorted(e.name for e in found if e.is_dir(follow_symlinks=False) and e.name not in SKIP_DIRS)


def split_tree(root: str, wanted: int) -> list[Folder]:
    """Folders that hold every file of a tree once: opened level by level until there are ``wanted`` of them to deal."""
    done: list[Folder] = []
    level = [""]
    while level and len(done) + len(level) < wanted:
        done += [Folder(path, False) for path in level]
        level = [os.path.join(path, name) for path in level for name in _below(os.path.join(root, path))]
    return done + [Folder(path, True) for path in level]


class TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"]
        self.repo_id = options.get("repo_id", "repo")
        self.suffixes = tuple(options["suffixes"].split(",")) if "suffixes" in options else SUFFIXES
        self.trees = options.get("trees", "false").lower() == "true"
        self.wanted = int(options.get("partitions", PARTITIONS))

    def partitions(self) -> list[Folders]:
        if not os.path.isdir(self.root):
            raise FileNotFoundError(f"no such folder: {self.root}")
        folders = split_tree(self.root, self.wanted)
        return [Folders(folders[i :: self.wanted]) for i in range(min(self.wanted, len(folders)))]

    def _names(self, folder: Folder) -> Iterator[str]:
        for at, below, names in os.walk(os.path.join(self.root, folder.path)):
            below[:] = sorted(d for d in below if d not in SKIP_DIRS) if folder.deep else []
            for name in sorted(names):
                if name.endswith(self.suffixes):
                    yield Path(at, name).relative_to(self.root).as_posix()

    def read(self, partition: Folders) -> Iterator[tuple]:
        for folder in partition.value:
            for path in self._names(folder):
                try:
                    source = Path(self.root, path).read_text(encoding="utf-8", errors="replace")
                except OSError:
                    source = None
                if not self.trees:
                    yield self.repo_id, path, source
                elif "/" in path:
                    yield *path.split("/", 1), source


class SourceTree(DataSource):
    """FILES of a tree: repo_id, path, source. Paths are relative to the tree and bytes that are not UTF-8 are replaced.

    Line ends are ``\\n``; a file that can't be read has a null source; a tree without files has no rows. Options: path;
    repo_id (``repo``); suffixes, by commas (``.py,.pyi``); trees (``true``: each folder of path is a repository, named
    as the folder); partitions. Tasks list the folders that they are dealt, so that the driver lists the top ones alone.
    """

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return FILES

    def reader(self, schema: StructType) -> TreeReader:
        return TreeReader(dict(self.options))


@dataclass
class Part(WriterCommitMessage):
    partition: int
    file: str
    rows: int


class ListWriter(DataSourceWriter):
    def __init__(self, path: str, head: str, tail: str):
        self.path, self.head, self.tail = path, head, tail
        self.parts = f"{path}.parts-{uuid.uuid4().hex}"
        # tasks do not make it, so that a late attempt can't bring it back
        os.makedirs(self.parts)

    def write(self, iterator: Iterator[Row]) -> Part:
        task = TaskContext.get()
        file = os.path.join(self.parts, f"{task.partitionId()}-{task.taskAttemptId()}")
        rows = 0
        with open(file, "w", encoding="utf-8") as out:
            for row in iterator:
                out.write((",\n " if rows else "\n ") + row[0])
                rows += 1
        return Part(task.partitionId(), file, rows)

    def commit(self, messages: list[Part | None]) -> None:
        whole = os.path.join(self.parts, "whole")
        with open(whole, "wb") as out:
            out.write(f"{self.head}[".encode())
            comma = b""
            for part in sorted((m for m in messages if m is not None and m.rows), key=lambda m: m.partition):
                out.write(comma)
                with open(part.file, "rb") as rows:
                    shutil.copyfileobj(rows, out)
                comma = b","
            out.write(f"\n]{self.tail}".encode())
        os.replace(whole, self.path)
        shutil.rmtree(self.parts)

    def abort(self, messages: list[Part | None]) -> None:
        shutil.rmtree(self.parts, ignore_errors=True)


class JsonList(DataSource):
    """A sink: rows of one string column, each a JSON value, become one JSON list in a file, in the order of partitions.

    Tasks write parts next to the file; the commit joins those of successful attempts and renames the whole over the file.
    A job that fails leaves the file as it was and no part. Options: path; head and tail, the text around the list.
    """

    @classmethod
    def name(cls) -> str:
        return "json_list"

    def writer(self, schema: StructType, overwrite: bool) -> ListWriter:
        if [f.dataType.simpleString() for f in schema.fields] != ["string"]:
            raise ValueError("json_list takes one column of strings")
        path = self.options["path"]
        if not overwrite and os.path.exists(path):
            raise FileExistsError(path)
        return ListWriter(path, self.options.get("head", ""), self.options.get("tail", "\n"))


def register(spark: SparkSession) -> None:
    """Make both formats known to a session, once."""
    if not getattr(spark, "_heddle_formats", False):
        spark.dataSource.register(SourceTree)
        spark.dataSource.register(JsonList)
        spark._heddle_formats = True
