"""Directories as a table: a Python data source that lists every entry.

Spark's own file sources leave out names that begin with a dot or an underscore, empty files and all directories.  Here the
driver lists only the first ``split_depth`` levels; each directory at that depth is a partition, walked by its task.
Folders that are pruned by name are never listed.
"""

from __future__ import annotations

import datetime
import json
import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, name string, parent string, depth int, is_dir boolean, size bigint, mtime timestamp, access_denied boolean, content binary"


@dataclass
class Subtree(InputPartition):
    """A directory to walk, or (``deep`` false) one whose own entries alone are listed; '' is the root."""

    directory: str
    deep: bool


class WalkReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"]
        self.split_depth = int(options.get("split_depth", "2"))
        self.content = options.get("content", "false") == "true"
        self.max_bytes = int(options.get("max_bytes", str(10 * 1024 * 1024)))
        self.prune = frozenset(x.lower() for x in json.loads(options.get("prune", "[]")))
        self.with_root = options.get("with_root", "false") == "true"
        self.prune_dot = options.get("prune_dot", "false") == "true"

    def _skips(self, name: str) -> bool:
        return name.lower() in self.prune or (self.prune_dot and name.startswith("."))

    def _list(self, directory: str) -> list[os.DirEntry] | None:
        """None if the directory can't be read; one that is gone has no entries."""
        try:
            with os.scandir(os.path.join(self.root, directory)) as found:
                return sorted(found, key=lambda e: e.name)
        except PermissionError:
            return None
        except OSError:
            return []

    def partitions(self) -> list[Subtree]:
        parts, level = ([] if self.split_depth else [Subtree("", False)]), [""]
        for _ in range(self.split_depth):
            parts += [Subtree(d, False) for d in level]
            level = [f"{d}/{e.name}" if d else e.name for d in level for e in self._list(d) or [] if e.is_dir(follow_symlinks=False) and not self._skips(e.name)]
        return parts + [Subtree(d, True) for d in level]

    def read(self, partition: Subtree) -> Iterator[tuple]:
        todo = [partition.directory]
        if self.with_root and not partition.deep and partition.directory == "" and os.path.isdir(self.root):
            yield "", os.path.basename(os.path.abspath(self.root)), None, 0, True, 0, None, not can_read(self.root), None
        while todo:
            directory = todo.pop()
            for entry in self._list(directory) or []:
                path = f"{directory}/{entry.name}" if directory else entry.name
                is_dir = entry.is_dir(follow_symlinks=False)
                if is_dir and self._skips(entry.name):
                    continue
                try:
                    info = entry.stat(follow_symlinks=False)
                except OSError:
                    continue
                denied, content = False, None
                if is_dir:
                    denied = not os.access(entry.path, os.R_OK | os.X_OK) or not can_read(entry.path)
                    if partition.deep:
                        todo.append(path)
                elif self.content and info.st_size <= self.max_bytes:
                    try:
                        with open(entry.path, "rb") as f:
                            content = f.read()
                    except OSError:
                        denied = True
                mtime = datetime.datetime.fromtimestamp(info.st_mtime, datetime.UTC)
                yield path, entry.name, directory, path.count("/") + 1, is_dir, 0 if is_dir else info.st_size, mtime, denied, content


class WalkSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tree_walk"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WalkReader:  # noqa: ANN001
        return WalkReader(self.options)


def walk(spark: SparkSession, root: str, content: bool = False, prune: list[str] | None = None, prune_dot: bool = False, split_depth: int = 2, with_root: bool = False) -> DataFrame:
    """All entries below ``root``, which every executor must see.

    ``content`` reads files of up to 10 MiB, larger ones are null.  A directory whose listing fails for want of permission is
    marked as denied; ``with_root`` adds the root as a row of its own, whose path is empty, which can be denied too.
    """
    spark.dataSource.register(WalkSource)
    flags = {"content": str(content).lower(), "prune": json.dumps(prune or []), "prune_dot": str(prune_dot).lower(), "split_depth": str(split_depth), "with_root": str(with_root).lower()}
    return spark.read.format("tree_walk").options(**flags).load(root)


def can_read(root: str) -> bool:
    """False only if access is denied; a missing root is found out later."""
    try:
        os.scandir(root).close()
    except PermissionError:
        return False
    except OSError:
        return True
    return True


def ignore_lines(root: str, scope: str = "", name: str = ".gitignore") -> list[str]:
    """The lines of a scope's ignore file, none if it can't be read.  Spark's readers skip files whose names begin with a dot."""
    try:
        with open(os.path.join(root, scope, name), encoding="utf-8-sig", errors="replace") as f:
            return f.read().splitlines()
    except OSError:
        return []
