"""A directory tree as a Spark data source: one partition per directory of a level that has enough of them."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


#: Directories of one level that are enough to deal out, and levels to look for them.
TASKS, DEPTH = 64, 3


def _visible(name: str) -> bool:
    if name.startswith("."):
        return False
    try:
        name.encode()
    except UnicodeEncodeError:  # bytes that aren't UTF-8
        return False
    return True


def _directories(top: str) -> list[str]:
    try:
        with os.scandir(top) as found:
            return sorted(e.path for e in found if _visible(e.name) and e.is_dir(follow_symlinks=False))
    except OSError:  # its own task says so
        return []


class Part(InputPartition):
    def __init__(self, directory: str, deep: bool):
        self.directory, self.deep = directory, deep


class TreeReader(DataSourceReader):
    """Rows (root, path, kind): dir, file, or unreadable for a directory that couldn't be listed. Links aren't followed."""

    def __init__(self, options: dict):
        self.root = os.path.realpath(options["path"])

    def partitions(self) -> list[Part]:
        """One for each directory of the first level that has TASKS of them, down to DEPTH, and one for each above, for what lies directly in it."""
        above, level = [self.root], _directories(self.root)
        for _ in range(DEPTH - 1):
            if len(level) >= TASKS:
                break
            above, level = above + level, [d for top in level for d in _directories(top)]
        return [*(Part(d, False) for d in above), *(Part(d, True) for d in level)]

    def read(self, partition: Part) -> Iterator[tuple]:
        waiting = [partition.directory]
        while waiting:
            directory = waiting.pop()
            yield self.root, directory, "dir"
            try:
                with os.scandir(directory) as found:
                    for e in found:
                        if not _visible(e.name):
                            continue
                        if e.is_dir(follow_symlinks=False):
                            if partition.deep:
                                waiting.append(e.path)
                        elif e.is_file(follow_symlinks=False):
                            yield self.root, e.path, "file"
            except OSError:
                yield self.root, directory, "unreadable"


class TreeSource(DataSource):
    """spark.dataSource.register(TreeSource); spark.read.format("tree").load("/some/root")"""

    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return "root string, path string, kind string"

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options)


def listing(spark, root: str):
    """(entries, unreadable) of a tree."""
    from pyspark.sql import functions as F

    spark.dataSource.register(TreeSource)
    rows = spark.read.format("tree").load(root)
    found = rows.where("kind <> 'unreadable'").select("root", "path", (F.col("kind") == "dir").alias("is_dir"))
    return found, rows.where("kind = 'unreadable'").select("root", F.col("path").alias("dir"))
