"""A data source that walks a tree: ignore rules are applied on the way down, so an ignored folder is never listed.

    spark.dataSource.register(TreeSource)
    spark.read.format("tree").option("path", root).load()

The driver walks the first levels and hands each folder there to a task as a partition; tasks walk the rest. Files lie where
all tasks see them under one path (a shared mount); for other stores there is corpus.tree_files.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from siftwell.sources.corpus import IGNORE_FILES, ignore_rule

SCHEMA = "path string, dir string, name string, ext string, body string, n_bytes long, modified timestamp"
LEVELS = 2
"""Levels of folders that the driver walks."""
Rules = tuple[tuple[str, bool], ...]


@dataclass
class Folder(InputPartition):
    """A folder, relative to the root, with the rules that hold there; whole: with all below it."""

    path: str
    rules: Rules
    whole: bool


def rules_in(root: str, folder: str, inherited: Rules) -> Rules:
    """The rules that hold in a folder: those from above, then those of its own ignore files."""
    found = list(inherited)
    for name in IGNORE_FILES:
        try:
            with open(os.path.join(root, folder, name), encoding="utf-8", errors="replace") as f:
                found += [r for line in f.read().splitlines() if (r := ignore_rule(line, folder))]
        except OSError:
            continue
    return tuple(found)


def is_ignored(path: str, rules: Rules) -> bool:
    """Whether the last rule that matches ignores a path; a folder's ends with a slash."""
    return next((ignores for pattern, ignores in reversed(rules) if re.match(pattern, path)), False)


def entries(root: str, folder: str, rules: Rules) -> tuple[list[os.DirEntry], list[str]]:
    """(files, folders) of a folder that are neither hidden nor ignored, by name. Links to folders are not followed."""
    files, folders = [], []
    try:
        with os.scandir(os.path.join(root, folder)) as found:
            listed = sorted(found, key=lambda e: e.name)
    except OSError:
        return [], []
    for e in listed:
        path = f"{folder}/{e.name}" if folder else e.name
        if e.name.startswith("."):
            continue
        if e.is_dir(follow_symlinks=False):
            if not is_ignored(f"{path}/", rules):
                folders.append(path)
        elif e.is_file() and not is_ignored(path, rules):
            files.append(e)
    return files, folders


def walk(root: str, start: str, inherited: Rules, whole: bool = True) -> Iterator[tuple[str, os.DirEntry]]:
    """(folder, file) of the files in a folder and, with whole, below it."""
    todo = [(start, inherited)]
    while todo:
        folder, above = todo.pop()
        rules = rules_in(root, folder, above)
        files, folders = entries(root, folder, rules)
        yield from ((folder, e) for e in files)
        if whole:
            todo += [(f, rules) for f in reversed(folders)]


def parts(root: str, levels: int, ignore: bool = True) -> list[Folder]:
    """The folders of the first levels, each for itself, and those of the level below them with all they hold."""
    out, now = [], [("", ())]
    for _ in range(levels):
        below = []
        for folder, above in now:
            out.append(Folder(folder, above, False))
            rules = rules_in(root, folder, above) if ignore else ()
            below += [(f, rules) for f in entries(root, folder, rules)[1]]
        now = below
    return out + [Folder(f, rules, True) for f, rules in now]


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"].removeprefix("file://").rstrip("/") or "/"
        self.levels, self.most = int(options.get("levels", LEVELS)), options.get("maxbytes")

    def partitions(self) -> list[Folder]:
        return parts(self.root, self.levels)

    def read(self, partition: Folder) -> Iterator[tuple]:
        for folder, e in walk(self.root, partition.path, partition.rules, partition.whole):
            try:
                stat = e.stat()
                if self.most is not None and stat.st_size > int(self.most):
                    continue
                with open(e.path, "rb") as f:
                    raw = f.read()
            except OSError:
                continue
            try:
                body = raw.decode("utf-8")
            except UnicodeDecodeError:
                body = None
            ext = re.search(r"\.([^.]+)$", e.name)
            yield (f"{folder}/{e.name}" if folder else e.name, folder, e.name, ext[1].lower() if ext else "", body, stat.st_size, datetime.fromtimestamp(stat.st_mtime, UTC))


class TreeSource(DataSource):
    """Options: path, levels (of folders that the driver walks), maxBytes (of a file)."""

    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(dict(self.options))


def walked_files(spark: SparkSession, root: str, max_bytes: int | None = None) -> DataFrame:
    """The files of a tree as corpus.tree_files has them, names that begin with an underscore included."""
    spark.dataSource.register(TreeSource)
    read = spark.read.format("tree").option("path", root)
    return (read if max_bytes is None else read.option("maxBytes", max_bytes)).load()
