"""A tree of source files as a data source: ``spark.read.format("source_tree").load(root)``.

Folders are pruned while listing; folders are partitions (option ``partitions``: how many at least), so large trees are listed and read in parallel.
"""

from __future__ import annotations

import hashlib
import os
from collections import deque
from pathlib import Path

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lodelens.functions.paths import LANGUAGES
from lodelens.sources.ignore import BINARY_ENDS, EXCLUDED_FOLDERS, Ignore

MAX_BYTES = 2_000_000
PARTITIONS = 64
BY_END = {"." + e: lang for lang, ends in LANGUAGES.items() for e in ends}


def read_text(path: str | Path) -> str | None:
    """UTF-8, bad bytes dropped; None if it can't be read."""
    try:
        return Path(path).read_bytes().decode("utf-8", "ignore")
    except OSError:
        return None


def walk(root: str | Path, start: str | Path | None = None, ignore: Ignore | None = None, max_bytes: int = MAX_BYTES, deep: bool = True):
    """(path, relative path, size, language, mtime_ns) in order; links, binary, empty and oversized files are passed over."""
    root = Path(root)
    ignore = ignore or Ignore(root)
    with os.scandir(start or root) as it:
        entries = sorted(it, key=lambda e: e.name)
    for e in entries:
        if e.is_symlink():
            continue
        if e.is_dir():
            if deep and e.name not in EXCLUDED_FOLDERS and not ignore.ignored(e.path, True):
                yield from walk(root, e.path, ignore, max_bytes)
            continue
        end = os.path.splitext(e.name)[1].lower()
        if not e.is_file() or end in BINARY_ENDS or ignore.ignored(e.path):
            continue
        st = e.stat()
        if st.st_size == 0 or st.st_size > max_bytes:
            continue
        lang = BY_END.get(end)
        if lang is None:
            with open(e.path, "rb") as f:
                if b"\0" in f.read(4096):
                    continue
        yield e.path, Path(e.path).relative_to(root).as_posix(), st.st_size, lang, st.st_mtime_ns


class _Part(InputPartition):
    def __init__(self, start: str, deep: bool):
        super().__init__(start)
        self.start, self.deep = start, deep


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.root = str(options.get("path"))
        self.use_ignore = str(options.get("ignorefiles", "true")).lower() != "false"
        self.max_bytes = int(options.get("maxfilebytes", MAX_BYTES))
        self.wanted = int(options.get("partitions", PARTITIONS))

    def partitions(self):
        """Folders to walk as a whole, and folders of which only the files are left, as their subfolders are partitions of their own.

        Folders are opened breadth first until there are enough, so a tree with all its files below one folder is divided too.
        """
        ignore = Ignore(self.root, self.use_ignore)
        shallow, deep = [], deque([self.root])
        while deep and len(deep) < self.wanted:
            folder = deep.popleft()
            with os.scandir(folder) as it:
                below = sorted(
                    e.path for e in it if e.is_dir() and not e.is_symlink() and e.name not in EXCLUDED_FOLDERS and not ignore.ignored(e.path, True)
                )
            shallow.append(folder)
            deep.extend(below)
        return [*[_Part(f, False) for f in shallow], *[_Part(f, True) for f in deep]]

    def read(self, part):
        ignore = Ignore(self.root, self.use_ignore)
        for path, rel, size, lang, mtime in walk(self.root, part.start, ignore, self.max_bytes, part.deep):
            content = read_text(path)
            digest = None if content is None else hashlib.sha256(content.encode()).hexdigest()
            yield rel, size, lang, mtime, digest, content


class SourceTree(DataSource):
    @classmethod
    def name(cls):
        return "source_tree"

    def schema(self):
        return "rel_path string, size bigint, language string, mtime_ns bigint, file_hash string, content string"

    def reader(self, schema):
        return _Reader(self.options)


def register(spark) -> None:
    from lodelens.sources.gitlog import GitLog

    spark.dataSource.register(SourceTree)
    spark.dataSource.register(GitLog)
