"""Directory trees as tables: a Python data source with a partition for each folder near the root."""

from __future__ import annotations

import fnmatch
import operator
import os
import re
import stat
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    StringContains,
    StringEndsWith,
    StringStartsWith,
)

SCHEMA = "path string, name string, parent string, extension string, is_file boolean, is_dir boolean, is_symlink boolean, size long, modified double, created double, mode int, depth int, readable boolean"


@dataclass
class Folder(InputPartition):
    """A folder, how far it is from the root, and whether its folders are walked too."""

    path: str
    depth: int
    down: bool


def entries(path: str) -> list[os.DirEntry]:
    """A folder's entries by name; none where it can't be read."""
    try:
        with os.scandir(path) as found:
            return sorted(found, key=lambda e: e.name)
    except OSError:
        return []


def row(entry: os.DirEntry, depth: int) -> tuple | None:
    """The record of an entry; None where it is gone or can't be looked at. Links stand for what they lead to."""
    try:
        s = entry.stat()
    except OSError:
        return None
    is_file, is_dir = stat.S_ISREG(s.st_mode), stat.S_ISDIR(s.st_mode)
    extension = os.path.splitext(entry.name)[1].lower() if is_file else ""
    return entry.path, entry.name, os.path.dirname(entry.path), extension, is_file, is_dir, entry.is_symlink(), s.st_size if is_file else 0, s.st_mtime, s.st_ctime, stat.S_IMODE(
        s.st_mode), depth, os.access(entry.path, os.R_OK)


#: Columns that an entry's name and place tell, so that it needn't be looked at.
CHEAP = ("name", "path", "parent", "extension", "depth")
_TESTS = {EqualTo: operator.eq, In: lambda v, many: v in many, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt,
    LessThanOrEqual: operator.le, StringStartsWith: str.startswith, StringEndsWith: str.endswith, StringContains: lambda v, part: part in v}


class TreeReader(DataSourceReader):
    """Lists folders. Conditions on names, places and depth are tested before an entry is looked at, those on size, times and kind before it
    becomes a row; folders that no wanted path can be below are not opened."""

    def __init__(self, options: dict[str, str]):
        self.root = options["path"].removeprefix("file://").rstrip("/") or "/"
        self.recursive = options.get("recursive", "true").lower() == "true"
        self.most = int(options.get("maxdepth", str(1 << 30)))
        self.split = int(options.get("splitdepth", "2"))
        self.pattern = re.compile(fnmatch.translate(options["pattern"])) if "pattern" in options else None
        self.tests: list[tuple[str, type, object]] = []
        self.prefixes: list[str] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Take over conditions on a column and a value; the others are Spark's."""
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for f in filters:
            if type(f) not in _TESTS or len(f.attribute) != 1 or f.attribute[0] not in names or f.value is None or isinstance(f, In) and None in f.value:
                yield f
                continue
            column = f.attribute[0]
            self.tests.append((column, type(f), f.value))
            if column == "depth" and type(f) in (EqualTo, LessThan, LessThanOrEqual):
                self.most = min(self.most, int(f.value) - (type(f) is LessThan))
            if column in ("path", "parent") and type(f) in (EqualTo, StringStartsWith):
                self.prefixes.append(f.value)

    def fits(self, values: dict, columns: tuple[str, ...] | None = None) -> bool:
        return all(values[c] is not None and _TESTS[kind](values[c], value) for c, kind, value in self.tests if columns is None or c in columns)

    def opened(self, path: str, depth: int) -> bool:
        """Whether a wanted entry can lie in the folder or below it."""
        inside = path.rstrip("/") + "/"
        return depth < self.most and all(p.startswith(inside) or inside.startswith(p) or p.rstrip("/") == path for p in self.prefixes)

    def partitions(self) -> list[InputPartition]:
        """Folders above ``splitDepth`` are listed one by one, those at it are walked whole."""
        out, todo = [], [(self.root, 0)]
        while todo:
            path, depth = todo.pop()
            if not self.opened(path, depth):
                continue
            down = self.recursive and depth >= self.split
            out.append(Folder(path, depth, down))
            if self.recursive and not down:
                todo += [(e.path, depth + 1) for e in entries(path) if e.is_dir(follow_symlinks=False)]
        return out

    def read(self, folder: Folder) -> Iterator[tuple]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        todo = [(folder.path, folder.depth)]
        while todo:
            path, depth = todo.pop()
            if not self.opened(path, depth):
                continue
            for e in entries(path):
                if folder.down and e.is_dir(follow_symlinks=False):
                    todo.append((e.path, depth + 1))
                known = {"name": e.name, "path": e.path, "parent": os.path.dirname(e.path), "extension": os.path.splitext(e.name)[1].lower(), "depth": depth + 1}
                if self.pattern and not self.pattern.fullmatch(e.name) or not self.fits(known, tuple(c for c in CHEAP if c != "extension")):
                    continue
                # a folder has no extension, so a condition that an entry's own doesn't meet may still be met by that
                if not self.fits(known, ("extension",)) and not self.fits({"extension": ""}, ("extension",)):
                    continue
                if (found := row(e, depth + 1)) is not None and self.fits(dict(zip(names, found))):
                    yield found


class TreeSource(DataSource):
    """``format("directory_tree")`` with options path, recursive, maxDepth, splitDepth and pattern; it takes conditions on a column and a value."""

    @classmethod
    def name(cls) -> str:
        return "directory_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return TreeReader({k.lower(): v for k, v in self.options.items()})


def scan(spark: SparkSession, root: str, pattern: str = "*", recursive: bool = True, files: bool = True, folders: bool = True,
    max_depth: int | None = None) -> DataFrame:
    """The entries of a tree whose name fits the glob ``pattern``; links to folders are listed, not followed.

    Conditions of a column and a value that are put on the result, such as ``extension = '.csv'`` or
    ``size > 1000``, are tested in the walk (the session's setting for that is switched on): what a path or depth rules out is not opened, what a
    name rules out not looked at.

    The tree must lie where the driver and all executors see it. Entries that can't be looked at are left
    out; those that can't be read have ``readable`` false. A missing root has no entries.
    """
    spark.dataSource.register(TreeSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("directory_tree").option("path", root).option("recursive", str(recursive).lower())
    reader = reader.option("pattern", pattern) if pattern != "*" else reader
    rows = (reader.option("maxDepth", str(max_depth)) if max_depth is not None else reader).load()
    if files != folders:
        return rows.where(F.col("is_file") if files else F.col("is_dir"))
    return rows.where((F.col("is_file") | F.col("is_dir")) & F.lit(files))


def check_directory(path: str, must_exist: bool = True) -> dict:
    """Whether a path is a folder that can be written to, and what is wrong. The messages are fixed values."""
    there, folder = os.path.exists(path), os.path.isdir(path)
    writable = folder and os.access(path, os.W_OK)
    if not there:
        errors = ["Directory does not exist"] if must_exist else []
    else:
        errors = [] if writable else ["Directory is not writable" if folder else "Path is not a directory"]
    return {"valid": not errors, "exists": there, "is_directory": folder, "writable": writable, "errors": errors}
