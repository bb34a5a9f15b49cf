"""Folder trees as a table: a data source that lists folders in parallel, each as a partition.

The driver lists only until there are PARTS folders still to go; each of these is listed with all below it by a task. A
recovery folder is left out before it is opened, and links are told but not followed. What can't be read is a row with an error,
not a failure. A filter on the size, the kind or the extension is applied while listing; a name pattern comes as an option."""

from __future__ import annotations

import os
import stat as st
from collections.abc import Iterator
from fnmatch import fnmatchcase

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from curatrix.functions.scalars import RECOVERY, path_key

SCHEMA = "path string, name string, extension string, kind string, size long, created_at long, modified_at long, accessed_at long, hidden boolean, readonly boolean, error string"
UNREADABLE = "UNREADABLE"
PARTS = 64
COMPARES = {GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b, EqualTo: lambda a, b: a == b, In: lambda a, b: a in b}


def _ms(ns: int | None) -> int | None:
    return None if ns is None else ns // 1_000_000


def _extension(name: str) -> str:
    first, dot, last = name.rpartition(".")
    return last.lower() if dot and first else ""


def _row(path: str, name: str, kind: str, size=None, created=None, modified=None, accessed=None, readonly=None, error=None) -> tuple:
    return (path, name, _extension(name) if kind != "directory" else "", kind, size, created, modified, accessed, name.startswith("."), readonly, error)


def _local_entries(folder: str) -> Iterator[tuple]:
    with os.scandir(folder) as entries:
        for e in sorted(entries, key=lambda x: x.name):
            path = f"{folder.rstrip('/')}/{e.name}"
            try:
                s = e.stat(follow_symlinks=False)
            except OSError:
                yield _row(path, e.name, "file", error=UNREADABLE)
                continue
            kind = "symlink" if st.S_ISLNK(s.st_mode) else "directory" if st.S_ISDIR(s.st_mode) else "file" if st.S_ISREG(s.st_mode) else None
            if kind:  # no pipes, sockets or devices
                born = getattr(s, "st_birthtime_ns", None)
                yield _row(path, e.name, kind, s.st_size if kind == "file" else None, _ms(born if born is not None else s.st_ctime_ns), _ms(s.st_mtime_ns), _ms(s.st_atime_ns), not s.st_mode & st.S_IWUSR)


def _remote_entries(folder: str) -> Iterator[tuple]:
    """Of a store that pyarrow opens: it tells the size and the date of change only."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder)
    for i in sorted(store.get_file_info(fs.FileSelector(root)), key=lambda x: x.base_name):
        kind = "directory" if i.type == fs.FileType.Directory else "file"
        yield _row(f"{folder.rstrip('/')}/{i.base_name}", i.base_name, kind, i.size if kind == "file" else None, None, _ms(i.mtime_ns), None, None)


def entries_of(folder: str) -> list[tuple]:
    """The direct entries of a folder, or one row that says that it can't be read. A folder that is a link isn't read."""
    local = "://" not in folder
    name = folder.rstrip("/").rpartition("/")[2]
    try:
        if local and os.path.islink(folder.rstrip("/")):
            raise OSError(folder)
        return list(_local_entries(folder) if local else _remote_entries(folder))
    except OSError:
        return [_row(folder.rstrip("/"), name, "directory", error=UNREADABLE)]


class _Folder(InputPartition):
    def __init__(self, path: str, deep: bool):
        self.path, self.deep = path, deep


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.roots = options["roots"].split("\n")
        self.recursive = options.get("recursive", "true") == "true"
        self.glob, self.recovery = options.get("glob", ""), options.get("recovery", RECOVERY).lower()
        self.filters: list[tuple] = []

    def pushFilters(self, filters):
        for f in filters:
            if type(f) in COMPARES and len(f.attribute) == 1 and f.attribute[0] in ("size", "kind", "extension"):
                self.filters.append((SCHEMA.split(", ").index(next(c for c in SCHEMA.split(", ") if c.startswith(f"{f.attribute[0]} "))), COMPARES[type(f)], f.value))
            else:
                yield f

    def wanted(self, row: tuple) -> bool:
        if row[10] is None and self.glob and row[3] != "directory" and not fnmatchcase(row[1], self.glob):
            return False
        return all(row[at] is not None and holds(row[at], value) for at, holds, value in self.filters)

    def below(self, rows: list[tuple]) -> list[str]:
        return [r[0] for r in rows if r[3] == "directory" and r[10] is None and r[1].lower() != self.recovery]

    def partitions(self):
        """Folders to list, with what is below or without: roots inside other roots once, until there are PARTS."""
        keys: dict[str, str] = {}
        for root in sorted((r.rstrip("/") or "/" for r in self.roots), key=len):
            path = root.lower()
            inside = self.recursive and any(path.startswith(k.rstrip("/") + "/") for k in keys)
            if not inside and self.recovery not in path.split("/"):
                keys.setdefault(path, root)
        if not self.recursive:
            return [_Folder(p, False) for p in keys.values()] or [_Folder("", False)]
        todo, single = list(keys.values()), []
        while todo and len(todo) + len(single) < PARTS:
            single.append(todo.pop(0))
            todo += self.below(entries_of(single[-1]))
        return [*[_Folder(p, False) for p in single], *[_Folder(p, True) for p in todo]] or [_Folder("", False)]

    def read(self, partition):
        todo = [partition.path] if partition.path else []
        while todo:
            rows = entries_of(todo.pop())
            if partition.deep:
                todo += self.below(rows)
            yield from (r for r in rows if r[1].lower() != self.recovery and self.wanted(r))


class FolderSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "folders"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def list_entries(spark: SparkSession, roots: list[str], recursive: bool = True, glob: str | None = None, recovery_dir: str = RECOVERY) -> DataFrame:
    """All entries below the roots, each path key once: path, name, extension, kind (file, directory, symlink), size, created_at,
    modified_at, accessed_at (ms), hidden, readonly and error (UNREADABLE). A root that isn't there, or is a link, is unreadable too."""
    if spark.conf.get("spark.sql.python.filterPushdown.enabled") != "true":
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FolderSource)
    reader = spark.read.format("folders").option("roots", "\n".join(roots)).option("recursive", str(recursive).lower()).option("recovery", recovery_dir)
    return (reader.option("glob", glob) if glob else reader).load()


def once(entries: DataFrame) -> DataFrame:
    """Of entries whose paths differ in case only, the first."""
    columns = entries.columns
    held = entries.groupBy(path_key(F.col("path")).alias("_key")).agg(F.min_by(F.struct(*columns), "path").alias("_e"))
    return held.select("_e.*")
