"""Durable keyed tables (protection marks, corrections, caches, dismissals) and exclusive records, in any file system that Spark writes to.

A table is a folder of versions. A version's rows are written first, under a name of their own; then a small record with the
next number names them, created exclusively. Who finds the number taken has lost: their rows are named by no record and never
read. So a change is there as a whole or not at all, for readers and for writers; what is as good as the file system's
exclusive create."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


class StaleVersion(RuntimeError):
    pass


def _file_system(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path as it names it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def claim(spark: SparkSession, path: str, record: dict) -> bool:
    """Create the file path with a record as JSON; False where it is there already."""
    fs, where = _file_system(spark, path)
    try:
        out = fs.create(where, False)
    except Py4JJavaError as e:
        if "AlreadyExists" in e.java_exception.getClass().getName() or fs.exists(where):
            return False
        raise
    out.write(bytearray((json.dumps(record) + "\n").encode()))
    out.close()
    return True


def recorded(spark: SparkSession, path: str) -> bool:
    fs, where = _file_system(spark, path)
    return fs.exists(where)


def names_in(spark: SparkSession, path: str) -> list[str]:
    fs, where = _file_system(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []


class Store:
    """A versioned table of one schema."""

    def __init__(self, spark: SparkSession, path: str, schema: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.schema = spark.createDataFrame([], schema).schema

    def read(self) -> tuple[DataFrame, int]:
        """The rows of the last whole version (none: no rows), and the number that a writer has to know."""
        found = [n for n in names_in(self.spark, f"{self.path}/versions") if n.isdigit()]
        for name in reversed(found):
            told = self.spark.read.schema("rows string").json(f"{self.path}/versions/{name}").first()  # one line
            if told and told["rows"]:
                return self.spark.read.schema(self.schema).parquet(f"{self.path}/rows/{told['rows']}"), int(found[-1])
        return self.spark.createDataFrame([], self.schema), int(found[-1]) if found else 0

    def write(self, rows: DataFrame, known: int) -> int:
        """Rows as the version after `known`; StaleVersion where another writer was faster."""
        name = uuid.uuid4().hex
        rows.select(self.schema.names).write.parquet(f"{self.path}/rows/{name}")
        if not claim(self.spark, f"{self.path}/versions/{known + 1:012d}", {"rows": name}):
            raise StaleVersion(self.path)
        return known + 1

    def change(self, how: Callable[[DataFrame], DataFrame], tries: int = 5) -> int:
        """how(rows) as the next version, again from the newest rows where another writer was faster."""
        for left in range(tries - 1, -1, -1):
            rows, known = self.read()
            try:
                return self.write(how(rows), known)
            except StaleVersion:
                if not left:
                    raise
        raise StaleVersion(self.path)


MARKS = "digest string"
CORRECTIONS = "digest string, categories array<string>, embedding array<double>, model string, mode string"
DISMISSED = "signature string"
