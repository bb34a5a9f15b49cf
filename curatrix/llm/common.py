"""Helpers that the training-data operators share: the shared folder, byte views of Arrow columns, word hashes."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SETTING = "spark.checkpoint.dir"
BATCH_SETTING, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 400
PIECE = 1 << 18  # bytes of text worked on at a time
MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
BASE = 0x9E3779B97F4A7C15 | 1
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)


def shared_folder(spark: SparkSession) -> str:
    """A new folder name below spark.checkpoint.dir. Where that is unset: in local mode below a folder of this machine; on a cluster, an error."""
    root = spark.sparkContext.getConf().get(SETTING) or spark.conf.get(SETTING, None)
    if not root:
        kept = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = kept.get() if kept.isDefined() else None
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError(f"{SETTING} must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def bounded_batches(spark: SparkSession) -> None:
    """From now on the session hands Python batches of at most BATCH_ROWS rows, as small_batches does for a while."""
    kept = int(spark.conf.get(BATCH_SETTING))
    spark.conf.set(BATCH_SETTING, min(kept, BATCH_ROWS) if kept > 0 else BATCH_ROWS)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What runs within hands Python batches of at most BATCH_ROWS rows, so that a task holds few texts at a time."""
    kept = spark.conf.get(BATCH_SETTING)
    bounded_batches(spark)
    try:
        yield
    finally:
        spark.conf.set(BATCH_SETTING, kept)


def give_back() -> None:
    """Memory that this process has freed goes back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, which then gives the memory that it has freed back to the system: Python workers are kept for later tasks."""

    @functools.wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        yield from run(batches)
        give_back()

    return wrapped


def cut(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it: later steps don't run it again, and lost executors lose nothing."""
    where = shared_folder(df.sparkSession)
    with small_batches(df.sparkSession):
        df.write.parquet(where)
    give_back()  # a driver that has fitted a model holds its sample's memory else
    return df.sparkSession.read.schema(df.schema).parquet(where)


def held_out(doc_id: Column) -> Column:
    """Whether the row is kept from training: crc32 of the id as text, modulo 5, is 0. A null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def byte_view(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column one after the other, and where each row starts; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    a = pc.fill_null(col.cast(pa.large_string()), "")
    off = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1] if len(a) else np.zeros(1, np.int64)
    raw = a.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def row_blocks(off: np.ndarray, most: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most so many bytes together, or one longer row alone."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, j
        i = j


def mix(x: np.ndarray) -> np.ndarray:
    """A full mix of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * MIX1
    x = x ^ (x >> np.uint64(27))
    x = x * MIX2
    return x ^ (x >> np.uint64(31))


_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, PIECE + 1024)
        up, down = np.full(size, BASE, np.uint64), np.full(size, pow(BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _powers[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _powers[0], _powers[1]


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of rows of UTF-8 bytes: a 64-bit hash of each word (A-Z lower-cased; words are runs of other than white space),
    where each row's words start, and the words' first bytes and ends."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = _LOWER[data]
    word = ~_IS_SPACE[low]
    cuts = np.zeros(n + 1, bool)
    cuts[off] = True
    before = np.empty(n, bool)
    before[0], before[1:] = False, word[:-1]
    starts = np.flatnonzero(word & (~before | cuts[:-1]))
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, word[1:]
    ends = np.flatnonzero(word & (~after | cuts[1:])) + 1
    h = np.empty(len(starts), np.uint64)
    first = 0
    while first < len(starts):  # in pieces, so that the tables of powers stay small however long a row is
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + PIECE, "right")))
        a, b = starts[first], ends[last - 1]
        up, down = _power_tables(int(b - a))
        sums = np.zeros(b - a + 1, np.uint64)
        np.cumsum((low[a:b].astype(np.uint64) + np.uint64(1)) * up[: b - a], out=sums[1:])
        s, e = starts[first:last] - a, ends[first:last] - a
        h[first:last] = (sums[e] - sums[s]) * down[s]
        first = last
    h = mix(h ^ (ends - starts).astype(np.uint64) * np.uint64(BASE))
    return h, np.searchsorted(starts, off), starts, ends


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows of UTF-8 bytes with A-Z lower-cased and one space after each word, the words' first bytes and ends therein, and where each row's words start."""
    low = _LOWER[data]
    word = ~_IS_SPACE[low]
    n = len(data)
    if not n:
        return low, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    cuts = np.zeros(n + 1, bool)
    cuts[off] = True
    first = word.copy()
    first[1:] &= ~word[:-1] | cuts[1:-1]
    starts = np.flatnonzero(first)
    # A word's bytes move by the number of words before it, each with its one space, less the white space before it.
    rank = np.cumsum(first)
    kept = np.flatnonzero(word)
    to = np.arange(len(kept)) + rank[kept] - 1
    out = np.full(len(kept) + len(starts), 0x20, np.uint8)
    out[to] = low[kept]
    begin = to[first[kept]]
    end = np.append(begin[1:] - 1, len(out) - 1) if len(starts) else begin
    return out, begin, end, np.searchsorted(starts, off)


SHINGLE = 5
_LANES = [np.uint64(pow(BASE, 3 * k + 2, 1 << 64)) for k in range(SHINGLE)]


def shingle_hashes(words: np.ndarray) -> np.ndarray:
    """The row's sorted distinct 5-word shingles as 64-bit hashes; of fewer words, the whole sequence as one."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        if n < SHINGLE:
            return mix(np.array([sum(int(w) * int(k) for w, k in zip(words, _LANES, strict=False)) + n & (1 << 64) - 1], np.uint64))
        m = n - SHINGLE + 1
        x = words[:m] * _LANES[0]
        for k in range(1, SHINGLE):
            x = x + words[k : m + k] * _LANES[k]
    return np.unique(mix(x))
