"""Near duplicates by SimHash, found by covering locality-sensitive hashing.

A document's fingerprint has 64 bits: each is set where more than half of the document's word shingles have it set in
their XXH64. Two documents link where their fingerprints differ in at most RADIUS bits.

Covering: each bit position is given one of the nonzero vectors of RADIUS + 1 bits, dealt evenly. For each nonzero vector
v a table keeps the positions whose vector has an odd inner product with v, and two fingerprints meet in it where they
agree on those. The vectors of at most RADIUS differing positions don't span the space, so some v is orthogonal to all of
them: every pair within the radius meets in some table, whatever the bits are. There are 2 ** (RADIUS + 1) - 1 tables, each
comparing about half of the bits.

Only distinct fingerprints meet, one row each. A bucket of more than BUCKET of them is covered again: the positions that its
table leaves open get vectors of their own, and by the same argument every pair within the radius meets in one of the finer
tables. The open positions shrink by more than half each time, so that after three rounds (six open positions) no more fingerprints exist than a bucket
may hold. So no bucket is left out, none is compared as a whole beyond BUCKET, and the result is exact.

Rows: a null text counts as empty, and texts without words have the fingerprint zero, linked like any other. Repeated rows
are documents like others. A row without an id links others but has no id to give; its component_id is the smallest id of
its component, null where that has none. Very long texts are read in pieces. An empty table gives no rows. Other columns are
ignored, whatever their names."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.llm.common import PIECE, byte_view, cut, lean, row_blocks, small_batches, word_spans
from curatrix.llm.components import components

RADIUS = 2
SHINGLE = 3
SEED = 42
BITS = 64
BUCKET = 64
PART = 1 << 16  # shingles hashed at a time
LINKS = "a long, b long"


def shingle_values(low: bytes, starts: np.ndarray, ends: np.ndarray) -> Iterator[np.ndarray]:
    """XXH64 of a text's shingles, in parts. low: its words, lower-cased, with one space between."""
    n = len(starts)
    size = min(n, SHINGLE)
    digest = xxhash.xxh64_intdigest
    for a in range(0, n - size + 1, PART):
        b = min(n - size + 1, a + PART)
        spans = zip(starts[a:b].tolist(), ends[a + size - 1 : b + size - 1].tolist(), strict=True)
        yield np.fromiter((digest(low[s:e], SEED) for s, e in spans), np.uint64, b - a)


def set_bits(values: np.ndarray) -> np.ndarray:
    """How many of the values have each bit, the highest bit first."""
    counts = np.zeros(BITS, np.int64)
    for a in range(0, len(values), 4096):
        counts += np.unpackbits(values[a : a + 4096].astype(">u8").view(np.uint8)).reshape(-1, BITS).sum(0, dtype=np.int64)
    return counts


def fingerprints(col: pa.Array) -> np.ndarray:
    """The fingerprint of each row's text."""
    data, off = byte_view(col)
    out = np.zeros(len(off) - 1, np.uint64)
    for i, j in row_blocks(off):
        low, starts, ends, first = word_spans(data[off[i] : off[j]], off[i : j + 1] - off[i])
        low = low.tobytes()
        for k in range(i, j):
            a, b = first[k - i], first[k - i + 1]
            if a == b:
                continue
            counts, n = np.zeros(BITS, np.int64), 0
            for values in shingle_values(low, starts[a:b], ends[a:b]):
                counts += set_bits(values)
                n += len(values)
            out[k] = int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")
    return out


def fingerprinted(docs: DataFrame) -> DataFrame:
    """doc_id and its fingerprint, as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fingerprints(batch.column(1)).view(np.int64))], names=["doc_id", "fingerprint"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    with small_batches(docs.sparkSession):
        return cut(docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(lean(run), f"doc_id {kind}, fingerprint long"))


def covering(open_bits: int) -> list[int]:
    """Masks over the open bits: any two values that differ in at most RADIUS of these agree on one mask at least."""
    size = 1 << RADIUS + 1
    masks = [0] * (size - 1)
    at = 0
    for bit in (k for k in range(BITS) if open_bits >> k & 1):
        vector = at % (size - 1) + 1
        at += 1
        for v in range(1, size):
            masks[v - 1] |= (bin(vector & v).count("1") & 1) << bit
    return masks


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _dealt(rows: DataFrame, masks: list[list[int]]) -> DataFrame:
    """rows (table, fingerprint) under each mask of their table: (table, key, fingerprint). masks[t]: those of table t."""
    width = len(masks[0])
    known = F.array(*[F.lit(_signed(m)) for of in masks for m in of])
    finer = F.col("table") * width + F.col("_v")
    rows = rows.withColumn("_v", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
    return rows.select(finer.alias("table"), F.col("fingerprint").bitwiseAND(F.element_at(known, finer + 1)).alias("key"), "fingerprint")


def near_links(prints: DataFrame, most: int = BUCKET) -> DataFrame:
    """All pairs a < b of the distinct values of prints (fingerprint) that differ in at most RADIUS bits."""
    if most < 32:
        raise ValueError("a bucket must hold 32 fingerprints at least: covering few open positions again doesn't part them")
    rows = prints.select(F.lit(0).alias("table"), "fingerprint")
    fixed, out = [0], None
    while True:
        masks = [[f | m for m in covering(~f & (1 << BITS) - 1)] for f in fixed]
        fixed = [m for of in masks for m in of]
        dealt = _dealt(rows, masks)
        many = dealt.groupBy("table", "key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
        met = cut(dealt.join(many, ["table", "key"]))
        held = met.where(F.col("_n") <= most).groupBy("table", "key").agg(F.sort_array(F.collect_list("fingerprint")).alias("_all"))  # `most` at most
        each = held.select("_all", F.posexplode("_all").alias("_at", "a"))
        later = F.slice("_all", F.col("_at") + 2, F.size("_all"))
        near = F.filter(later, lambda b: F.bit_count(F.col("a").bitwiseXOR(b)) <= RADIUS)
        links = cut(each.select("a", F.explode(near).alias("b")).distinct())
        out = links if out is None else out.unionByName(links)
        rows = met.where(F.col("_n") > most).select("table", "fingerprint")
        if rows.isEmpty():
            return out.distinct()


def link_components(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id reachable by links."""
    rows = fingerprinted(docs)
    known = cut(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("_least")))
    labels = components(near_links(known.select("fingerprint")))
    named = known.join(labels, F.col("fingerprint") == F.col("node"), "left").select("fingerprint", "_least", F.coalesce("label", "fingerprint").alias("label"))
    least = named.groupBy("label").agg(F.min("_least").alias("component_id"))
    named = cut(named.join(least, "label").select(F.col("fingerprint").alias("_print"), "component_id"))
    out = rows.join(named, F.col("fingerprint") == F.col("_print"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
