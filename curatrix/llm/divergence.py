"""How the vocabularies of sources differ, per language: which terms a source favours, and how far each other source is from it.

Terms are counted in numpy by length. Bytes of a term of up to 8 bytes are one uint64, of up to 16 bytes two; these words are
radix-sorted, 16 bits at a time from the lowest, with the (lang, source) group as the highest digit, and equal neighbours
are counted. Longer terms go to buckets by their length's power of two and are sorted as bytes. Sorting is stable and terms come
in the order of their documents, so that a run also tells in how many documents its term is.

A task counts its texts in parts of bounded size, and Spark adds the parts up by term. Every later step works on those counts: terms in at
least LEAST_DOCS documents of their language are kept, each group gives each kept term a smoothed share p of SCALE, and two
groups' divergence is the sum of floor((p - q) * (p - q) / q) over all kept terms. Most terms are in few groups. So the sum is
taken as if no term were in both (from a histogram of each group's counts), and corrected for the terms that both have; these
corrections are summed in numpy, a term's groups at a time, without a row for any pair of groups and term.

Rows: a null text, lang or source counts as ''. A row is a document, whatever its id, repeated or null. Groups whose texts
have no terms are groups still: all kept terms have count 0 there. Texts and terms of any length are taken whole. Equal values are ranked by item.
An empty table gives no rows; a language with one source has no pairs. Other columns are ignored, whatever their names.
Shares are taken in decimals, all else fits 64 bits: p is at most SCALE + 1, and a sum of squares of shares at most about SCALE squared."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curatrix.llm.common import byte_view, cut, lean, row_blocks, small_batches

SCALE = 1_000_000_000
LEAST_DOCS = 3
TOP = 200
FLUSH = 1 << 20  # terms, or 8 bytes of text, sorted at a time
SUMS = 1 << 20  # pairs of groups that a task keeps sums of
COUNTS = "lang string, source string, term string, n long, docs long"

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def radix_order(keys: list[np.ndarray]) -> np.ndarray:
    """The stable order of rows by keys (unsigned, the most significant first), 16 bits at a time from the lowest."""
    order = None
    for key in reversed(keys):
        for shift in range(0, key.dtype.itemsize * 8, 16):
            digit = (key >> key.dtype.type(shift)).astype(np.uint16)
            if len(digit) and (digit == digit[0]).all():
                continue
            order = np.argsort(digit, kind="stable") if order is None else order[np.argsort(digit[order], kind="stable")]
    return np.arange(len(keys[0])) if order is None else order


def runs(keys: list[np.ndarray], doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted rows: where each run of equal keys starts, its length, and how many documents it has (ascending within a run)."""
    new = np.ones(len(doc), bool)
    if len(doc):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    other = new.copy()
    other[1:] |= doc[1:] != doc[:-1]
    start = np.flatnonzero(new)
    return start, np.diff(np.append(start, len(doc))), np.add.reduceat(other.astype(np.int64), start) if len(start) else start


def packed(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first and second 8 bytes of terms of up to 16 bytes as numbers; bytes behind a term's end are 0. data has 16 bytes to spare."""
    word = np.ndarray((len(data) - 7,), ">u8", data, 0, (1,))
    keep = lambda n: np.where(n > 0, _ALL << (np.uint64(8) * (np.uint64(8) - np.maximum(n, 1).astype(np.uint64))), np.uint64(0))
    return word[start].astype(np.uint64) & keep(np.minimum(size, 8)), word[start + 8].astype(np.uint64) & keep(np.clip(size - 8, 0, 8))


def _texts(words: list[np.ndarray]) -> pa.Array:
    """Terms of packed numbers as strings."""
    raw = np.stack(words, 1).astype(">u8").view(np.uint8).reshape(len(words[0]), -1)
    full = raw != 0
    off = np.zeros(len(raw) + 1, np.int32)
    np.cumsum(full.sum(1), out=off[1:])
    return pa.StringArray.from_buffers(len(raw), pa.py_buffer(off.tobytes()), pa.py_buffer(raw[full].tobytes()))


class Counter:
    """Counts of a task's terms by group, given out in parts."""

    def __init__(self) -> None:
        self.groups: dict[tuple[str, str], int] = {}
        self.held: dict[object, list[tuple]] = {}
        self.size = self.doc = 0

    def add(self, texts: pa.Array, langs: list, sources: list) -> Iterator[pa.RecordBatch]:
        data, off = byte_view(texts)
        for i, j in row_blocks(off):
            codes = [self.groups.setdefault((langs[k] or "", sources[k] or ""), len(self.groups)) for k in range(i, j)]
            self._take(data[off[i] : off[j]], off[i : j + 1] - off[i], np.array(codes, np.uint32))
            if self.size >= FLUSH:
                yield from self.flush()

    def _take(self, data: np.ndarray, off: np.ndarray, codes: np.ndarray) -> None:
        n = len(data)
        low = np.zeros(n + 16, np.uint8)
        low[:n] = _LOWER[data]
        letter = np.zeros(n + 2, bool)
        letter[1:-1] = _LETTER[data]
        edge = np.zeros(n + 1, bool)
        edge[off] = True
        start = np.flatnonzero(letter[1:-1] & (~letter[:-2] | edge[:-1]))
        end = np.flatnonzero(letter[1:-1] & (~letter[2:] | edge[1:])) + 1
        size = end - start
        row = np.searchsorted(off, start, "right") - 1
        group, doc = codes[row], self.doc + row
        self.doc += len(codes)
        self.size += max(len(start), n >> 3)  # texts of few long terms are bounded by their bytes
        for kind, at in (("one", size <= 8), ("two", (size > 8) & (size <= 16))):
            if at.any():
                first, second = packed(low, start[at], size[at])
                self.held.setdefault(kind, []).append((group[at], doc[at], first, *([second] if kind == "two" else [])))
        for k in np.flatnonzero(size > 16).tolist():
            term = low[start[k] : end[k]].tobytes()
            self.held.setdefault(len(term).bit_length(), []).append((int(group[k]), int(doc[k]), term))

    def flush(self) -> Iterator[pa.RecordBatch]:
        names = list(self.groups)
        for kind, parts in self.held.items():
            if isinstance(kind, str):
                group, doc, *words = [np.concatenate(x) for x in zip(*parts, strict=True)]
                order = radix_order([group, *words])
                group, doc, words = group[order], doc[order], [w[order] for w in words]
                at, n, docs = runs([group, *words], doc)
                terms = _texts([w[at] for w in words])
            else:
                group, doc = (np.array([p[k] for p in parts], np.int64) for k in (0, 1))
                term = np.array([p[2] for p in parts])
                order = np.lexsort((term, group))
                group, doc, term = group[order], doc[order], term[order]
                at, n, docs = runs([group, term], doc)
                terms = pa.array([t.decode() for t in term[at].tolist()], pa.string())
            own = [names[g] for g in group[at].tolist()]
            yield from _batch([x[0] for x in own], [x[1] for x in own], terms, n, docs)
        self.held.clear()
        self.size = 0

    def close(self) -> Iterator[pa.RecordBatch]:
        """What is left, and each group once without a term."""
        yield from self.flush()
        own = list(self.groups)
        none = np.zeros(len(own), np.int64)
        yield from _batch([x[0] for x in own], [x[1] for x in own], pa.nulls(len(own), pa.string()), none, none)


def _batch(langs: list, sources: list, terms: pa.Array, n: np.ndarray, docs: np.ndarray) -> Iterator[pa.RecordBatch]:
    whole = pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(sources, pa.string()), terms, pa.array(n, pa.int64()), pa.array(docs, pa.int64())], names=["lang", "source", "term", "n", "docs"])
    for k in range(0, len(whole), 50_000):
        yield whole.slice(k, 50_000)


def counted(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences) and docs (documents with it), each term of a group once, and each group once with a null term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Counter()
        for batch in batches:
            yield from own.add(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist())
        yield from own.close()

    rows = docs.select(*[F.col(c).cast("string").alias(c) for c in ("text", "lang", "source")]).mapInArrow(lean(run), COUNTS)
    with small_batches(docs.sparkSession):
        return cut(rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))


def share(count: Column, n: Column, v: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / (n + v)), in decimals; 1 where nothing is kept (no term asks then)."""
    whole = (count.cast("decimal(19,0)") + F.lit(1).cast("decimal(1,0)")) * F.lit(SCALE).cast("decimal(10,0)")
    return F.when(v > 0, F.call_function("div", whole, n.cast("decimal(19,0)") + v.cast("decimal(19,0)")) + 1).otherwise(F.lit(1)).cast("long")


def gap(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


HELD = "array<struct<source:string,p:bigint,none:bigint>>"


def _corrections(shared: DataFrame) -> DataFrame:
    """lang, source, item, value: over the terms that both groups have, by how much the value differs from that of a term in neither's texts together.

    shared: lang and held, the groups that have a term, with its share and that of a term that the group lacks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[tuple[str, str], int] = {}
        sums: dict[int, int] = {}

        def given() -> pa.RecordBatch:
            own = list(names)
            pairs = [(own[k >> 32], own[k & 0xFFFFFFFF]) for k in sums]
            out = pa.RecordBatch.from_arrays([pa.array([a[0] for a, _ in pairs], pa.string()), pa.array([a[1] for a, _ in pairs], pa.string()), pa.array([b[1] for _, b in pairs], pa.string()), pa.array(list(sums.values()), pa.int64())], names=["lang", "source", "item", "value"])
            sums.clear()
            return out

        for batch in batches:
            held = batch.column(1)
            flat = held.flatten()
            size = np.diff(held.offsets.to_numpy())
            langs = np.repeat(np.array(batch.column(0).to_pylist(), object), size)
            code = np.array([names.setdefault(g, len(names)) for g in zip(langs.tolist(), flat.field(0).to_pylist(), strict=True)], np.int64)
            p, none = flat.field(1).to_numpy(), flat.field(2).to_numpy()
            first = np.cumsum(size) - size
            for m in np.unique(size[size > 1]).tolist():  # terms of equally many groups together
                of = first[size == m]
                for a in range(0, len(of), max(1, (1 << 20) // (m * m))):
                    at = of[a : a + max(1, (1 << 20) // (m * m)), None] + np.arange(m)
                    x, x0, c = p[at][:, :, None], none[at][:, :, None], code[at][:, :, None]
                    y, y0, d = p[at][:, None, :], none[at][:, None, :], code[at][:, None, :]
                    value = (x - y) ** 2 // y - (x0 - y) ** 2 // y - (x - y0) ** 2 // y0 + (x0 - y0) ** 2 // y0
                    key = np.broadcast_to(c << 32 | d, value.shape)
                    key, where = np.unique(key.ravel(), return_inverse=True)
                    total = np.zeros(len(key), np.int64)
                    np.add.at(total, where, value.ravel())
                    for k, t in zip(key.tolist(), total.tolist(), strict=True):
                        if k >> 32 != k & 0xFFFFFFFF:
                            sums[k] = sums.get(k, 0) + t
                    if len(sums) >= SUMS:
                        yield given()
        if sums:
            yield given()

    return shared.mapInArrow(lean(run), "lang string, source string, item string, value long")


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part (pair or term), item, value and rank of every group of docs (text, lang, source)."""
    counts = counted(docs)
    own = ["lang", "source"]
    groups = counts.where("term is null").select(*own)
    by_term = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("held"))  # a row per source
    kept = cut(by_term.where(F.col("docs") >= least_docs).select("lang", "term", "total", F.explode("held").alias("_h")).select("lang", "term", "total", "_h.*"))
    langs = groups.select("lang").distinct().join(by_lang(kept), "lang", "left").select("lang", F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("n_lang", F.lit(0)).alias("n_lang"))
    sizes = kept.groupBy(*own).agg(F.sum("n").alias("n_group"), F.count(F.lit(1)).alias("terms"))
    groups = groups.join(sizes, own, "left").join(langs, "lang")
    groups = groups.select(*own, "v", "n_lang", F.coalesce("n_group", F.lit(0)).alias("n_group"))
    groups = cut(groups.select("*", share(F.lit(0), F.col("n_group"), F.col("v")).alias("none")))
    shares = kept.join(groups, own).select(*own, "term", "n", share(F.col("n"), F.col("n_group"), F.col("v")).alias("p"), "none", share(F.col("total"), F.col("n_lang"), F.col("v")).alias("q"))
    shares = cut(shares)

    value = F.desc("value")
    place = F.row_number().over(Window.partitionBy(*own).orderBy(value, "item")).cast("int")
    terms = shares.where("p > q").select(*own, F.lit("term").alias("part"), F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))
    terms = terms.withColumn("rank", place).where(F.col("rank") <= top)

    # Each pair of groups as if no term were in both: all terms in neither, then those of the one and of the other.
    a, b = (groups.select("lang", F.col("source").alias(s), "v", F.col("none").alias(f"none_{s}")) for s in ("source", "item"))
    pairs = a.join(b.drop("v"), "lang").where("source <> item")
    neither = pairs.select(*own, "item", (F.col("v") * gap(F.col("none_source"), F.col("none_item"))).alias("value"))
    often = shares.groupBy(*own, "p", "none").agg(F.count(F.lit(1)).alias("k"))
    other = groups.select("lang", F.col("source").alias("other"), F.col("none").alias("none_other"))
    ends = often.join(other, "lang").where("source <> other")
    bare = lambda x, y: gap(F.col(x), F.col(y))
    of_source = ends.select(*own, F.col("other").alias("item"), (F.col("k") * (bare("p", "none_other") - bare("none", "none_other"))).alias("value"))
    of_item = ends.select("lang", F.col("other").alias("source"), F.col("source").alias("item"), (F.col("k") * (bare("none_other", "p") - bare("none_other", "none"))).alias("value"))
    shared = shares.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "none")).alias("held")).where("size(held) > 1")
    both = _corrections(shared.select("lang", F.col("held").cast(HELD).alias("held")))
    sums = neither.unionByName(of_source).unionByName(of_item).unionByName(both).groupBy(*own, "item").agg(F.sum("value").alias("value"))
    far = sums.select(*own, F.lit("pair").alias("part"), "item", "value").withColumn("rank", place)
    return far.unionByName(terms)


def by_lang(kept: DataFrame) -> DataFrame:
    """lang, v (kept terms) and n_lang (their occurrences)."""
    return kept.groupBy("lang", "term").agg(F.first("total").alias("total")).groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("n_lang"))
