"""Jaccard join on word shingles by grouped prefixes.

Each document is the set of its 5-word shingles, in one global order: hashes, those that are frequent last. Two sets of
similarity t share a shingle among the first n - ceil(t n) + 1 of each (the prefix), and the number of prefix shingles
that they share bounds their overlap. Documents with the same prefix and size are one group; groups are joined on prefix
shingles and filtered by size and by that bound; what is left is expanded to the members and verified on whole sets.

Verification has two steps. Each set has a small histogram of its hashes; the sum of the smaller counts of two histograms
is at least their overlap, so pairs for which that is too little go without their texts being read. For the others the
texts of one side are dealt to that of the other, in salted parts of bounded size, and the sets are compared in a stream:
a task holds one set and one batch.

Only the components of the links are wanted, and a pair within one component needs no more work. So pairs are
verified in rounds: members with their group's first; then each group with those that most of its shingles name among
their few pivots (those whose shingles are the most common, as an original's are, and some by hash); at last every pair
that is left between different components. The last round leaves out nothing, so the result is exact, and a family of near
copies costs a star, not all its pairs.

In the last round, shingles that more than HOT groups have are joined apart. A pair with no other shingle in common must get
its whole overlap from them, so their join keeps only sets that have enough of them, and sets outside the component that most of the shingle's
groups are in; a pair with another one in common comes from the join of those, which is linear in the shingles.

The order only affects the work. Frequent shingles are those with the most documents (at most FREQUENT of them). Sets are
told apart by 128 bits. Groups have 64-bit names: two with one name would only add candidates.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curatrix.llm.common import byte_view, cut, lean, row_blocks, shingle_hashes, small_batches, word_hashes
from curatrix.llm.components import components

T_NUM, T_DEN = 75, 100
FREQUENT = 300_000
LEAST_FREQUENT = 24
PIVOTS = 6  # of each shingle: half by score, half by hash
HOT = 64
PARTNERS = 3  # of each group
BROADCAST_IDS = 500_000
PART_KEYS = 250_000  # prefix shingles in a part
CELLS = 512  # of a set's histogram
LEAVES = 64  # texts dealt to one of the other side's
_LAST = np.int64(1 << 62)


def document_sets(col: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of each row."""
    data, off = byte_view(col)
    for a, b in row_blocks(off):
        words, first, _, _ = word_hashes(data[off[a] : off[b]], off[a : b + 1] - off[a])
        for k in range(a, b):
            yield k, shingle_hashes(words[first[k - a] : first[k - a + 1]])


def prefix_size(n: int) -> int:
    return n - -(-T_NUM * n // T_DEN) + 1


def histogram(s: np.ndarray) -> bytes:
    """How many hashes fall into each cell; empty if a count doesn't fit a byte."""
    counts = np.bincount((s & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else b""


def _rows(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select("doc_id", F.xxhash64(text).alias("tid"), text.alias("text"))


def frequent(docs: DataFrame, most: int = FREQUENT, least: int = LEAST_FREQUENT) -> np.ndarray:
    """Order keys of the shingles of many documents: at most `most`, whatever the size of the input."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate(kept), return_counts=True)
            kept.clear()
            many = n > 1  # a shingle that no part of the table has twice isn't frequent
            return pa.RecordBatch.from_arrays([pa.array(keys[many]), pa.array(n[many])], names=["key", "n"])

        size = 0
        for batch in batches:
            for _, s in document_sets(batch.column(0)):
                kept.append((s >> np.uint64(2)).astype(np.int64))
                size += len(kept[-1])
                if size > 1_000_000:
                    yield flush()
                    size = 0
        if kept:
            yield flush()

    rows = docs.select("text").mapInArrow(lean(counted), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    with small_batches(docs.sparkSession):
        told = rows.orderBy(F.desc("n"), "key").limit(most).select("key").toArrow()
    return np.sort(told.column(0).to_numpy())


def prefixes(docs: DataFrame, often: np.ndarray) -> DataFrame:
    """doc_id, tid, n, nid (of the set), gid (of size and prefix), last (the prefix's last key), keys (the prefix; null if the
    task has given this group's already, or the row has no id and takes no part) and cells (the histogram; null if given already)."""
    told = docs.sparkSession.sparkContext.broadcast(often)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, given, drawn = told.value, set(), set()

        def first(held: set, x: bytes) -> bool:
            new = x not in held
            if new and len(held) < 200_000:
                held.add(x)
            return new

        for batch in batches:
            valid = batch.column(0).is_valid().to_pylist()
            rows = []
            for k, s in document_sets(batch.column(2)):
                n = len(s)
                if not n:
                    rows.append((0, None, None, None, None, None))
                    continue
                keys = (s >> np.uint64(2)).astype(np.int64)
                if len(often):
                    at = np.searchsorted(often, keys)
                    hot = often[np.minimum(at, len(often) - 1)] == keys
                    keys = np.concatenate([keys[~hot], keys[hot] | _LAST])
                keys = keys[: prefix_size(n)]
                nid = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                group = hashlib.blake2b(keys.tobytes(), digest_size=16, salt=n.to_bytes(8, "little")).digest()
                gid = int.from_bytes(group[:8], "little", signed=True)
                rows.append((n, nid, gid, int(keys[-1]), keys if valid[k] and first(given, group) else None, histogram(s) if valid[k] and first(drawn, nid) else None))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary())
            more = [pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *more], names=["doc_id", "tid", "n", "nid", "gid", "last", "keys", "cells"])

    return docs.mapInArrow(lean(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, tid long, n long, nid binary, gid long, last long, keys array<long>, cells binary")


def _enough(common, n, m):
    return common * T_DEN >= T_NUM * (n + m - common)


def _may_link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs with sizes and histograms, those whose overlap may be enough."""
    for batch in batches:
        n, m = (np.asarray(batch.column(k)) for k in (2, 3))
        u, v = batch.column(4), batch.column(5)
        known = np.flatnonzero((np.asarray(pa.compute.binary_length(u)) == CELLS) & (np.asarray(pa.compute.binary_length(v)) == CELLS))
        keep = np.ones(batch.num_rows, bool)
        for at in np.array_split(known, -(-len(known) // 2048) or 1):
            x, y = (np.frombuffer(b"".join(c.take(pa.array(at)).to_pylist()), np.uint8).reshape(-1, CELLS) for c in (u, v))
            keep[at] = _enough(np.minimum(x, y).sum(1, dtype=np.int64), n[at], m[at])
        yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in batch.columns[:2]], names=["a", "b"])


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows a, part, b, text by a and part, a's own text (b is null) first: the pairs whose sets have the similarity."""
    at, own = None, np.zeros(0, np.uint64)
    for batch in batches:
        a, part, b = (batch.column(k).to_pylist() for k in range(3))
        found = []
        for k, s in document_sets(batch.column(3)):
            if b[k] is None:
                at, own = (a[k], part[k]), s
            elif at == (a[k], part[k]):
                n = len(np.intersect1d(own, s, assume_unique=True))
                if n and _enough(n, len(own), len(s)):
                    found.append((a[k], b[k]))
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in range(2)], names=["a", "b"])


def verified(docs: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose whole sets have the similarity. Only texts that the pairs left by the histograms name
    are read: their ids are broadcast while they are at most BROADCAST_IDS, else dealt like the texts."""
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("cells").alias(f"c_{x}"))
    drawn = pairs.distinct().join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "c_a", "c_b")
    likely = cut(drawn.mapInArrow(lean(_may_link), "a long, b long"))
    reps = cut(likely.select(F.col("a").alias("node")).union(likely.select("b")).distinct().join(nodes, "node").select("node", "rep.doc_id", "rep.tid"))
    many = reps.count()
    if not many:
        return likely
    reps = F.broadcast(reps) if many <= BROADCAST_IDS else reps.hint("shuffle_hash")
    texts = cut(docs.join(reps, ["doc_id", "tid"]).select("node", "text").dropDuplicates(["node"]))
    # The side with more partners gets the others' texts, at most about LEAVES in a part.
    parts = likely.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / LEAVES).cast("int").alias("parts"))
    dealt = likely.join(parts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), "b")
    leaves = dealt.join(texts.withColumnRenamed("node", "b"), "b").select("a", "part", "b", "text")
    heads = dealt.select("a", "part").distinct().join(texts.withColumnRenamed("node", "a"), "a").select("a", "part", F.lit(None).cast("long").alias("b"), "text")
    by = leaves.unionByName(heads).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").isNotNull())
    return by.mapInArrow(lean(_compared), "a long, b long")


def _relabel(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """nodes with comp after the links (between nodes) have joined components."""
    comp = nodes.select("node", "comp")
    ends = links.join(comp.select(F.col("node").alias("a"), F.col("comp").alias("ca")), "a").join(comp.select(F.col("node").alias("b"), F.col("comp").alias("cb")), "b")
    ends = cut(ends.select(F.col("ca").alias("a"), F.col("cb").alias("b")).where("a <> b").distinct())
    if ends.isEmpty():
        return nodes
    labels = components(ends)
    return cut(nodes.join(labels.select(F.col("node").alias("comp"), "label"), "comp", "left").withColumn("comp", F.coalesce("label", "comp")).select(nodes.columns))


def link_components(docs: DataFrame, most: int = FREQUENT, least: int = LEAST_FREQUENT) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links) of every row.

    Texts that are null or without words have 0 shingles and are linked with nothing. Equal texts are one set, however
    many rows have them. A row with a null doc_id takes no part and has no component; of rows that share a doc_id each
    goes by its own text. Ids may be of any type that has an order. A very long text is one set like others; an empty
    table gives no rows; other columns are left out.
    """
    docs = _rows(docs)
    rows = cut(prefixes(docs, frequent(docs, most, least)))
    known = rows.where(F.col("doc_id").isNotNull() & F.col("nid").isNotNull())
    once = known.groupBy("nid").agg(F.min(F.struct("doc_id", "tid")).alias("rep"), *[F.first(c, True).alias(c) for c in ("gid", "n", "last", "cells")])
    named = cut(once.withColumn("node", F.monotonically_increasing_id()))
    nodes = named.drop("nid").withColumn("comp", F.col("node"))
    links = nodes.select("node", "comp", "gid", "n", "last", "cells", "rep")

    # Prefix shingles that more than one group has. Dealt by the key once, into parts of bounded size: the smallest and largest
    # group of each and the join keep that partitioning, and the join builds its table of the shared ones only.
    total = known.agg(F.sum("n")).first()[0] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), total * (T_DEN - T_NUM) // T_DEN // PART_KEYS)
    keys = known.where(F.col("keys").isNotNull()).select("gid", F.explode("keys").alias("key")).repartition(parts, "key")
    several = keys.groupBy("key").agg(F.min("gid").alias("lo"), F.max("gid").alias("hi")).where("lo <> hi").select("key")
    keys = cut(keys.join(several.hint("shuffle_hash"), "key").select("gid", "key").distinct())
    many = keys.groupBy("key").agg(F.count(F.lit(1)).alias("groups"))
    # h: how many of a group's are hot, rank: how many up to this one, score: how common they are.
    own, hot = Window.partitionBy("gid"), (F.col("groups") > HOT).cast("int")
    shared = keys.join(many, "key").select("gid", "key", hot.alias("hot"), F.log2("groups").alias("weight"))
    shared = shared.select("gid", "key", "hot", F.sum("hot").over(own).alias("h"), F.sum("hot").over(own.orderBy("key")).alias("rank"), F.sum("weight").over(own).alias("score"))
    shared = cut(shared)

    # Members with the first of their group.
    first = nodes.groupBy("gid").agg(F.min("node").alias("a"))
    pairs = nodes.select("gid", F.col("node").alias("b")).join(first, "gid").where("a <> b").select("a", "b")
    nodes = _relabel(links, verified(docs, links, pairs))

    def units() -> DataFrame:
        """The shared shingles of each group and component."""
        unit = nodes.groupBy("gid", "n", "last", "comp").agg(F.min("node").alias("node"))
        return shared.join(unit, "gid")

    fits = (F.col("x.n") * T_DEN >= F.col("y.n") * T_NUM) & (F.col("y.n") * T_DEN >= F.col("x.n") * T_NUM)

    def can(n_keys: Column, nx: str = "nx", lx: str = "lx", ny: str = "ny", ly: str = "ly") -> Column:
        """Whether two sets can be similar: at most they share n_keys prefix shingles and the rest of the set whose prefix ends first."""
        nx, lx, ny, ly = (F.col(c) for c in (nx, lx, ny, ly))
        x_rest, y_rest = F.ceil(nx * T_NUM / T_DEN) - 1, F.ceil(ny * T_NUM / T_DEN) - 1
        rest = F.when(lx < ly, x_rest).when(lx > ly, y_rest).otherwise(F.least(x_rest, y_rest))
        return (n_keys + rest) * (T_NUM + T_DEN) >= T_NUM * (nx + ny)

    # Each group with a few pivots.
    held = units().select("key", "node", "n", "comp", (F.col("score") / F.col("n")).alias("score"))
    half = PIVOTS // 2
    by = lambda order: F.struct(order.cast("double").alias("order"), "node", "n", "comp")
    chance = lambda k: F.xxhash64(F.col("node"), F.lit(k))
    picks = [F.min(F.when(F.pmod(chance(0), F.lit(half)) == k, by(-F.col("score")))) for k in range(half)] + [F.min(by(chance(k))) for k in range(half, PIVOTS)]
    stars = held.groupBy("key").agg(F.array_compact(F.array(*picks)).alias("stars"))
    other = lambda x: (x["comp"] != F.col("comp")) & (x["n"] * T_DEN >= F.col("n") * T_NUM) & (F.col("n") * T_DEN >= x["n"] * T_NUM)
    near = held.join(stars, "key").select(F.col("node").alias("b"), F.col("n").alias("nb"), F.explode(F.array_distinct(F.transform(F.filter("stars", other), lambda x: x["node"]))).alias("a"))
    votes = near.groupBy("b", "a").agg(F.count(F.lit(1)).alias("c"), F.first("nb").alias("nb")).where(F.col("c") * 20 >= F.col("nb") * (T_DEN - T_NUM) / T_DEN)
    best = votes.groupBy("b").agg(F.slice(F.sort_array(F.collect_list(F.struct("c", "a")), False), 1, PARTNERS).alias("best"))
    nodes = _relabel(nodes, verified(docs, nodes, best.select(F.explode("best.a").alias("a"), "b")))

    # All pairs that are left between components, by the shingles that are in several.
    held = units().select("key", "hot", "h", "rank", "gid", "n", "last", "comp")
    mixed = held.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
    held = cut(held.join(mixed, "key"))
    cold, hot = held.where("hot = 0").drop("rank"), held.where("hot = 1")
    ends = [F.col(f"{s}.{c}").alias(f"{t}{s}") for s in "xy" for c, t in (("gid", "g"), ("comp", "c"), ("n", "n"), ("last", "l"), ("h", "h"))]
    apart = (F.col("x.key") == F.col("y.key")) & (F.col("x.comp") != F.col("y.comp")) & fits
    met = cold.alias("x").join(cold.alias("y"), apart & (F.col("x.gid") < F.col("y.gid")))
    by_cold = met.groupBy(*ends).agg(F.count(F.lit(1)).alias("shared")).where(can(F.col("shared") + F.least("hx", "hy")))
    # Of two components at least one isn't the shingle's largest.
    major = hot.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("size")).groupBy("key").agg(F.max_by("comp", F.struct("size", "comp")).alias("major"))
    hot = hot.join(major, "key")
    minor = hot.where(F.col("comp") != F.col("major"))
    once = (F.col("x.gid") != F.col("y.gid")) & ((F.col("y.comp") == F.col("y.major")) | (F.col("x.gid") < F.col("y.gid")))
    # At the first hot shingle that a pair shares, it can share only this and those after it in either set.
    ahead = F.least(F.col("x.h") - F.col("x.rank"), F.col("y.h") - F.col("y.rank")) + 1
    by_hot = minor.alias("x").join(hot.alias("y"), apart & once & can(ahead, "x.n", "x.last", "y.n", "y.last")).select(*ends)
    found = by_cold.select("gx", "cx", "gy", "cy").union(by_hot.select("gx", "cx", "gy", "cy")).distinct()
    member = nodes.select("gid", "comp", "node")
    pairs = found.join(member.toDF("gx", "cx", "a"), ["gx", "cx"]).join(member.toDF("gy", "cy", "b"), ["gy", "cy"]).select("a", "b")
    split = nodes.groupBy("gid").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("gid")
    torn = member.join(split, "gid")
    within = torn.alias("x").join(torn.alias("y"), (F.col("x.gid") == F.col("y.gid")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.comp") != F.col("y.comp"))).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    nodes = _relabel(nodes, verified(docs, nodes, pairs.union(within)))

    least_id = nodes.groupBy("comp").agg(F.min("rep.doc_id").alias("component_id"))
    labels = named.select("nid", "node").join(nodes.select("node", "comp"), "node").join(least_id, "comp").select("nid", "component_id")
    out = rows.select("doc_id", "nid", F.col("n").alias("n_shingles")).join(labels, "nid", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """All columns of one row per component: that with its smallest doc_id. Rows that share this id all stay.

    Rows without an id or without words stay. Columns of any name are kept as they are."""
    found = cut(link_components(docs))
    gone = found.where("component_id <> doc_id").select("doc_id").distinct()
    return docs.alias("d").join(gone.hint("shuffle_hash").alias("g"), F.col("d.doc_id") == F.col("g.doc_id"), "left_anti")
