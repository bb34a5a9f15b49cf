"""Benchmark decontamination: which documents hold a window of words that nearly repeats a benchmark item.

Windows have the item's number of words, so that an item is compared with passages of its own size. Only windows that
share a shingle with an item can be similar to it at all; they get a SimHash of their shingles, whose blocks are joined with
those of the items that they share a shingle with (one block more than the radius: any fingerprint within it agrees in a whole
block), and the pairs within the radius are verified by the exact weighted Jaccard similarity of their shingle counts.
DataFrame functions only. Shared shingles are looked up in a broadcast table only while that table has at most
BROADCAST_ROWS rows; beyond, it is an ordinary join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatrix.llm.common import cut

SHINGLE = 5
THRESHOLD = 0.75
RADIUS = 23  # of 64 bits: a pair at the threshold is farther apart with a chance of about 3 in 100,000
BROADCAST_ROWS = 500_000
BLOCKS = RADIUS + 1
_WIDTHS = [64 // BLOCKS + (k < 64 % BLOCKS) for k in range(BLOCKS)]
_LANES = 32  # two counters in each long


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.array_remove(F.split(F.lower(text.cast("string")), r"[^\p{L}\p{N}]+"), "")


def shingles(tokens: Column, k: int) -> Column:
    """Hashes of the k-word shingles, in order, repeats kept; none if there are fewer words."""
    n = F.size(tokens) - k + 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.xxhash64(F.slice(tokens, i, F.lit(k)))))


def _lane(h: Column, q: int) -> Column:
    return F.shiftrightunsigned(h, 2 * q).bitwiseAND(F.lit(1)) + F.shiftleft(F.shiftrightunsigned(h, 2 * q + 1).bitwiseAND(F.lit(1)), 32)


def simhash(grouped, h: Column) -> DataFrame:
    """SimHash over the rows of each group: bit b is set if more than half of the hashes have it."""
    sums = grouped.agg(F.count(F.lit(1)).alias("_m"), *[F.sum(_lane(h, q)).alias(f"_s{q}") for q in range(_LANES)])
    bits = []
    for q in range(_LANES):
        for half in range(2):
            n = F.shiftrightunsigned(F.col(f"_s{q}"), 32 * half).bitwiseAND(F.lit(0xFFFFFFFF))
            bits.append(F.shiftleft((n * 2 > F.col("_m")).cast("long"), 2 * q + half))
    return sums.withColumn("fp", reduce(lambda a, b: a.bitwiseOR(b), bits)).drop("_m", *[f"_s{q}" for q in range(_LANES)])


def blocks(fp: Column) -> Column:
    """(block, value) pairs that the fingerprint has."""
    out, at = [], 0
    for k, w in enumerate(_WIDTHS):
        out.append((F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << w) - 1)) + (k << 8)).cast("int"))
        at += w
    return F.array(*out)


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def matches(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, radius: int = RADIUS) -> DataFrame:
    """doc_id, item_id, similarity, start (in words) and words of the best window, for each document and item at or over the threshold.

    Null and empty texts match nothing. An item of fewer than five words is compared by its whole sequence of words. A
    document shorter than the item is one window. Repeated rows or ids count as one document; a null id is one too. Items
    go by their words; of different texts with one item_id the most similar counts, and a null item_id is one too. A very long
    text is a row like others: its shingles are one array.
    """
    docs = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull())
    told = benchmark.select(F.col("item_id").alias("item_id"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    told = cut(told.select("item_id", "w", F.xxhash64("w").alias("item"), F.size("w").alias("size"), F.least(F.size("w"), F.lit(SHINGLE)).alias("k")))
    items, ids = told.drop("item_id").dropDuplicates(["item"]), told.select("item", "item_id").distinct()
    ks = sorted(r["k"] for r in items.select("k").distinct().collect())  # at most five values
    if not ks:
        return docs.sparkSession.createDataFrame([], f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id {told.schema['item_id'].dataType.simpleString()}, similarity double, start int, words int")
    each = reduce(DataFrame.unionByName, [items.where(F.col("k") == k).select("item", "size", "k", F.explode(shingles(F.col("w"), k)).alias("h")) for k in ks])
    counted = cut(each.groupBy("item", "size", "k", "h").agg(F.count(F.lit(1)).alias("n")))
    many = counted.count()
    known = counted.select("k", "h", "item", "size")
    by_hash = known.select("k", "h").distinct()
    keyed = docs.withColumn("key", F.xxhash64("text"))

    # 1. Where documents share a shingle with an item.
    anchors = []
    for k in ks:
        one = keyed.select("doc_id", "key", words(F.col("text")).alias("w")).select("doc_id", "key", F.size("w").alias("n"), F.posexplode(shingles(F.col("w"), k)).alias("pos", "h"))
        anchors.append(one.join(_small(by_hash.where(F.col("k") == k).drop("k"), many), "h").select("doc_id", "key", "n", "pos", "h", F.lit(k).alias("k")))
    anchors = cut(reduce(DataFrame.unionByName, anchors))
    met = anchors.join(_small(known, many), ["k", "h"])

    # 2. All windows of the item's size that hold such a shingle, and their fingerprints.
    last = F.greatest(F.col("n") - F.col("size"), F.lit(0))
    first = F.least(F.greatest(F.col("pos") - F.col("size") + F.col("k"), F.lit(0)), last)
    starts = cut(met.select("doc_id", "key", "size", "k", "item", F.explode(F.sequence(first, F.greatest(F.least(F.col("pos"), last), first))).alias("start")).distinct())
    holders = anchors.select(F.col("key").alias("_key"), F.col("k").alias("_k")).distinct()
    texts = keyed.join(holders.select("_key").distinct().hint("shuffle_hash"), F.col("key") == F.col("_key"), "left_semi").dropDuplicates(["doc_id", "key"]).select("doc_id", "key", words(F.col("text")).alias("w"))
    rows = cut(reduce(DataFrame.unionByName, [texts.select("doc_id", "key", F.lit(k).alias("k"), shingles(F.col("w"), k).alias("hs")).where(F.col("hs").isNotNull()) for k in ks]))

    def with_shingles(windows: DataFrame) -> DataFrame:
        a, b = windows.alias("a"), rows.alias("b")
        cond = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.k") == F.col("b.k"))
        return a.join(b, cond).select("a.*", F.explode(F.slice("b.hs", F.col("a.start") + 1, F.greatest(F.col("a.size") - F.col("a.k") + 1, F.lit(1)))).alias("h"))

    prints = simhash(with_shingles(starts.drop("item").distinct()).groupBy("doc_id", "key", "size", "k", "start"), F.col("h"))
    item_prints = simhash(counted.withColumn("h", F.explode(F.expr("array_repeat(h, int(n))"))).groupBy("item", "size", "k"), F.col("h"))

    # 3. Windows and items that share a shingle and agree in a block, within the radius.
    window = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) if c == "doc_id" else F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("doc_id", "key", "size", "k", "start")]
    a = starts.alias("a").join(prints.alias("b"), reduce(Column.__and__, window)).select("a.*", "b.fp").select("*", F.explode(blocks(F.col("fp"))).alias("block"))
    b = item_prints.select("item", F.col("fp").alias("item_fp"), F.explode(blocks(F.col("fp"))).alias("block"))
    near = a.join(_small(b, many), ["item", "block"]).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius)
    near = near.select("doc_id", "key", "size", "k", "start", "item").distinct()

    # 4. Exact weighted similarity.
    held = with_shingles(near).groupBy("doc_id", "key", "size", "k", "start", "item", "h").agg(F.count(F.lit(1)).alias("c"))
    n_item = F.col("size") - F.col("k") + 1
    pairs = held.join(_small(counted.select("item", "h", F.col("n").alias("c2"), F.col("size").alias("size2")), many).withColumnRenamed("size2", "size"), ["item", "h", "size"], "left")
    sums = pairs.groupBy("doc_id", "size", "k", "start", "item", "key").agg(F.sum("c").alias("n_window"), F.sum(F.least("c", F.coalesce("c2", F.lit(0)))).alias("shared"))
    scored = sums.withColumn("similarity", F.col("shared").cast("double") / (F.col("n_window") + n_item - F.col("shared"))).where(F.col("similarity") >= threshold)
    best = scored.join(_small(ids, many), "item").groupBy("doc_id", "item_id").agg(F.max("similarity").alias("similarity"), F.max_by(F.struct(F.col("start"), F.col("size")), F.struct(F.col("similarity"), -F.col("start"), -F.col("size"))).alias("at"))
    return best.select("doc_id", "item_id", "similarity", F.col("at.start").alias("start"), F.col("at.size").alias("words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows without a match, all columns, whatever their names. Rows whose id is null stay; so do null, empty and repeated rows without a match."""
    bad = cut(matches(docs, benchmark, threshold).select("doc_id").where(F.col("doc_id").isNotNull()).distinct())
    return docs.alias("d").join(bad.hint("shuffle_hash").alias("b"), F.col("d.doc_id") == F.col("b.doc_id"), "left_anti")
