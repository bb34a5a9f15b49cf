"""Exact and look-alike duplicates."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatrix.functions.scalars import path_key
from curatrix.operators.rules import plan_counter
from curatrix.operators.tables import materialized

MAX_FULL = 200
BANDS = 5  # of the dhash's bits
BANDED_ROWS = 4096
MOST_REACH = 4  # bits that a band may differ in
PART_ROWS = 1 << 18  # of a block, that meet another part's in one task
PLAIN_ROWS = 1 << 15  # the same, where limits are too wide for bands
AT_ONCE = 1 << 17  # hashes that are compared at once, and pairs in a batch
CELL_PAIRS = 1 << 13  # from here on the rows of a value are compared apart
MET = "_l long, _r long, phash_bits int, dhash_bits int"
Places = Iterator[tuple[np.ndarray, np.ndarray]]


def duplicate_groups(catalog: DataFrame) -> DataFrame:
    """digest, path, n, place: a row per file of each digest that more than one file has, with its place in order of path.

    A group is rows, not an array, and its places come from range partitions, so that no group meets in one task."""
    many = catalog.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = plan_counter(catalog.join(many, "digest").select("digest", "path", "n"), ["digest", "path"], "_at")
    first = rows.groupBy("digest").agg(F.min("_at").alias("_first"))
    return rows.join(first, "digest").select("digest", "path", "n", (F.col("_at") - F.col("_first") + 1).alias("place"))


def staged(catalog: DataFrame, keys: tuple[str, ...] = ("size", "digest")) -> DataFrame:
    """Rows whose keys others have too, key by key: each stage shuffles only what the one before left."""
    held: list[str] = []
    for k in keys:
        held.append(k)
        many = catalog.groupBy(*held).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
        catalog = catalog.join(many, held, "left_semi")
    return catalog


def duplicate_pairs(catalog: DataFrame, max_full: int = MAX_FULL) -> DataFrame:
    """All pairs of groups up to max_full files; of larger ones the first file with each other, and neighbours: 2n - 3 pairs."""
    rows = materialized(duplicate_groups(catalog))
    small, big = rows.where(F.col("n") <= max_full), rows.where(F.col("n") > max_full)
    pair = lambda truncated: [F.col("l.digest").alias("digest"), F.col("l.path").alias("left_path"), F.col("r.path").alias("right_path"), F.lit(truncated).alias("truncated")]
    l, r = small.alias("l"), small.alias("r")
    full = l.join(r, (F.col("l.digest") == F.col("r.digest")) & (F.col("l.place") < F.col("r.place"))).select(*pair(False))
    l, r = big.alias("l"), big.alias("r")
    star = big.where("place = 1").alias("l").join(r, (F.col("l.digest") == F.col("r.digest")) & (F.col("r.place") > 1)).select(*pair(True))
    near = l.join(r, (F.col("l.digest") == F.col("r.digest")) & (F.col("l.place") + 1 == F.col("r.place"))).where(F.col("l.place") > 1).select(*pair(True))
    return full.unionByName(star).unionByName(near)


def representatives(catalog: DataFrame) -> DataFrame:
    return catalog.groupBy("digest").agg(F.min("path").alias("path"), F.count(F.lit(1)).alias("copies"))


def find_duplicates(incoming: DataFrame, library: DataFrame) -> DataFrame:
    """Library files with the content of an incoming file: equal size, then equal sample (where both tables have one), then
    equal digest; the incoming paths themselves don't count. Each stage shuffles only what the one before left."""
    others = library.withColumn("_key", path_key(F.col("path"))).join(incoming.select(path_key(F.col("path")).alias("_key")), "_key", "left_anti")
    keys = ["size", *(["sample"] if "sample" in incoming.columns and "sample" in library.columns else [])]
    for k in range(1, len(keys) + 1):
        others = others.join(incoming.select(keys[:k]).distinct(), keys[:k], "left_semi")
    keys.append("digest")
    return incoming.select(F.col("path").alias("incoming_path"), *keys).join(others.select(F.col("path").alias("library_path"), *keys), keys).select("incoming_path", "library_path", "digest")


SIGNED = ("path", "size", "modified_at", "digest", "identity", "created_ticks", "modified_ticks")


def pair_signature(pairs: DataFrame, columns: tuple[str, ...] = SIGNED) -> DataFrame:
    """pairs (left_*, right_*) with a signature of each side's path key and the other columns, whichever side comes first. A changed file has another."""
    told = lambda s, c: path_key(F.col(f"{s}_path")) if c == "path" else F.coalesce(F.col(f"{s}_{c}").cast("string"), F.lit(""))
    side = lambda s: F.concat_ws("|", *[told(s, c) for c in columns])
    return pairs.withColumn("signature", F.sha2(F.concat_ws("\n", F.array_sort(F.array(side("left"), side("right")))), 256))


def drop_dismissed(pairs: DataFrame, dismissed: DataFrame) -> DataFrame:
    return pairs.join(dismissed.select("signature"), "signature", "left_anti")


def ignored_count(pairs: DataFrame, dismissed: DataFrame) -> DataFrame:
    """How many of the pairs are dismissed."""
    return pairs.join(dismissed.select("signature").distinct(), "signature", "left_semi").agg(F.count(F.lit(1)).alias("ignored"))


def dismiss(dismissed: DataFrame, pairs: DataFrame) -> DataFrame:
    return dismissed.select("signature").union(pairs.select("signature")).distinct()


def retire_pair(pairs: DataFrame, retired: str) -> DataFrame:
    """The pairs that don't name the retired path."""
    key = F.lit(retired.replace("\\", "/").lower())
    return pairs.where((path_key(F.col("left_path")) != key) & (path_key(F.col("right_path")) != key))


def check_retirement(choices: DataFrame, catalog: DataFrame, protected: DataFrame) -> DataFrame:
    """choices (path): MEDIA_PROTECTED where the content that would go is protected, FILE_CHANGED where the path isn't there, else null."""
    now = catalog.select(path_key(F.col("path")).alias("_key"), "digest").join(protected.select("digest").distinct().withColumn("_p", F.lit(True)), "digest", "left")
    held = choices.withColumn("_key", path_key(F.col("path"))).join(now.withColumn("_here", F.lit(True)), "_key", "left")
    return held.select("path", F.when(F.col("_here").isNull(), "FILE_CHANGED").when(F.col("_p"), "MEDIA_PROTECTED").alias("error"))


def plan_cleanup(catalog: DataFrame, keepers: DataFrame, most: int = 10_000) -> DataFrame:
    """keepers (digest, path): a backup move for each other member; INVALID_GROUP where the keeper isn't in its group, or that has not 2 to `most` members."""
    group = catalog.join(keepers.select("digest", F.col("path").alias("keeper")), "digest")
    held = group.groupBy("digest").agg(F.count_if(F.col("path") == F.col("keeper")).alias("_k"), F.count(F.lit(1)).alias("_n"))
    return group.join(held, "digest").where("path <> keeper").select("digest", "path", "keeper", F.lit("move").alias("action"), F.lit(True).alias("backup"), F.when((F.col("_k") != 1) | ~F.col("_n").between(2, most), "INVALID_GROUP").alias("error"))


def bands(prints: DataFrame, n: int = BANDS) -> list[list[int]]:
    """The dhash's bits dealt to n bands, so that each has as many of the even and of the lopsided ones: counted over the prints."""
    bit = lambda k: F.sum(F.shiftrightunsigned("dhash", k).bitwiseAND(F.lit(1).cast("long"))).alias(str(k))
    told = prints.agg(F.count(F.lit(1)).alias("n"), *[bit(k) for k in range(64)]).first()
    order = sorted(range(64), key=lambda k: (abs(2 * (told[str(k)] or 0) - told["n"]), k))
    return [sorted(order[k::n]) for k in range(n)]


def _near(left: np.ndarray, right: np.ndarray, most: int) -> Places:
    """Places of left and right hashes that differ in `most` bits at most, some at a time."""
    step = max(1, AT_ONCE // max(1, len(right)))
    for k in range(0, len(left) if len(right) else 0, step):
        i, j = np.divmod(np.flatnonzero(np.bitwise_count(left[k : k + step, None] ^ right[None]) <= most), len(right))
        yield i + k, j


def _near_by_band(left: np.ndarray, right: np.ndarray, most: int, bits: list[int], reach: int) -> Places:
    """The same of those that differ in `reach` bits of the band at most: a row meets the runs of rows whose values are so near to its own."""
    value = lambda h: sum((h >> np.uint64(b) & np.uint64(1)).astype(np.int64) << j for j, b in enumerate(bits))
    runs = lambda start, n: np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())
    lv, rv = value(left), value(right)
    lo, ro = np.argsort(lv, kind="stable"), np.argsort(rv, kind="stable")
    left, right = left[lo], right[ro]
    values, first, size = np.unique(lv[lo], return_index=True, return_counts=True)
    masks = np.array([sum(1 << j for j in c) for n in range(reach + 1) for c in combinations(range(len(bits)), n)])
    ends = np.searchsorted(rv[ro], np.arange((1 << len(bits)) + 1)).astype(np.int32)
    start = ends[values[:, None] ^ masks]
    n = ends[(values[:, None] ^ masks) + 1] - start
    met = n.sum(1)
    apart = size * met >= CELL_PAIRS
    for k in np.flatnonzero(apart):
        at = runs(start[k], n[k])
        for i, j in _near(left[first[k] : first[k] + size[k]], right[at], most):
            yield lo[first[k] + i], ro[at[j]]
    which = np.repeat(np.arange(len(values)), size)
    rows = np.flatnonzero(~apart[which])
    which = which[rows]
    batch = np.cumsum(met[which] + len(masks)) // AT_ONCE
    for r in np.split(np.arange(len(rows)), np.flatnonzero(np.diff(batch)) + 1):
        at = runs(start[which[r]].ravel(), n[which[r]].ravel())
        i = np.repeat(rows[r], met[which[r]])
        ok = np.flatnonzero(np.bitwise_count(left[i] ^ right[at]) <= most)
        yield lo[i[ok]], ro[at[ok]]


def _batched(near: Places) -> Places:
    out, held = [], 0
    for i, j in near:
        if len(i):
            out.append((i, j))
            held += len(i)
        if held >= AT_ONCE:
            yield np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])
            out, held = [], 0
    if out:
        yield np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])


def _tiles(light: DataFrame, banded_rows: int, n_bands: int) -> DataFrame:
    """What has to meet: la, lc, li (a part of a block), ra, rc, ri (one of the same block or of a neighbour), the band (-1: none) and a
    number. Each pair of parts is there once, in every band where one of the blocks has over banded_rows rows."""
    parts = F.ceil(F.col("_n") / (PART_ROWS if n_bands else PLAIN_ROWS)).cast("int")
    blocks = materialized(light.groupBy("_a", "_c").agg(F.count(F.lit(1)).alias("_n")).withColumn("_parts", parts))
    around = F.array(*[F.struct((F.col("_a") + i).alias("ra"), (F.col("_c") + j).alias("rc")) for i, j in ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1))])
    l = blocks.select(F.col("_a").alias("la"), F.col("_c").alias("lc"), F.col("_n").alias("ln"), F.col("_parts").alias("lp"), F.explode(around).alias("_b")).select("*", "_b.*").drop("_b")
    r = blocks.select(F.col("_a").alias("ra"), F.col("_c").alias("rc"), F.col("_n").alias("rn"), F.col("_parts").alias("rp"))
    dealt = F.when(F.greatest("ln", "rn") > banded_rows, F.array(*[F.lit(k) for k in range(n_bands)])).otherwise(F.array(F.lit(-1))) if n_bands else F.array(F.lit(-1))
    each = l.join(r, ["ra", "rc"]).withColumn("li", F.explode(F.sequence(F.lit(0), F.col("lp") - 1))).withColumn("ri", F.explode(F.sequence(F.lit(0), F.col("rp") - 1)))
    own = (F.col("la") == F.col("ra")) & (F.col("lc") == F.col("rc"))
    each = each.where(~own | (F.col("li") <= F.col("ri"))).withColumn("alone", own & (F.col("li") == F.col("ri")))
    return materialized(each.select("la", "lc", "li", "lp", "ra", "rc", "ri", "rp", "alone", F.explode(dealt).alias("band")).withColumn("tile", F.monotonically_increasing_id()))


def similar_images(prints: DataFrame, phash_max: int = 16, dhash_max: int = 14, aspect_max: float = 0.04, color_max: int = 24, banded_rows: int = BANDED_ROWS) -> DataFrame:
    """Pairs of look-alike digests from prints (digest, phash, dhash, aspect, colors: array<int>).

    Images meet as rows of an id and the two hashes; shapes and colours are fetched for the pairs that are left. Nothing is lost: sizes
    within aspect_max differ by one class at most, and so do mean colours within color_max, so that a block of a class of each meets itself
    and its neighbours, in parts of a bounded size. In blocks over banded_rows only rows meet that are near in a band of the dhash: of a
    pair within dhash_max bits one band differs in dhash_max / BANDS at most, and the first of these gives it (limits over 24 bits have
    no bands)."""
    step = -math.log(1 - aspect_max)
    mean = F.aggregate("colors", F.lit(0), lambda a, x: a + x) / F.size("colors")
    base = prints.dropDuplicates(["digest"]).select("digest", "phash", "dhash", "aspect", "colors", F.floor(F.log("aspect") / step).alias("_a"), F.floor(mean / color_max).alias("_c"))
    base = materialized(base.dropna(subset=["digest", "phash", "dhash", "_a", "_c"]).withColumn("id", F.monotonically_increasing_id()))
    light = base.select("id", "phash", "dhash", "_a", "_c")
    reach = dhash_max // BANDS
    tiles = _tiles(light, banded_rows, BANDS if reach <= MOST_REACH else 0)
    dealt_bits = [] if tiles.where("band >= 0").isEmpty() else bands(light)
    whole_bands = [np.uint64(sum(1 << b for b in bits)) for bits in dealt_bits]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(batches, ignore_index=True)
        band, side = int(rows["band"].iloc[0]), rows["side"].to_numpy()
        l, r = [(p["id"].to_numpy(), p["phash"].to_numpy().view(np.uint64), p["dhash"].to_numpy().view(np.uint64)) for p in (rows[side != 1], rows[side != 0])]
        near = _near(l[2], r[2], dhash_max) if band < 0 else _near_by_band(l[2], r[2], dhash_max, dealt_bits[band], reach)
        for i, j in _batched(near):
            p, d = np.bitwise_count(l[1][i] ^ r[1][j]), l[2][i] ^ r[2][j]
            ok = p <= phash_max
            if side[0] == 2:
                ok &= l[0][i] < r[0][j]
            for mask in whole_bands[: max(band, 0)]:
                ok &= np.bitwise_count(d & mask) > reach
            yield pd.DataFrame({"_l": l[0][i[ok]], "_r": r[0][j[ok]], "phash_bits": p[ok].astype(np.int32), "dhash_bits": np.bitwise_count(d[ok]).astype(np.int32)})

    def dealt(s: str, what: DataFrame, side: Column) -> DataFrame:
        """The rows of the tiles' left or right parts, by tile."""
        here = F.broadcast(what.select("tile", "band", side.alias("side"), *[F.col(f"{s}{c}").alias(f"_{c}") for c in "acip"]))  # few: pairs of blocks and parts
        part = F.pmod(F.xxhash64("id"), F.col("_p")).cast("int") == F.col("_i")
        return light.join(here, ["_a", "_c"]).where(part).select("tile", "band", "side", "id", "phash", "dhash")

    rows = dealt("l", tiles, F.when(F.col("alone"), 2).otherwise(0)).union(dealt("r", tiles.where(~F.col("alone")), F.lit(1)))
    tasks = max(1, min(tiles.count(), 8 * light.sparkSession.sparkContext.defaultParallelism))  # a number of its own: rows are few for the work
    met = rows.repartition(tasks, "tile").groupBy("tile").applyInPandas(run, MET)
    side = lambda s: base.select(F.col("id").alias(f"_{s[0]}"), *[F.col(c).alias(f"{s}_{c}") for c in ("digest", "aspect", "colors")])
    whole = met.join(side("left"), "_l").join(side("right"), "_r")
    close = F.abs(F.col("left_aspect") - F.col("right_aspect")) / F.greatest("left_aspect", "right_aspect") <= aspect_max
    diff = F.aggregate(F.zip_with("left_colors", "right_colors", lambda x, y: F.abs(x - y)), F.lit(0), lambda a, x: a + x)
    digests = [f("left_digest", "right_digest").alias(f"{s}_digest") for f, s in ((F.least, "left"), (F.greatest, "right"))]
    return whole.where(close & (diff <= color_max * F.size("left_colors"))).select(*digests, "phash_bits", "dhash_bits")


def dhash_bits(pixels: Column, width: int = 9, height: int = 8) -> Column:
    """Bit y * (width - 1) + x is set where a pixel is brighter than the next, of row-major grey values."""
    bit = lambda i: F.element_at(pixels, i // (width - 1) * width + i % (width - 1) + 1) > F.element_at(pixels, i // (width - 1) * width + i % (width - 1) + 2)
    return reduce(Column.bitwiseOR, [F.shiftleft(bit(i).cast("long"), i) for i in range((width - 1) * height)])
