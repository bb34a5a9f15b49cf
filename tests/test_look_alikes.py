"""Look-alike images: parts of blocks that meet in tasks."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from curatrix.operators import dedup

SCHEMA = "digest string, phash long, dhash long, aspect double, colors array<int>"


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def near(rng, h, most):
    for i in rng.sample(range(64), rng.randrange(most)):
        h ^= 1 << i
    return h


def prints(n=30):
    rng, out = random.Random(3), []
    for k in range(n):
        p, d, aspect, grey = rng.getrandbits(64), rng.getrandbits(64), rng.choice([0.99, 1.0, 1.03, 1.07, 1.3]), rng.choice([20, 22, 26, 47, 49, 70])
        for m in range(5):
            out.append((f"{k}-{m}", signed(near(rng, p, 13)), signed(near(rng, d, 12)), aspect * rng.choice([1.0, 1.01, 1.035]), [grey + rng.randrange(25) for _ in range(4)]))
    return [*out, (None, 0, 0, 1.0, [20]), ("a", None, 0, 1.0, [20]), ("b", 0, None, 1.0, [20]), ("c", 0, 0, None, [20]), ("d", 0, 0, 1.0, None)]


def look_alikes(rows, dhash_max):
    bits = lambda x, y: ((x ^ y) & (1 << 64) - 1).bit_count()
    whole = [r for r in rows if None not in r]
    pairs = [(a, b, bits(a[1], b[1]), bits(a[2], b[2])) for a in whole for b in whole if a[0] < b[0]]
    fits = lambda a, b: abs(a[3] - b[3]) / max(a[3], b[3]) <= 0.04 and sum(abs(x - y) for x, y in zip(a[4], b[4])) <= 24 * len(a[4])
    return sorted((a[0], b[0], p, d) for a, b, p, d in pairs if p <= 16 and d <= dhash_max and fits(a, b))


@pytest.mark.parametrize(("banded_rows", "dhash_max"), [(4, 14), (10, 3), (1000, 14), (4, 30)])
def test_parts_and_bands_give_each_pair_once(spark, monkeypatch, banded_rows, dhash_max):
    monkeypatch.setattr(dedup, "PART_ROWS", 9)
    monkeypatch.setattr(dedup, "PLAIN_ROWS", 7)
    rows = prints()
    got = dedup.similar_images(spark.createDataFrame(rows, SCHEMA), banded_rows=banded_rows, dhash_max=dhash_max).collect()
    want = look_alikes(rows, dhash_max)
    assert sorted(map(tuple, got)) == want and want


def test_no_images_have_no_pairs(spark):
    assert dedup.similar_images(spark.createDataFrame([], SCHEMA)).collect() == []


def test_an_image_is_not_dealt_to_flipped_keys(spark):
    found = dedup.similar_images(spark.createDataFrame(prints(), SCHEMA), banded_rows=4)
    assert "Generate" not in found._jdf.queryExecution().toString()


def test_parts_grow_with_the_rows_and_meet_once(spark, monkeypatch):
    monkeypatch.setattr(dedup, "PART_ROWS", 100)
    light = spark.range(1000).select("id", F.lit(5).cast("long").alias("_a"), (F.col("id") % 2).alias("_c"))
    tiles = dedup._tiles(light, 10, dedup.BANDS)
    assert tiles.count() == dedup.BANDS * (2 * (5 * 6 // 2) + 5 * 5) == tiles.select("la", "lc", "li", "ra", "rc", "ri", "band").distinct().count()


@pytest.mark.parametrize("cell", [1, 1 << 30])
def test_runs_of_a_band_equal_all_pairs(monkeypatch, cell):
    monkeypatch.setattr(dedup, "CELL_PAIRS", cell)
    monkeypatch.setattr(dedup, "AT_ONCE", 500)
    rng = np.random.default_rng(5)
    left, bits = rng.integers(0, 1 << 63, 700, dtype=np.uint64), [1, 5, 8, 13, 40, 62]
    right = np.concatenate([left[:300] ^ (np.uint64(1) << np.uint64(13)), rng.integers(0, 1 << 63, 400, dtype=np.uint64)])
    got = [(int(i), int(j)) for a, b in dedup._near_by_band(left, right, 24, bits, 2) for i, j in zip(a, b)]
    x = left[:, None] ^ right[None]
    ok = (np.bitwise_count(x) <= 24) & (np.bitwise_count(x & np.uint64(sum(1 << b for b in bits))) <= 2)
    assert sorted(got) == list(zip(*(w.tolist() for w in np.nonzero(ok)))) and len(got) > 300
    assert list(dedup._batched(dedup._near_by_band(left[:0], right, 24, bits, 2))) == []
