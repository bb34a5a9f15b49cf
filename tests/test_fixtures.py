"""Small literal cases."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from curatrix.functions import names, scalars, signals
from curatrix.operators import dedup, rules
from curatrix.plans import resolve
from curatrix.sources import catalog
from curatrix.streaming import stable


def test_ambiguous_and_old_files(spark):
    some = [rules.DateRule("1", "P1", "2026-02-01", "2026-04-30", "/1", "created"), rules.DateRule("3", "P3", "2026-08-01", "2026-11-30", "/3", "modified"), rules.DateRule("0", "P0", "1960-08-01", "1960-11-30", "/0", "modified")]
    day = dt.date.fromisoformat
    files = spark.createDataFrame([("both", day("2026-02-06"), day("2026-09-21")), ("last", day("2020-01-01"), day("2026-11-30")), ("old", None, day("1960-09-21")), ("none", None, None)], "path string, created date, modified date").withColumn("accessed", F.lit(None).cast("date"))
    got = {r["path"]: (r["status"], r["error"], r["destination"]) for r in rules.match_rules(files, some).collect()}
    assert got == {"both": ("needs-review", "MULTIPLE_RULE_MATCHES", None), "last": ("matched", None, "/3"), "old": ("matched", None, "/0"), "none": ("needs-review", None, None)}


def test_bad_rules(spark):
    rows = [("a", "A", "2026-02-01", "2026-04-30", True), ("b", "B", "2026-04-30", "2026-07-31", True), ("c", "C", "2026-02-30", "2026-03-01", True)]
    got = rules.validate_rules(spark.createDataFrame(rows, "id string, name string, start_date string, end_date string, enabled boolean")).collect()
    assert {r["id"]: r["error"] for r in got} == {"a": "RULE_CONFLICT", "b": "RULE_CONFLICT", "c": "INVALID_DATE"}


def test_names(spark):
    row = spark.range(1)
    day = F.lit("2026-09-21").cast("date")
    name = lambda p, f, n=12: row.select(names.render_name(p, F.lit(f), F.lit("Periodo 3"), day, F.lit(n)).alias("x")).first()["x"]
    assert name(names.Preset("a", "a", "{period}_{date:yyyy-MM-dd}_{name}", "lower", "dash", True, True), "Tarea  Final Programación.pdf") == "periodo-3_2026-09-21_tarea-final-programacion.pdf"
    assert name(names.Preset("b", "b", "{date:yyyyMMdd}_{counter:0000}"), "IMG.JPG") == "20260921_0012.JPG"
    assert name(names.Preset("c", "c", "{name}", "title", "underscore", True, True), "álgebra final.pdf") == "Algebra_Final.pdf"
    for bad in ("{unknown}", "CON", "{date:%n}", "", "{name"):
        assert names.validate_presets([names.Preset("a", "a", bad)], {}, None) == "INVALID_PRESET", bad
    assert names.validate_presets([names.Preset("a", "a", "{name}")], {"r": "a"}, "a") is None


def test_samples_and_pairs(spark):
    a = bytes(200_000)
    b = a[:100_000] + b"\x01" + a[100_001:]
    files = spark.createDataFrame([(bytearray(a),), (bytearray(b),)], "c binary")
    assert files.select(F.count_distinct(scalars.sample_digest(F.col("c"))).alias("s"), F.count_distinct(scalars.content_digest(F.col("c"))).alias("d")).first() == (1, 2)
    copies = spark.range(201).select(F.lit("x").alias("digest"), F.format_string("/f%03d", "id").alias("path"))
    assert dedup.duplicate_pairs(copies).count() == 399
    assert dedup.duplicate_pairs(copies.limit(3)).count() == 3


@pytest.mark.parametrize(("scores", "want"), [({"animals": 0.19}, (["other"], True)), ({"people": 0.32, "memes": 0.315}, (["people", "memes"], True)), ({"animals": 0.33, "objects": 0.26}, (["animals"], False)), ({"animals": float("nan")}, (["other"], True))])
def test_labels(spark, scores, want):
    x = F.array(*[F.struct(F.lit(k).alias("category"), F.lit(v).alias("score")) for k, v in scores.items()])
    got = spark.range(1).select(signals.decide_labels(signals.ranked_scores(x)).alias("d")).first()["d"]
    assert (got["categories"], got["uncertain"]) == want


def test_views(spark):
    size = lambda w, h, m="thorough": spark.range(1).select(scalars.image_views(F.lit(w), F.lit(h), m).alias("v")).first()["v"]
    assert len(size(600, 600)) == 1 and len(size(600, 400, "fast")) == 1 and len(size(300, 1200)) == 4
    assert tuple(size(600, 400)[1]) == (100, 0, 400)


def test_fingerprints():
    y, x = np.mgrid[0:400, 0:600]
    scene = np.stack([x / 600 * 255, y / 400 * 255, (x + y) / 1000 * 255], 2)
    scene[100:200, 150:300] = (255, 0, 0)
    p, d, c, a = catalog.fingerprint_of(scene)
    q, e, f, b = catalog.fingerprint_of(catalog.resized(scene, 200, 300))
    bits = lambda u, v: bin((u ^ v) & (1 << 64) - 1).count("1")
    assert bits(p, q) <= 16 and bits(d, e) <= 14 and a == b and np.abs(np.array(c) - f).mean() <= 24
    flat = catalog.fingerprint_of(np.full((200, 300, 3), (0, 0, 255), float))
    assert np.abs(np.array(c) - flat[2]).mean() > 24


def test_stream_equals_batch(spark, tmp_path):
    rng = random.Random(5)
    start = dt.datetime(2026, 1, 1)
    rows = []
    for f in ("/a/x.bin", "/a/y.bin", "/a/z.part", "/a/w.bin"):
        stamp = 0
        for k in range(40):
            stamp += rng.random() < 0.08
            rows.append((f, start + dt.timedelta(seconds=k), 1, stamp, rng.random() < 0.7, True))
    df = spark.createDataFrame(rows, "path string, observed_at timestamp, size long, modified_at long, locked boolean, present boolean")
    batch = {(r["path"], r["status"], r["decided_at"]) for r in stable.stable_files_batch(df).collect() if r["status"] != "waiting"}
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    q = stable.stable_files(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/at").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    stream = {(r["path"], r["status"], r["observed_at"]) for r in spark.read.parquet(f"{tmp_path}/out").collect() if r["status"] != "detected"}
    assert stream == batch and batch


def test_media_plan_keeps_both_apart(spark):
    media = spark.createDataFrame([(1, "/a/x.jpg", "d1"), (2, "/b/x.jpg", "d2"), (3, "/c/x.jpg", "d2"), (4, "/d/x.jpg", None), (5, "/e/y.jpg", "d9")], "id long, path string, digest string")
    library = spark.createDataFrame([("/OUT/x (1).jpg", "d8"), ("/out/z.jpg", "d9")], "path string, digest string")
    plan = lambda what: {r["seq"]: (r["destination"], r["action"]) for r in resolve.plan_media_transfer(media, media.select("id"), "/out", library, "keep-both", what).collect()}
    first = {1: ("/out/x.jpg", "move"), 2: ("/out/x (2).jpg", "move")}
    assert plan("keep-both") == first | {3: ("/out/x (3).jpg", "move"), 4: ("/out/x (4).jpg", "move"), 5: ("/out/y.jpg", "move")}
    assert plan("skip") == first | {3: ("/out/x.jpg", "skip"), 4: ("/out/x (3).jpg", "move"), 5: ("/out/y.jpg", "skip")}


def test_bands_of_a_hot_block_lose_no_pair(spark):
    rng = random.Random(9)
    prints = []
    for k in range(40):
        own = rng.getrandbits(64)
        for n in range(3):
            h = own
            for i in rng.sample(range(64), rng.randrange(12)):
                h ^= 1 << i
            prints.append((f"{k}-{n}", h - (1 << 64) if h >> 63 else h, 1.0, [0]))
    df = spark.createDataFrame(prints, "digest string, dhash long, aspect double, colors array<int>").withColumn("phash", F.lit(0).cast("long"))
    want = {(a[0], b[0]) for a in prints for b in prints if a[0] < b[0] and ((a[1] ^ b[1]) & (1 << 64) - 1).bit_count() <= 14}
    for rows in (10, 1000):
        got = [(r["left_digest"], r["right_digest"]) for r in dedup.similar_images(df, banded_rows=rows).collect()]
        assert len(got) == len(want) and set(got) == want and want
