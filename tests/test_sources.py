"""Sources on small files: catalogues, images, prototypes; and plans, undo and control rows on small tables."""

import datetime as dt
import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from curatrix.operators import journal, media
from curatrix.operators.rules import DateRule, match_rules
from curatrix.plans import resolve
from curatrix.sources import catalog
from curatrix.streaming import stable


def png(pixels: np.ndarray) -> bytes:
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    height, width, channels = pixels.shape
    rows = b"".join(b"\0" + r.tobytes() for r in pixels)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, {3: 2, 4: 6}[channels], 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


@pytest.fixture
def pictures(tmp_path):
    y, x = np.mgrid[0:90, 0:120]
    scene = np.stack([x * 2, y * 2, x + y], 2).astype(np.uint8)
    clear = np.dstack([scene, np.zeros((90, 120), np.uint8)])
    (tmp_path / "scene.png").write_bytes(png(scene))
    (tmp_path / "clear.png").write_bytes(png(clear))
    (tmp_path / "broken.png").write_bytes(b"\x89PNG\r\n\x1a\nnothing")
    return tmp_path


def test_scan_reads_each_file_once(spark, tmp_path):
    for name in ("a/x.txt", "a/b/y.txt", "a/.organizador-recuperacion/z.txt", "c/x.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    short = lambda df: [r["path"].rpartition(f"{tmp_path.name}/")[2] for r in df.collect()]
    scan = lambda *roots, **more: catalog.scan_catalog(spark, [f"{tmp_path}/{r}" for r in roots], recovery_dir=".organizador-recuperacion", **more)
    assert short(scan("a", "a/b", "c")) == ["a/b/y.txt", "a/x.txt", "c/x.txt"]
    assert short(scan("a", recursive=False)) == ["a/x.txt"] and short(scan("a", glob="y*")) == ["a/b/y.txt"]


def test_images_and_their_guards(spark, pictures):
    images = catalog.read_images(spark, str(pictures))
    files = catalog.scan_catalog(spark, [str(pictures)]).select("path", "length")
    told = lambda df: {r["path"].rpartition("/")[2]: r["error"] for r in df.collect()}
    assert told(catalog.image_guard(images)) == {"scene.png": None, "clear.png": None, "broken.png": "UNSUPPORTED_IMAGE"}
    assert told(catalog.image_guard(images, max_pixels=100))["scene.png"] == "IMAGE_TOO_LARGE"
    names = images.withColumn("path", F.element_at(F.split("path", "/"), -1))
    by_name = files.withColumn("path", F.element_at(F.split("path", "/"), -1))
    assert set(told(catalog.image_guard(names, files=by_name, max_file_bytes=1)).values()) == {"IMAGE_TOO_LARGE"}


def test_fingerprints_and_embeddings_of_files(spark, pictures):
    images = catalog.read_images(spark, str(pictures))
    prints = {r["path"].rpartition("/")[2]: r for r in catalog.fingerprint(images).collect()}
    assert set(prints) == {"scene.png", "clear.png"} and prints["scene.png"]["aspect"] == pytest.approx(4 / 3)
    assert set(prints["clear.png"]["colors"]) == {255}  # transparent: white
    encoder = lambda: lambda x: x.mean((2, 3))
    got = {r["path"].rpartition("/")[2]: r["embedding"] for r in catalog.embed(images, encoder, 16, [0.5, 0.5, 0.5], [0.25, 0.25, 0.25]).collect()}
    assert len(got) == 2 and np.allclose(got["clear.png"], [1.5, 1.5, 1.5], atol=0.1)  # white between bands of the mean colour


def test_cubic_weights():
    for size, to in ((10, 10), (10, 4), (4, 10), (1, 3)):
        w = catalog.cubic_weights(size, to)
        assert np.allclose(w.sum(1), 1)
    assert np.allclose(catalog.cubic_weights(6, 6), np.eye(6))
    line = np.arange(20.0)
    inner = catalog.cubic_weights(20, 40) @ line  # cubics keep straight lines
    assert np.allclose(np.diff(inner)[6:-6], 0.5)


def test_prototypes(spark, tmp_path):
    def load(model, categories):
        (tmp_path / "p.json").write_text(json.dumps({"model": model, "categories": [{"id": i, "embeddings": e} for i, e in categories]}))
        return [(r["category"], r["error"]) for r in catalog.load_prototypes(spark, f"{tmp_path}/p.json", "m", 2, ["a", "b"]).orderBy("category", "prompt").collect()]

    assert load("m", [("a", [[1.0, 0.0], [0.0, 1.0]]), ("b", [[0.5, 0.5]])]) == [("a", None), ("a", None), ("b", None)]
    assert load("other", [("a", [[1.0, 0.0]])]) == [("a", "INVALID_MODEL")]
    assert load("m", [("z", [[1.0, 0.0]]), ("a", []), ("b", [[0.0, 0.0]])]) == [("a", "INVALID_VECTOR"), ("b", "INVALID_VECTOR"), ("z", "INVALID_CATEGORY")]


def test_folder_conflicts(spark):
    tree = spark.createDataFrame([("/a/f", True), ("/a/f/x.txt", False), ("/b/f", True), ("/b/f/y.txt", False), ("/c/g", True), ("/c/g/z.txt", False)], "path string, is_dir boolean")
    sources = spark.createDataFrame([("/a/f",), ("/b/f",), ("/c/g",)], "path string")
    library = spark.createDataFrame([("/t/G",), ("/t/f (1)",)], "path string")
    plan = lambda policy: {(r["path"], r["action"]): (r["target"], r["error"]) for r in resolve.plan_transfer(tree, sources, "/t", "copy", policy, library).collect()}
    assert plan("skip") == {("/a/f", "mkdir"): ("/t/f", None), ("/a/f/x.txt", "copy"): ("/t/f/x.txt", None), ("/b/f", "skip"): ("/t/f", None), ("/b/f/y.txt", "skip"): ("/t/f/y.txt", None), ("/c/g", "skip"): ("/t/g", None), ("/c/g/z.txt", "skip"): ("/t/g/z.txt", None)}
    both = plan("keep-both")
    assert both["/b/f/y.txt", "copy"] == ("/t/f (2)/y.txt", None) and both["/c/g", "mkdir"] == ("/t/g (1)", None) and both["/a/f", "mkdir"] == ("/t/f", None)
    assert plan("replace")["/c/g/z.txt", "copy"][1] == "FOLDER_CONFLICT" and plan("replace")["/a/f/x.txt", "copy"][1] is None


def test_undo_of_dates_and_folders(spark):
    rows = [("o", 1, "/", "/t/new", "mkdir", "directory", None, None), ("o", 2, "/a", "/t/new/a", "move", "file", "d", None), ("o", 3, "/b", "/b", "dates", "file", "e", "777"), ("o", 4, "/", "/t/full", "mkdir", "directory", None, None)]
    items = spark.createDataFrame(rows, "operation_id string, sequence long, source string, destination string, kind string, entry_kind string, digest string, old_value string").withColumn("status", F.lit("completed"))
    now = spark.createDataFrame([("/t/new/a", "d"), ("/b", "e"), ("/t/full/other", "x")], "path string, digest string")
    got = {r["sequence"]: (r["undo_order"], r["undo_to"], r["error"]) for r in journal.plan_undo(items, now).collect()}
    assert got == {4: (1, None, "DIRECTORY_NOT_EMPTY"), 3: (2, "777", None), 2: (3, "/a", None), 1: (4, None, None)}


def test_new_rules_evaluate_only_what_is_decided(spark):
    day = dt.date(2026, 3, 1)
    old, new = [DateRule("1", "one", "2026-01-01", "2026-02-01", "/1")], [DateRule("2", "two", "2026-03-01", "2026-03-31", "/2"), DateRule("3", "three", "2026-01-01", "2026-12-31", "/3", "accessed")]
    files = spark.createDataFrame([(k, day, day, None) for k in "abc"], "path string, created date, modified date, accessed date")
    inbox = match_rules(files, old).withColumn("status", F.when(F.col("path") == "c", "waiting").otherwise(F.col("status")))
    got = {r["path"]: (r["status"], r["rule_id"]) for r in stable.reevaluate(inbox, new).collect()}
    assert got == {"a": ("matched", "2"), "b": ("matched", "2"), "c": ("waiting", None)}
    assert stable.accessed_matters(new) and not stable.accessed_matters(old)


def test_retries_are_control_rows(spark, tmp_path):
    start = dt.datetime(2026, 1, 1)
    rows = [("/f", start + dt.timedelta(seconds=s), 1, 1, locked, True, retry) for s, locked, retry in [(0, False, False), (5, True, False), (6, True, False), (7, False, True), (8, False, False), (11, False, False)]]
    spark.createDataFrame(rows, "path string, observed_at timestamp, size long, modified_at long, locked boolean, present boolean, retry boolean").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in").schema).parquet(f"{tmp_path}/in")
    q = stable.stable_files(stream, 3, 2).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/at").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = [(r["observed_at"].second, r["status"]) for r in spark.read.parquet(f"{tmp_path}/out").orderBy("observed_at").collect()]
    assert got == [(0, "detected"), (6, "failed"), (7, "waiting"), (11, "ready")]


def test_many_examples(spark, monkeypatch):
    monkeypatch.setattr(media, "EXAMPLE_BLOCK", 3)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(20, 4))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    examples = spark.createDataFrame([(f"d{k}", x[k].tolist(), ["a"] if k % 3 else ["b", "c"]) for k in range(20)], "digest string, embedding array<double>, categories array<string>")
    own = spark.createDataFrame([(k, (x[k] * 0.99).tolist()) for k in range(20)], "id long, embedding array<double>")
    got = {r["id"]: (r["categories"], round(r["similarity"], 6)) for r in media.nearest_feedback(own, examples, 0.9, 0.0).collect()}
    s = 0.99 * x @ x.T
    assert got == {k: (["a"] if s[k].argmax() % 3 else ["b", "c"], round(float(s[k].max()), 6)) for k in range(20)}
