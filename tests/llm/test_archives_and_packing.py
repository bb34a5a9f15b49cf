"""Archives of several kinds and commits, and packing plans against best-fit."""

import gzip

import numpy as np
import pytest
from pyspark.sql import functions as F

from curatrix.llm import packing, warc


def test_appended_archives_stay_together(spark, tmp_path):
    page = lambda *ids: spark.createDataFrame([(i, "u", f"page {i}") for i in ids], "page_id long, url string, html string")
    where = f"{tmp_path}/w"
    warc.write_pages(page(1, 2), where)
    warc.write_pages(page(3), where)
    assert sorted(r["record_id"] for r in warc.read(spark, where).collect()) == ["urn:page:1", "urn:page:2", "urn:page:3"]
    rows = warc.read(spark, where).where("record_id = 'urn:page:3'")
    rows.select("record_id", "record_type", "target_uri", "refers_to", "payload_digest", "payload").write.format("warc").mode("overwrite").option("path", warc.qualified(spark, f"{tmp_path}/v")).save()
    assert warc.read(spark, f"{tmp_path}/v").count() == 1
    warc.read(spark, f"{tmp_path}/v").select("record_id", "record_type", "target_uri", "refers_to", "payload_digest", "payload").write.format("warc").mode("overwrite").option("path", warc.qualified(spark, where)).save()
    assert [r["record_id"] for r in warc.read(spark, where).collect()] == ["urn:page:3"]


@pytest.mark.parametrize("packed", [False, True])
def test_archives_of_others(spark, tmp_path, packed):
    whole = b"".join(warc.record(f"urn:x:{k}", kind, "http://a/", b"x" * size, "d", None) for k, (kind, size) in enumerate([("response", 10), ("request", 5000), ("response", 0), ("metadata", 70000), ("response", 20)]))
    (tmp_path / "a").mkdir()
    name = tmp_path / "a" / ("f.warc.gz" if packed else "f.warc")
    name.write_bytes(gzip.compress(whole) if packed else whole)
    got = warc.read(spark, str(tmp_path / "a")).where("record_type = 'response'")
    assert sorted((r["record_id"], len(r["payload"])) for r in got.collect()) == [("urn:x:0", 10), ("urn:x:2", 0), ("urn:x:4", 20)]
    assert "record_type" in str(got._jdf.queryExecution().executedPlan())
    assert warc.read(spark, str(tmp_path / "a"), payloads=False).where(F.col("payload").isNotNull()).count() == 0


def test_unwanted_payloads_are_not_read(tmp_path):
    records = [warc.member(warc.record(f"urn:x:{k}", "response" if k % 10 == 0 else "request", None, bytes(np.random.default_rng(k).integers(0, 255, 100_000, np.uint8)), "d", None)) for k in range(20)]
    (tmp_path / "f.warc.gz").write_bytes(b"".join(records))

    class Counting:
        def __init__(self, f):
            self.f, self.n = f, 0

        def read(self, n=-1):
            out = self.f.read(n)
            self.n += len(out)
            return out

        def seek(self, *a):
            return self.f.seek(*a)

    f = Counting(open(tmp_path / "f.warc.gz", "rb"))
    assert sum(1 for _ in warc.records(f, lambda row: row["record_type"] == "response", True)) == 2
    assert f.n < 0.2 * sum(map(len, records))


def best_fit(histogram):
    runs = packing._Runs(packing.SEQUENCE)
    for n in sorted(histogram, reverse=True):
        runs.place(n, histogram[n])
    return sum(many for kept in runs.by_gap.values() for many, _ in kept)


@pytest.mark.parametrize("seed", range(8))
def test_plans_are_whole_and_never_worse_than_best_fit(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 3000))
    x = [rng.integers(1, 2049, n), np.minimum(2048, rng.lognormal(6, 1, n).astype(int) + 1), rng.integers(600, 1100, n), rng.choice([700, 690, 1024, 33, 2048], n)][seed % 4]
    histogram = {int(a): int(b) for a, b in zip(*np.unique(x, return_counts=True), strict=True)}
    rows, sequences = packing.plan(histogram)
    assert sequences <= best_fit(histogram)
    placed, used = {}, {}
    for length, start, end, first, offset in rows:
        assert start == placed.get(length, 0)
        placed[length] = end
        for s in range(end - start):
            used.setdefault(first + s, []).append((offset, length))
    assert placed == histogram and sorted(used) == list(range(sequences))
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.SEQUENCE


def test_a_plan_does_not_grow_with_the_rows():
    rng = np.random.default_rng(3)
    histogram = {int(a): int(b) for a, b in zip(*np.unique(rng.integers(1, 2049, 5000), return_counts=True), strict=True)}
    few, _ = packing.plan(histogram)
    many, _ = packing.plan({n: c * 10**7 for n, c in histogram.items()})
    assert len(many) < 8 * len(few)
