"""The stream of observations by buckets of paths."""

import datetime as dt

from pyspark.sql import functions as F

from curatrix.streaming import stable

SCHEMA = "path string, observed_at timestamp, size long, modified_at long, locked boolean, present boolean"


def replayed(spark, tmp_path, *batches):
    progress = None
    for rows in batches:
        rows.write.mode("append").parquet(f"{tmp_path}/in")
        q = stable.stable_files(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/at").trigger(availableNow=True).start()
        q.awaitTermination()
        progress = q.lastProgress
    return spark.read.schema(stable.STATUS).parquet(f"{tmp_path}/out"), progress


def test_state_has_buckets_and_not_paths(spark, tmp_path):
    at = F.lit(dt.datetime(2030, 1, 1))
    files = spark.range(3000).select(F.concat(F.lit("/u/"), "id").alias("path"), at.alias("observed_at"), F.lit(1).cast("long").alias("size"), F.col("id").alias("modified_at"), F.lit(False).alias("locked"), F.lit(True).alias("present"))
    out, progress = replayed(spark, tmp_path, files)
    assert out.where("status = 'detected'").select("path").distinct().count() == 3000
    assert progress["stateOperators"][0]["numRowsTotal"] <= stable.BUCKETS


def test_a_path_ends_by_the_watermark_and_its_neighbours_stay(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stable, "BUCKETS", 1)
    row = lambda path, day, minute: (path, dt.datetime(2030, 1, day, 0, minute), 1, 7, False, True)
    batches = [spark.createDataFrame(rows, SCHEMA) for rows in ([row("/a", 1, 0)], [row("/b", 4, 0)], [row("/a", 4, 5), row("/b", 4, 5)])]
    out, _ = replayed(spark, tmp_path, *batches)
    got = sorted((r["path"], r["observed_at"].day, r["status"]) for r in out.collect())
    assert got == [("/a", 1, "detected"), ("/a", 4, "detected"), ("/b", 4, "detected"), ("/b", 4, "ready")]
