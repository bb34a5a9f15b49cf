"""How often a transfer's steps are worked out."""

from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from curatrix.plans import resolve


def test_steps_are_worked_out_once(spark):
    worked = spark.sparkContext.accumulator(0)

    def told(path):
        worked.add(1)
        return path

    told_path = F.udf(told, StringType()).asNondeterministic()
    rows = spark.range(40).select(F.lit(1).alias("phase"), F.lit(0).alias("order"), told_path(F.concat(F.lit("/a/"), "id")).alias("path"), F.concat(F.lit("/new/a/"), "id").alias("target"), F.lit("copy").alias("action"), F.lit(None).cast("string").alias("error"))
    files = spark.range(40).select(F.concat(F.lit("/a/"), "id").alias("path"), F.col("id").cast("string").alias("digest"))
    plan = resolve.resolve_transfer(rows, files, spark.createDataFrame([], "path string, digest string"))
    assert [r["action"] for r in plan.collect()] == ["copy"] * 40
    assert worked.value == 40
