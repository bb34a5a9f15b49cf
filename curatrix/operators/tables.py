"""Tables that cut lineage, in the folder that the cluster names for checkpoints."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StructField, StructType


def new_folder(spark: SparkSession) -> str:
    """A new folder name in spark.checkpoint.dir. Where that is unset: in local mode in a folder of this machine; on a cluster, an error."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="spark-")
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def materialized(df: DataFrame) -> DataFrame:
    """df as a written table."""
    where = new_folder(df.sparkSession)
    df.write.option("compression", "zstd").parquet(where)
    return df.sparkSession.read.schema(df.schema).parquet(where)


class Grown:
    """A table that a loop adds to, and reads as far as it is."""

    def __init__(self, spark: SparkSession, schema: str) -> None:
        self.spark, self.where = spark, new_folder(spark)
        self.schema = StructType.fromDDL(schema)
        self.add(spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema]))  # no Python worker is started for no rows

    def add(self, df: DataFrame) -> None:
        df.select(self.schema.names).write.mode("append").option("compression", "zstd").parquet(self.where)

    def table(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.where)


class Ended:
    """A table of rows that a loop is done with. Each turn parts its rows in one write: those that are done stay where they were written."""

    def __init__(self, spark: SparkSession, schema: str) -> None:
        self.spark, self.where, self.turn = spark, new_folder(spark), 0
        self.schema = StructType.fromDDL(schema)

    def part(self, df: DataFrame) -> DataFrame:
        """The rows of df (with the column done) that aren't done, as a table."""
        self.turn += 1
        df.write.partitionBy("done").option("compression", "zstd").parquet(self._folder())
        return self.spark.read.schema(df.schema).parquet(self._folder()).where("not done").drop("done")

    def add(self, df: DataFrame) -> None:
        """More rows that are done, of the same turn."""
        df.select(self.schema.names).write.mode("append").option("compression", "zstd").parquet(f"{self._folder()}/done=true")

    def table(self) -> DataFrame:
        return self.spark.read.schema(StructType([*self.schema, StructField("turn", IntegerType()), StructField("done", BooleanType())])).parquet(self.where).where("done").select(self.schema.names)

    def _folder(self) -> str:
        return f"{self.where}/turn={self.turn}"
