"""Connected components of a graph of links, by minimum labels and pointer jumping over tables; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.llm.common import cut


def components(links: DataFrame) -> DataFrame:
    """node, label (the smallest node reachable) of every node in links (a, b: long)."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    edges = cut(both)
    labels = cut(edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).select(F.col("a").alias("node"), "label"))
    while True:
        near = edges.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        jumped = labels.join(labels.select(F.col("node").alias("label"), F.col("label").alias("next")), "label", "left")
        new = cut(jumped.join(near, "node").select("node", F.least("label", "next", "near").alias("label"), (F.least("label", "next", "near") < F.col("label")).alias("changed")))
        labels = new.select("node", "label")
        if new.where("changed").isEmpty():
            return labels
