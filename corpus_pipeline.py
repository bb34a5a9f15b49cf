"""A corpus from raw documents to token sequences: language, near duplicates, benchmark passages, personal data, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from curatrix.llm import decontaminate, jaccard, language, packing, pii
from curatrix.llm.common import bounded_batches, cut

TABLE = "documents"
ORACLE_SQL = None  # classifiers, a random field and a tokenizer: tests/llm holds run() against brute force


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language ID rejects go: no text, no letter, or too little to tell one language from another.

    The session's Arrow batches are bounded here for all stages, so that executors hold few texts at a time."""
    bounded_batches(spark)
    return language.keep_known(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.75 or more, the one with the smallest doc_id stays."""
    return jaccard.keep_one(docs)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that nearly repeat a benchmark item go."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def no_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind."""
    return pii.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their places in sequences."""
    return packing.pack(docs)


STAGES = [("language", known_language), ("near_duplicates", one_of_each), ("decontaminate", no_benchmark), ("pii", no_personal_data), ("pack", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over the table documents.

    Null, empty and letterless texts leave with the first stage; rows that repeat a document or nearly so leave with the second,
    but rows without an id or with the smallest id of their group stay; very long texts are cut by the last into pieces. An empty
    table gives no rows, and columns beyond those of documents are carried to the last stage, whatever their names."""
    docs = spark.read.parquet(f"{sf_dir}/{TABLE}.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
