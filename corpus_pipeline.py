"""From raw documents to a training mix, in five stages.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept, and gives the
columns of documents; the last adds how often the mix takes each document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from emberlog.llm import decontaminate, jaccard_join, mixing, secrets_scan, toxicity
from emberlog.llm.common import written


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below their language's toxicity threshold; the classifier is fitted on the labels that are not held out."""
    return toxicity.clean_of(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 on five-word shingles, the one with the smallest doc_id."""
    return jaccard_join.one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no test item."""
    return decontaminate.clean_of(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets_redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets replaced by a mark; n_chars follows."""
    return secrets_scan.redacted(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with mix_copies, the times that each is taken."""
    return mixing.mixed_documents(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("jaccard_join", one_of_each_group),
    ("decontamination", without_benchmark),
    ("secrets", secrets_redacted),
    ("mixing", mixed),
]

#: a trained classifier decides in the first stage
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
