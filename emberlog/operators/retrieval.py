"""A retrieval index of findings that is kept up: id, text, vector and metadata, in folders by id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared, text

SCHEMA = "id string, session_id string, rule_id string, severity string, category string, source_ip string, text string, vector array<double>, bucket string, run int"


def rows_of(found: DataFrame) -> DataFrame:
    """Index rows of findings, one for each id; an id is a hash of session, rule and trigger line. Of several findings with one id the first line's counts."""
    own = found.withColumn("id", text.document_id("session_id", "rule_id", "raw_line"))
    columns = ["session_id", "rule_id", "severity", "category", "source_ip"]
    first = own.select("id", F.struct("line_number", *columns, text.finding_text(own).alias("text")).alias("x")).groupBy("id").agg(F.min("x").alias("x"))
    return first.select("id", *[f"x.{c}" for c in columns], "x.text", F.substring("id", 1, 2).alias("bucket"))


def open_index(spark: SparkSession, path: str) -> DataFrame:
    """The index; empty where nothing was added yet."""
    spark.createDataFrame([], "id string").write.mode("ignore").parquet(f"{path}/run=0/bucket=00")
    return spark.read.schema(SCHEMA).parquet(path)


def refresh(found: DataFrame, path: str, run: int) -> DataFrame:
    """Adds the findings that the index has not yet, as one run, and returns them. A run that is done again after a failure writes the same.

    Only new ids get a vector; ids meet within their bucket, and of the index only ids are read.
    """
    have = open_index(found.sparkSession, path).where(F.col("run") < run).select("bucket", "id")
    fresh = rows_of(found).join(have, ["bucket", "id"], "left_anti").withColumn("vector", text.hash_vector("text"))
    fresh.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/run={run}")
    return open_index(found.sparkSession, path).where(F.col("run") == run)


def nearest(index: DataFrame, query: str, k: int = 5, where: Column | None = None) -> DataFrame:
    """id and score of the k index rows nearest to a text; the filter goes first."""
    vector = index.sparkSession.range(1).select(text.hash_vector(F.lit(query))).first()[0]
    return text.cosine_top(index.withColumn("embedding", F.col("vector")), vector, k, "id", where)


def two_runs(first: DataFrame, all_rows: DataFrame) -> DataFrame:
    """run, rule_id, n: what each of two runs adds to an index in the shared folder, the second with all rows."""
    path = shared.new_path(first.sparkSession, "index")
    refresh(first, path, 1)
    refresh(all_rows, path, 2)
    return open_index(first.sparkSession, path).groupBy("run", "rule_id").agg(F.count("*").alias("n"))
