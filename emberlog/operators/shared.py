"""Tables in the folder that driver and executors share, and broadcasts of a counted size."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: rows of a narrow table that are broadcast
ROWS = 200_000
#: rows that one task takes where they are dealt, about
ROWS_OF_A_TASK = 100_000


def folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; in local mode, where none need be named, one of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="emberlog-shared-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def new_path(spark: SparkSession, name: str) -> str:
    return os.path.join(folder(spark), f"emberlog-{name}-{uuid.uuid4().hex}")


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it: what stands before it runs once, whatever is made of it."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = ROWS) -> DataFrame:
    """Marks a written narrow table for broadcast if it has so few rows, which are counted; else Spark shuffles."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def spread(rows: DataFrame, of_task: int = ROWS_OF_A_TASK) -> DataFrame:
    """Rows dealt to tasks of about of_task rows, and to all cores at least, where a partition has more than twice its share; others as they are.

    Files of few large row groups read as many partitions, but all rows lie in as few of them as there are groups; so rows are counted by partition.
    """
    if rows.isStreaming:
        return rows
    n, most = rows.groupBy(F.spark_partition_id().alias("part")).count().agg(F.coalesce(F.sum("count"), F.lit(0)), F.coalesce(F.max("count"), F.lit(0))).first()
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-n // of_task))
    return rows.repartition(tasks) if most * tasks > 2 * n else rows
