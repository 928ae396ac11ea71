"""Going on with files that were read before: what is known of each, and whether it may be trusted.

A manifest has a row for each file: size, time, number of lines, a hash of the first HEAD lines and one of the last. A file whose size and time are as they were is not
read again. One that has grown goes on after its last known line, if its first lines and that line are as they were. All others have changed, and are refused.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import shared

HEAD = 100
SCHEMA = "source_file string, size long, mtime_us long, lines long, head string, last string"


def numbered_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """source_file, line_number (from 1, blank lines count), raw_line of text files of any size.

    A large file is read in blocks at once: lines are numbered within a block in the order they are read, and the blocks' counts, added up, say
    where each begins.
    """
    lines = spark.read.text(paths).select(F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"), F.regexp_replace("value", r"\r$", "").alias("raw_line"))
    begin = lines.groupBy("source_file", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("source_file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    begin = begin.select("source_file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"))
    number = F.row_number().over(Window.partitionBy("source_file", "block").orderBy("place"))
    return lines.withColumn("number", number).join(begin, ["source_file", "block"]).select("source_file", (F.col("begin") + F.col("number")).alias("line_number"), "raw_line")


def files(spark: SparkSession, path: str) -> DataFrame:
    """source_file, size and mtime_us of the files there are; none is read."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("source_file"), F.col("length").alias("size"), F.unix_micros("modificationTime").alias("mtime_us"))


def _digest(lines: DataFrame, most) -> DataFrame:
    """source_file, lines, head and last of numbered lines up to a number."""
    head = F.array_sort(F.collect_list(F.when(F.col("line_number") <= HEAD, F.struct("line_number", F.sha2("raw_line", 256).alias("h")))))
    text = F.array_join(F.transform(head, lambda x: x["h"]), ",")
    return lines.where(F.col("line_number") <= most).groupBy("source_file").agg(F.max("line_number").alias("lines"), F.sha2(text, 256).alias("head"), F.sha2(F.max_by("raw_line", "line_number"), 256).alias("last"))


def taken(spark: SparkSession, path: str) -> DataFrame:
    """The manifest of all files, as they are now."""
    return files(spark, path).join(_digest(numbered_lines(spark, path), F.lit(2**62)), "source_file", "left").select(*[c.split()[0] for c in SCHEMA.split(", ")])


def decisions(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """source_file, decision and lines (known) of each file: new, unchanged, appended, truncated, replaced, or missing. Only files whose size or time differ are read."""
    old = manifest.select("source_file", F.col("size").alias("old_size"), F.col("mtime_us").alias("old_mtime"), F.coalesce("lines", F.lit(0)).alias("lines"), F.col("head").alias("old_head"), F.col("last").alias("old_last"))
    both = shared.written(files(spark, path).join(old, "source_file", "full"), "files")
    same = (F.col("size") == F.col("old_size")) & (F.col("mtime_us") == F.col("old_mtime"))
    grown = both.where((F.col("size") >= F.col("old_size")) & ~same)
    names = [r[0] for r in grown.select("source_file").collect()]
    if names:
        known = numbered_lines(spark, names).join(F.broadcast(grown.select("source_file", F.col("lines").alias("known"))), "source_file")
        now = _digest(known, F.col("known")).select("source_file", F.col("head").alias("now_head"), F.col("last").alias("now_last"), F.col("lines").alias("now_lines"))
    else:
        now = spark.createDataFrame([], "source_file string, now_head string, now_last string, now_lines long")
    held = (F.col("lines") == 0) | F.coalesce((F.col("now_head") == F.col("old_head")) & (F.col("now_last") == F.col("old_last")) & (F.col("now_lines") == F.col("lines")), F.lit(False))
    what = (
        F.when(F.col("size").isNull(), "missing").when(F.col("old_size").isNull(), "new").when(same, "unchanged")
        .when(F.col("size") < F.col("old_size"), "truncated").when(held, "appended").otherwise("replaced")
    )
    return both.join(now, "source_file", "left").select("source_file", what.alias("decision"), F.coalesce("lines", F.lit(0)).alias("lines"))


def new_lines(spark: SparkSession, decided: DataFrame) -> DataFrame:
    """The lines that were not read before: all of new files, and those after the known of appended ones. Changed files give none; their rows in decided say so."""
    decided = decided.where(F.col("decision").isin("new", "appended")).select("source_file", "lines")
    names = [r[0] for r in decided.select("source_file").collect()]
    if not names:
        return spark.createDataFrame([], "source_file string, line_number long, raw_line string")
    return numbered_lines(spark, names).join(shared.small(decided), "source_file").where(F.col("line_number") > F.col("lines")).drop("lines")
