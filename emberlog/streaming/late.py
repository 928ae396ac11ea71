"""Late rows: kept apart by the stream, and mended in batch for the keys that they touch.

split() runs a stream through foreachBatch. A micro-batch has a watermark of its own: the greatest time of all batches before it, less the lateness. Rows below go
to the table of late rows, all others to the table of events; both are written by batch, so a batch that is run again after a failure writes the same.
The fires of a rule come from a stream over the events that were on time (rule_stream drops none of them, as its watermark is never ahead of
this one). repaired() takes the late rows in: the keys that they touch, and only those, are folded anew from the stored events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import detect, shared
from ..rules.model import Rule, column_of

BUCKETS = 64  # folders of the stored events, by a hash of the key
SECOND = 1_000_000


def _bucket(key: str):
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(BUCKETS)).cast("int")


def split(stream: DataFrame, path: str, key: str, late_seconds: int) -> None:
    """Runs a stream of events to the end of what is there, into path/events (by bucket of the key), path/late and path/marks. A later run goes on."""
    spark = stream.sparkSession
    schema = "max_us long, batch long"

    def marks() -> DataFrame:
        return spark.read.schema(schema).parquet(f"{path}/marks")

    def one(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        before = marks().where(F.col("batch") < number).agg(F.max("max_us")).first()[0]
        below = F.lit(False) if before is None else F.coalesce(F.col("us") < before - late_seconds * SECOND, F.lit(False))
        batch.where(~below).withColumn("bucket", _bucket(key)).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/events/batch={number}")
        batch.where(below).write.mode("overwrite").parquet(f"{path}/late/batch={number}")
        # the mark comes last: without it the batch counts as not done, and is written again
        batch.agg(F.max("us").alias("max_us")).where("max_us is not null").write.mode("overwrite").parquet(f"{path}/marks/batch={number}")
        batch.unpersist()

    spark.createDataFrame([], "max_us long").write.mode("ignore").parquet(f"{path}/marks/batch=-1")
    query = stream.writeStream.foreachBatch(one).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()


def done_us(spark: SparkSession, path: str, late_seconds: int) -> int:
    """The time up to which all that was on time is decided."""
    return (spark.read.schema("max_us long, batch long").parquet(f"{path}/marks").agg(F.max("max_us")).first()[0] or 0) - late_seconds * SECOND


def stored(spark: SparkSession, path: str, what: str, schema) -> DataFrame:
    """The events or the late rows so far, in the stream's columns."""
    columns = [f"`{f.name}` {f.dataType.simpleString()}" for f in schema]
    return spark.read.schema(", ".join([*columns, "batch long", *(["bucket int"] if what == "events" else [])])).parquet(f"{path}/{what}").drop("batch")


def event_store(spark: SparkSession, path: str, schema) -> DataFrame:
    """A stream over the events that were on time, for rule_stream."""
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{path}/events")


def touched(late: DataFrame, rule: Rule) -> DataFrame:
    """source_file and key of the late rows that a rule sees. Written, as the repair reads it twice."""
    rows, _, _ = detect.seen_by(late, [rule])
    return shared.written(rows.select("source_file", "key").distinct(), "touched")


def repaired(fires: DataFrame, events: DataFrame, late: DataFrame, rule: Rule, until_us: int) -> DataFrame:
    """Fires (source_file, key, rule_id, line_number, us, event_count) with the late rows taken in, up to a time.

    Those of keys without late rows stay. The others' are folded anew from their stored events and late rows; of the stored events, only the touched
    buckets are read.
    """
    keys = touched(late, rule)
    few = shared.small(keys)
    buckets = [r[0] for r in keys.select(_bucket("key").alias("b")).distinct().collect()]
    own = events.where(F.col("bucket").isin(buckets)).drop("bucket").unionByName(late)
    match = own.withColumn("key", column_of(rule.key).cast("string")).join(few, ["source_file", "key"], "left_semi").drop("key")
    again = detect.fires(match, [rule]).select(*fires.columns)
    return fires.join(few, ["source_file", "key"], "left_anti").unionByName(again).where(F.col("us") < until_us)

