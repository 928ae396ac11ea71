"""Streaming detection: raw lines, stateless patterns, windowed rates, sessions, duplicates, rules with state."""

from __future__ import annotations

import os
import pickle
import re
import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import detect
from ..operators.chains import Events
from ..rules.model import Rule, column_of
from ..sources import formats
from ..plans.adapter import K, COLUMNS
from ..functions import core


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """Event rows of a folder of event files, as they come."""
    schema = spark.read.parquet(path).schema
    base = spark.readStream.schema(schema).parquet(path).selectExpr("*", f"{K} as k", "unix_micros(cast(ts as timestamp)) as us")
    out = base.selectExpr(*[x.replace("varchar(10)", "string") for x in COLUMNS])
    raw = F.concat_ws(" ", "source_ip", "http_method", "http_uri", F.col("http_status").cast("string"), "message")
    return out.select("*", F.timestamp_micros("us").alias("timestamp"), core.url_decoded("http_uri").alias("http_uri_decoded"), raw.alias("raw_line"))


def pattern_stream(events: DataFrame) -> DataFrame:
    """Findings of pattern rules: no state, append mode; the static rule table joins each batch."""
    return detect.findings(detect.regex_hits(events))


def rates(events: DataFrame, window: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """source_ip, start, n: failures in each window."""
    failures = events.where("auth_result = 'failure'")
    failures = failures.withWatermark("timestamp", late) if events.isStreaming else failures
    w = F.window("timestamp", window, slide) if slide else F.window("timestamp", window)
    return failures.groupBy(w.alias("w"), "source_ip").agg(F.count("*").alias("n")).select("source_ip", F.col("w.start").alias("start"), "n")


def attack_sessions(found: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    """source_ip, start, end, n: bursts of findings with no gap as long as the given one."""
    rows = found.withWatermark("timestamp", late) if found.isStreaming else found
    out = rows.groupBy(F.session_window("timestamp", gap).alias("w"), "source_ip").agg(F.count("*").alias("n"))
    return out.select("source_ip", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def without_repeats(found: DataFrame, within: str = "1 minute") -> DataFrame:
    return found.withWatermark("timestamp", within).dropDuplicatesWithinWatermark(["rule_id", "source_ip", "raw_line", "severity"])


EMPTY = pd.DataFrame({"us": [], "line_number": [], "mask": []})


def threshold_stream(events: DataFrame, key: str, count: int, seconds: int, late: str = "1 hour") -> DataFrame:
    """Fires of one threshold over a stream, without a filter; see rule_stream."""
    return rule_stream(events, Rule("threshold", "threshold", "MEDIUM", "rate", 0.8, (), (), "threshold", key=key, count=count, seconds=seconds), late)


def rule_stream(events: DataFrame, rule: Rule, late: str = "1 hour") -> DataFrame:
    """source_file, key, rule_id, line_number, us, event_count: fires of a threshold, sequence or composite over a stream.

    Events wait in the key's state until the watermark has passed them and then go on in order, so those that come out of order within the
    lateness give what they give in batch. What stays of them is what later ones may need (chains.Open); it goes once the rule's window
    after the key's last event has passed the watermark. Later rows are dropped by Spark; late.py keeps them and mends what they change.
    """
    flags, values, (plan,) = detect.columns_of([rule])
    width, names = detect.window_of(rule), [f"v{i}" for i in range(len(values))]

    def fold(k, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done = state.getCurrentWatermarkMs() * 1000
        waiting, now = pickle.loads(state.get[0]) if state.exists else (None, plan.start(len(names)))
        own = [x for x in (waiting, *batches) if x is not None and len(x)]
        rows = (pd.concat(own) if len(own) > 1 else own[0] if own else EMPTY.reindex(columns=["us", "line_number", "mask", *names])).sort_values(["us", "line_number"])
        ready = rows[rows["us"] < done] if done > 0 else rows[:0]
        waiting = rows[len(ready) :][["us", "line_number", "mask", *names]]
        fires, now = plan.run(Events.of(ready["us"], ready["line_number"], ready["mask"], [ready[v] for v in names]), now)
        if len(waiting):
            until = int(waiting["us"].min()) // 1000 + 1
        elif state.hasTimedOut and (not len(ready) or int(ready["us"].max()) + width < done):
            state.remove()
            until = None
        else:
            until = (int(ready["us"].max() if len(ready) else done) + width) // 1000 + 1
        if until is not None:
            state.update((pickle.dumps((waiting, now)),))
            state.setTimeoutTimestamp(max(until, done // 1000 + 1))
        yield pd.DataFrame([(k[0], k[1], rule.id, f[0], f[1], f[2]) for f in fires], columns=["source_file", "key", "rule_id", "line_number", "us", "event_count"])

    rows = events.where(column_of(rule.key).isNotNull() & (column_of(rule.key).cast("string") != "")).withWatermark("timestamp", late)
    rows = rows.select("source_file", column_of(rule.key).cast("string").alias("key"), "us", F.col("line_number").cast("long").alias("line_number"), detect.mask_of(flags).alias("mask"), *[v.alias(n) for v, n in zip(values, names, strict=True)], "timestamp")
    schema = "source_file string, key string, rule_id string, line_number long, us long, event_count int"
    return rows.groupBy("source_file", "key").applyInPandasWithState(fold, schema, "machine binary", "append", GroupStateTimeout.EventTimeTimeout)


def late_rows(events: DataFrame, done_us: int, late_us: int = 3_600_000_000) -> DataFrame:
    """Events of a batch that a stream whose greatest time was done_us no longer takes: they go to a table of their own, for repair in batch."""
    return events.where(F.col("us") < done_us - late_us)


def line_stream(spark: SparkSession, path: str, log_format: str) -> DataFrame:
    """Event rows of a folder of text logs of one format, as the files come; source_file is the file's path. A line has no number in a stream: line_number is a hash of it."""
    lines = spark.readStream.format("text").load(path).select(F.col("_metadata.file_path").alias("source_file"), F.col("value").alias("raw_line")).where(F.trim("raw_line") != "")
    out = formats.normalise(lines, log_format).withColumn("line_number", F.xxhash64("source_file", "raw_line"))
    return out.withColumn("us", F.unix_micros("timestamp"))


def run_to_end(stream: DataFrame, mode: str = "append", path: str | None = None) -> DataFrame:
    """Runs a stream over what is there, into a table in the shared folder, and reads that.

    With a path, a later run over the same source goes on where the last one ended: its checkpoint is there.
    """
    spark = stream.sparkSession
    if path is None:
        root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if not root and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        path = os.path.join(root or tempfile.mkdtemp(prefix="emberlog-stream-"), f"emberlog-stream-{uuid.uuid4().hex}")
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


def rate_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly failures by source, in batch; the stream gives the same rows once the watermark has passed."""
    from ..plans.adapter import events

    return rates(events(spark, sf_dir), "1 hour").select("source_ip", F.unix_timestamp("start").alias("hour"), "n")
