"""Streams over files give what the batch gives."""

import dataclasses

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from emberlog.operators import detect
from emberlog.plans.adapter import events
from emberlog.queries import COMPOSITE, DISTINCT, SEQUENCE, THRESHOLD
from emberlog.streaming import jobs
from emberlog.streaming.late import done_us, event_store, repaired, split, stored

DIR = "/root/testdata/sf0.001"


def stream(spark, tmp_path):
    spark.read.parquet(f"{DIR}/events.parquet").coalesce(1).write.parquet(str(tmp_path / "in"))
    return jobs.event_stream(spark, str(tmp_path / "in"))


def test_patterns(spark, tmp_path):
    got = jobs.run_to_end(jobs.pattern_stream(stream(spark, tmp_path)).select("rule_id", "line_number"))
    want = detect.regex_hits(events(spark, DIR)).select("rule_id", "line_number")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_rates(spark, tmp_path):
    got = jobs.run_to_end(jobs.rates(stream(spark, tmp_path), "1 hour", late="0 seconds"))
    rows = jobs.rates(events(spark, DIR), "1 hour").collect()
    last = max(r["start"] for r in rows)  # the watermark has not passed it
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in rows if r["start"] < last}


def decided(spark, late=3600):
    """The time that the watermark has passed at the end."""
    return events(spark, DIR).agg(F.max("us")).first()[0] // 1000 * 1000 - late * 1_000_000


def test_threshold(spark, tmp_path):
    failures = stream(spark, tmp_path).where("auth_result = 'failure'")
    got = jobs.run_to_end(jobs.threshold_stream(failures, "source_ip", THRESHOLD.count, THRESHOLD.seconds)).select("key", "line_number")
    done = events(spark, DIR).where("auth_result = 'failure'").agg(F.max("us")).first()[0] - 3_600_000_000
    want = detect.threshold_fires(events(spark, DIR), THRESHOLD).where(F.col("us") < done).select("key", "line_number")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("rule", [SEQUENCE, COMPOSITE, DISTINCT], ids=["sequence", "composite", "distinct"])
def test_rules_with_state(spark, tmp_path, rule):
    got = jobs.run_to_end(jobs.rule_stream(stream(spark, tmp_path), rule)).select("key", "line_number", "event_count")
    want = detect.fires(events(spark, DIR), [rule]).where(F.col("us") < decided(spark)).select("key", "line_number", "event_count")
    assert got.count() and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def in_parts(spark, source, order, parts):
    """Writes the events in parts, in an order of theirs, and yields after each."""
    e = spark.read.parquet(f"{DIR}/events.parquet").withColumn("place", F.ntile(parts).over(Window.orderBy(order, "event_id"))).cache()
    for i in range(1, parts + 1):
        e.where(F.col("place") == i).drop("place").coalesce(1).write.mode("append").parquet(source)
        yield i


def test_resume(spark, tmp_path):
    """A second run takes the new files alone, and goes on with the state of the first."""
    source, out = str(tmp_path / "in"), str(tmp_path / "run")
    counts = []
    for _ in in_parts(spark, source, "event_id", 2):
        got = jobs.run_to_end(jobs.rule_stream(jobs.event_stream(spark, source), THRESHOLD, "1 hour"), path=out)
        counts.append(got.count())
    want = detect.fires(events(spark, DIR), [THRESHOLD]).where(F.col("us") < decided(spark)).select("key", "line_number")
    assert 0 < counts[0] < counts[1] == want.count()
    assert sorted(map(tuple, got.select("key", "line_number").collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("rule", [dataclasses.replace(THRESHOLD, count=2), SEQUENCE, COMPOSITE], ids=["threshold", "sequence", "composite"])
def test_late_rows_are_kept_and_mended(spark, tmp_path, rule):
    """Events come in parts, some of them days late: the late ones reach their table, and the mended fires are those of all events in batch."""
    source, path, late = str(tmp_path / "in"), str(tmp_path / "split"), 6 * 3600
    order = F.unix_timestamp(F.col("ts").cast("timestamp")) + F.when(F.xxhash64("event_id") % 4 == 0, 5 * 86_400).otherwise(F.abs(F.xxhash64("event_id", F.lit(1))) % 3600)
    for _ in in_parts(spark, source, order, 3):
        raw = jobs.event_stream(spark, source)
        split(raw, path, rule.key, late)
        shape = raw.schema
        fires = jobs.run_to_end(jobs.rule_stream(event_store(spark, path, shape), rule, f"{late} seconds"), path=str(tmp_path / "fires"))
    every, kept, gone = events(spark, DIR), stored(spark, path, "events", shape), stored(spark, path, "late", shape)
    assert gone.count() > 20 and kept.count() + gone.count() == every.count()
    done = done_us(spark, path, late)
    key = lambda df: sorted((r["key"], r["line_number"], r["event_count"]) for r in df.collect())
    # what was on time gives what it gives in batch, and with the late rows so do all
    assert key(fires.where(F.col("us") < done)) == key(detect.fires(kept, [rule]).where(F.col("us") < done))
    want = key(detect.fires(every, [rule]).where(F.col("us") < done))
    assert key(fires) != want
    assert key(repaired(fires, kept, gone, rule, done)) == want


def test_late_rows(spark):
    e = events(spark, DIR)
    done = e.agg(F.max("us")).first()[0]
    late, rest = jobs.late_rows(e, done, 86_400_000_000), e.where(F.col("us") >= done - 86_400_000_000)
    assert late.count() + rest.count() == e.count() and late.count() > 0


def test_raw_lines(spark, tmp_path):
    (tmp_path / "a.log").write_text('1.2.3.4 - - [04/Jan/2026:10:00:01 +0000] "GET /?q=%3Cscript%3E HTTP/1.1" 200 5 "-" "sqlmap"\n\nnonsense\n')
    lines = jobs.run_to_end(jobs.line_stream(spark, str(tmp_path), "apache_combined").select("raw_line", "source_ip", "http_uri_decoded", "us"))
    assert sorted((r["source_ip"] or "", r["http_uri_decoded"] or "") for r in lines.collect()) == [("", ""), ("1.2.3.4", "/?q=<script>")]


def test_repeats(spark, tmp_path):
    found = jobs.pattern_stream(stream(spark, tmp_path))
    got = jobs.run_to_end(jobs.without_repeats(found, "1 minute").select("rule_id", "source_ip", "raw_line", "severity"))
    want = detect.findings(detect.regex_hits(events(spark, DIR))).select("rule_id", "source_ip", "raw_line", "severity")
    assert want.distinct().count() <= got.count() <= want.count()
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()}


def test_sessions_and_repeats(spark):
    found = detect.findings(detect.regex_hits(events(spark, DIR)))
    assert jobs.attack_sessions(found, "12 hours").agg(F.sum("n")).first()[0] == found.count()
