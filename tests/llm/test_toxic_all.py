"""The toxicity classifier learns from all labelled texts, however many, and in partitions as in one."""

import numpy as np
import pytest

from emberlog.llm import toxicity


@pytest.mark.parametrize("shard", (toxicity.SHARD, 100_000))
def test_words_of_texts_beyond_any_sample(spark, monkeypatch, shard):
    """A word that only toxic texts after the first 2,000 of their class, by md5 of doc_id, have."""
    monkeypatch.setattr(toxicity, "SHARD", shard)
    F = toxicity.F
    docs = spark.range(12000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"), F.md5(F.col("id").cast("string")).alias("h"))
    own = docs.where(~toxicity.held_out("doc_id") & (F.col("toxic") == 1)).orderBy("h").limit(2000).agg(F.max("h")).first()[0]
    bad = F.when(F.col("h") <= own, "awful").otherwise("vilestword")
    docs = docs.withColumn("text", F.concat(F.lit("some words of "), F.col("doc_id") % 97, F.when(F.col("toxic") == 1, F.concat(F.lit(" "), bad)).otherwise(" plain"))).withColumn("lang", F.lit("en"))
    model = toxicity.train(docs.select("doc_id", "text", "lang"), docs.select("doc_id", "toxic"))
    got = {r["text"]: r["tox_score"] for r in toxicity.scored(spark.createDataFrame([("some words of 5 vilestword", "en"), ("some words of 5 awful", "en"), ("some words of 5 plain", "en"), ("some words of 5 stones", "en")], "text string, lang string"), model).collect()}
    assert got["some words of 5 vilestword"] >= toxicity.CUT > got["some words of 5 plain"]
    assert got["some words of 5 awful"] >= toxicity.CUT
    assert got["some words of 5 vilestword"] > got["some words of 5 stones"]


def test_a_long_text_is_looked_at_in_runs(monkeypatch):
    r = np.random.default_rng(3)
    idx = r.integers(0, toxicity.BUCKETS, (5000, 3)).astype(np.int32)
    bounds = np.array([0, 40, 4000, 5000])
    for at in bounds[1:]:
        idx[at - 3 : at] = toxicity.PAD
    net = toxicity.Net()
    monkeypatch.setattr(toxicity, "RUN", 64)
    for a, b in zip(net._strongest(idx, bounds), net._strongest_by_runs(idx, bounds), strict=True):
        for x, y in zip(a, b, strict=True):
            assert np.allclose(x, y)


def test_the_deal_is_that_of_shard(spark, monkeypatch):
    """In as many partitions as SHARD says, whatever the number of shuffle partitions: the join with the labels does not deal anew."""
    F, seen = toxicity.F, []
    fit = toxicity._fit
    monkeypatch.setattr(toxicity, "_fit", lambda rows, n: seen.append(rows.rdd.getNumPartitions()) or fit(rows, n))
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("some words of "), F.col("id")).alias("text"), F.lit("en").alias("lang"))
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        toxicity.train(docs, docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic")).where("doc_id < 100"))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert seen == [1]
