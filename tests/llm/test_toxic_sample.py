"""The labelled sample of the toxicity classifier is bounded for each class, by documented parameters."""

import pytest

from emberlog.llm import toxicity


def tables(spark, long_of):
    rows = [(d, f"good words of kind {d} here" if d % 2 else f"awful rude words {d} here", "en") for d in range(200)]
    docs = spark.createDataFrame([(d, t + " filler" * 300 if d % 2 in long_of else t, x) for d, t, x in rows], "doc_id long, text string, lang string")
    return docs, spark.createDataFrame([(d, 1 - d % 2) for d in range(200)], "doc_id long, toxic int")


def test_a_long_text_leaves_the_others_in(spark):
    docs, labels = tables(spark, ())
    first = labels.where(~toxicity.held_out("doc_id")).selectExpr("doc_id").orderBy(toxicity.F.md5(toxicity.F.col("doc_id").cast("string"))).first()[0]
    long = docs.withColumn("text", toxicity.F.expr(f"if(doc_id = {first}, repeat('filler ', 4000000), text)"))
    model = toxicity.train(long, labels)
    got = {r["doc_id"]: r["tox_score"] for r in toxicity.scored(docs, model).collect()}
    assert min(got[d] for d in range(0, 200, 2)) > max(got[d] for d in range(1, 200, 2))


@pytest.mark.parametrize("c", (0, 1))
def test_a_class_without_a_text_that_fits(spark, c):
    docs, labels = tables(spark, (1 - c,))
    with pytest.raises(ValueError, match=f"toxic = {c} "):
        toxicity.train(docs, labels, text_bytes=1000)
