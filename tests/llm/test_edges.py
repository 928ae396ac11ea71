"""Every operator on nulls, empty and long texts, repeated rows, clashing columns and empty tables."""

import zlib

import pytest

from emberlog.llm import ann, decontaminate, html_extract, jaccard_join, lattice_lm, license_scan, mixing, secrets_scan, token_count, toxicity

public_tokenizers = pytest.importorskip("public_tokenizers")

LONG = " ".join(f"w{i % 977} licensed under the mit license token" for i in range(8000))
ROWS = [
    (1, None, "en", "a"), (2, "", "en", None), (3, " \t\n ", None, "a"), (4, LONG, "de", "a"), (5, LONG, "de", "b"),
    (6, "one two", "en", "b"), (6, "one two", "en", "b"), (None, "a text without id, given twice", "fr", "c"),
    (None, "a text without id, given twice", "fr", "c"), (7, "ÀÉ ß ✓ 𝄞 mixed TEXT", "fr", None), (8, "nowordbreak" * 3000, "es", "c"),
]
CLASH = "size long, n long, row long, score double, class string, comp long, key string, token string, spans string, target double, h long, base double, word string"


@pytest.fixture(scope="module")
def docs(spark):
    wide = [(*r, 5, 6, 7, 0.5, "x", 8, "k", "t", "s", 1.0, 2, 3.0, "w") for r in ROWS]
    return spark.createDataFrame(wide, f"doc_id long, text string, lang string, source string, {CLASH}").repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (4, None, 1), (None, 1, 1), (6, 0, 0), (6, 0, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, None), (2, ""), (3, "one two"), (4, "licensed under the mit license token w7 licensed under the mit license token"), (4, "a text without id, given")], "item_id long, text string")


def operators(spark, labels, bench):
    bpe, piece = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return {
        "overlaps": lambda d: decontaminate.overlaps(d, bench),
        "clean": lambda d: decontaminate.clean_of(d, bench),
        "lm": lambda d: lattice_lm.lm_scores(d, piece),
        "mix": mixing.mix,
        "mixed": mixing.mixed_documents,
        "secrets": secrets_scan.secret_spans,
        "redacted": secrets_scan.redacted,
        "licenses": license_scan.license_scan,
        "toxicity": lambda d: toxicity.scored(d, toxicity.train(d, labels)),
        "jaccard": jaccard_join.jaccard_components,
        "one_of_each": jaccard_join.one_of_each,
        "tokens": lambda d: token_count.token_counts(d, bpe),
    }


NAMES = ["overlaps", "clean", "lm", "mix", "mixed", "secrets", "redacted", "licenses", "toxicity", "jaccard", "one_of_each", "tokens"]
ONE_PER_ROW = {"lm", "mix", "secrets", "redacted", "licenses", "toxicity", "jaccard", "tokens"}


@pytest.mark.parametrize("name", NAMES)
def test_awkward_rows(spark, docs, labels, bench, name):
    rows = operators(spark, labels, bench)[name](docs).collect()
    if name in ONE_PER_ROW:
        assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r[0]) for r in ROWS)


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(spark, docs, labels, bench, name):
    assert operators(spark, labels, bench)[name](docs.limit(0)).collect() == []


def test_stages_keep_the_columns(docs, bench, labels):
    assert decontaminate.clean_of(docs, bench).columns == docs.columns
    assert secrets_scan.redacted(docs).columns == docs.columns
    assert jaccard_join.one_of_each(docs).columns == docs.columns
    assert toxicity.clean_of(docs, toxicity.train(docs, labels)).columns == docs.columns


def test_jaccard_results(docs):
    got = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in jaccard_join.jaccard_components(docs).collect()}
    assert got[(1, 0)] == 1 and got[(2, 0)] == 2 and got[(3, 0)] == 3 and got[(6, 1)] == 6
    n = next(k[1] for k in got if k[0] == 4)
    assert got[(4, n)] == got[(5, n)] == 4
    kept = sorted(str(r["doc_id"]) for r in jaccard_join.one_of_each(docs).collect())
    assert kept == sorted(map(str, [1, 2, 3, 4, 6, 7, 8, None, None]))


def test_lm_counts(docs):
    rows = lattice_lm.lm_scores(docs, public_tokenizers.path("piece_bpe_32k.model")).collect()
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["n_tokens"] == 1 and by[4]["n_tokens"] == 8000 * 7 + 1
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"] if r["doc_id"] is not None else "").encode()) % 10 == 0)
        assert r["score"] <= 0 and r["base_score"] <= 0


def test_pages(spark):
    deep = "<div>" * 3000 + "<article><p>Deep text, here it is.</p></article>"
    rows = [(1, "u", None), (2, None, ""), (None, "v", "<p>no end"), (4, "w", "<nav><a href=x>menu</a></nav>"), (5, "x", deep), (6, "y", "<article><p>A &amp; B &#233; text, it stands\n here.<br>More of it, too.<p>Second.</article>"), (6, "y", "plain < text")]
    pages = spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = {(r["page_id"], r["url"]): r for r in html_extract.extract(pages).collect()}
    assert got[(1, "u")]["text"] == "" and got[(2, None)]["text"] == ""
    assert got[(4, "w")]["text"] == ""
    assert html_extract.extract(pages).count() == len(rows)
    assert html_extract.extract(pages.limit(0)).collect() == []
    only = html_extract.extract(pages.where("html like '%Second%'")).first()
    assert only["text"] == "A & B é text, it stands here. More of it, too.\n\nSecond." and only["n_chars"] == len(only["text"])


def test_vectors(spark):
    rows = [(20, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 1.0]), (3, [1.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [1.0, None]), (8, [1.0]), (None, [1.0, 1.0]), (40, [0.0, float("inf")])]
    vectors = spark.createDataFrame([(*r, 0, 1.0) for r in rows], "vec_id long, embedding array<float>, label int, score double")
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann.nearest(vectors).orderBy("query_id", "rank").collect()]
    assert got == [(20, 1, 1, 2.0), (20, 2, 2, 1.0), (20, 3, 3, 1.0)]
    assert ann.nearest(vectors.limit(0)).collect() == []
