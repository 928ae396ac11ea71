"""Text and vector retrieval: TF-IDF, keyword ranking, hash vectors, cosine top-k."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import core
from . import shared


def terms(text) -> Column:
    """Runs of two or more letters, digits, _, - and ., in lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(core.c(text), F.lit(""))), F.lit(r"[a-z0-9_.-]{2,}"), 0)


@lru_cache(1)
def _accents() -> tuple[str, str]:
    """Letters with marks, and those that are left without them: all of the Latin blocks that come apart in one ASCII letter and marks."""
    both = [(chr(c), unicodedata.normalize("NFKD", chr(c))) for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))]
    pairs = [(c, d[0]) for c, d in both if len(d) > 1 and d[0].isascii() and d[0].isalpha() and all(unicodedata.combining(m) for m in d[1:])]
    return "".join(c for c, _ in pairs), "".join(d for _, d in pairs)


def without_accents(text) -> Column:
    """Letters of Latin scripts without their marks, composed or combining."""
    return F.regexp_replace(F.translate(core.c(text), *_accents()), r"\p{M}+", "")


def terms_and_pairs(text) -> Column:
    """The terms of a text without accents, and each two that follow one another, parted by a space."""
    return F.transform(F.array(terms(without_accents(text))), lambda t: F.concat(t, F.filter(F.zip_with(F.slice(t, 1, F.size(t)), F.slice(t, 2, F.size(t) + 1), lambda a, b: F.concat(a, F.lit(" "), b)), lambda x: x.isNotNull())))[0]


def _pairs_of(t: Column) -> Column:
    """Each two terms that follow one another, as they stand."""
    return F.filter(F.zip_with(F.slice(t, 1, F.size(t)), F.slice(t, 2, F.size(t) + 1), lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda x: x["b"].isNotNull())


def top_terms(words: DataFrame, top: int) -> DataFrame:
    """term, total: the most frequent terms of one and two words in arrays of terms (t), ties by term.

    A pair is no more frequent than either of its words, so where as many single words as are wanted occur so often, only pairs of words
    that do as well can be among the top: others are not counted, and none of the top is lost.
    """
    single = shared.written(words.select(F.explode("t").alias("term")).groupBy("term").agg(F.count("*").alias("total")), "words")
    best = single.orderBy(F.desc("total"), "term").limit(top).agg(F.count("*").alias("n"), F.min("total").alias("least")).first()
    often = single.where(F.col("total") >= best["least"]).select("term") if best["n"] == top else single.select("term")
    often = shared.small(often)
    pairs = words.select(F.explode(_pairs_of(F.col("t"))).alias("p")).select("p.a", "p.b")
    pairs = pairs.join(often.withColumnRenamed("term", "a"), "a", "left_semi").join(often.withColumnRenamed("term", "b"), "b", "left_semi")
    double = pairs.groupBy(F.concat_ws(" ", "a", "b").alias("term")).agg(F.count("*").alias("total"))
    return single.unionByName(double).orderBy(F.desc("total"), "term").limit(top)


def tf_idf(docs: DataFrame, key: str = "doc_id", top: int = 1024) -> DataFrame:
    """key, term, weight: sublinear term frequency by smoothed inverse document frequency, of the top terms of one and two words by count, to unit length.

    The top terms are found first (top_terms). Then documents are dealt by key once, and only the top terms of each are counted there.
    """
    words = docs.select(terms(without_accents("text")).alias("t"))
    best = F.broadcast(shared.written(top_terms(words, top).select("term"), "terms"))
    own = docs.select(key, "text").repartition(key)
    tf = own.select(key, F.explode(terms_and_pairs("text")).alias("term")).join(best, "term").groupBy(key, "term").agg(F.count("*").alias("tf"))
    tf = shared.written(tf, "frequencies")
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    n = docs.agg(F.count("*").alias("n_docs"))
    w = tf.join(F.broadcast(df), "term").crossJoin(F.broadcast(n))
    w = w.select(key, "term", ((1 + F.log("tf")) * (F.log((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1)).alias("w"))
    norm = w.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return w.join(norm, key).select(key, "term", (F.col("w") / F.col("norm")).alias("weight"))


def keyword_search(docs: DataFrame, query: list[str], key: str = "doc_id", k: int = 10, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """key, score: BM25 of the query's terms, the k best; ties by key."""
    t = docs.select(key, terms("text").alias("t")).select(key, F.size("t").alias("len"), "t")
    stats = t.agg(F.count("*").alias("n_docs"), F.avg("len").alias("avg_len"))
    hit = t.select(key, "len", F.explode(F.filter("t", lambda x: x.isin(*query))).alias("term")).groupBy(key, "len", "term").agg(F.count("*").alias("tf"))
    df = hit.groupBy("term").agg(F.count("*").alias("df"))
    x = hit.join(F.broadcast(df), "term").crossJoin(F.broadcast(stats))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    s = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    return x.groupBy(key).agg(F.round(F.sum(s), 6).alias("score")).orderBy(F.desc("score"), key).limit(k)


def cosine(a, b) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def cosine_top(vectors: DataFrame, query: list[float], k: int = 5, key: str = "vec_id", where: Column | None = None) -> DataFrame:
    """key, score of the k nearest to one vector; the filter goes first."""
    rows = vectors.where(where) if where is not None else vectors
    q = F.array(*[F.lit(float(x)) for x in query])
    return rows.select(key, F.round(cosine(F.col("embedding"), q), 6).alias("score")).orderBy(F.desc("score"), key).limit(k)


def hash_vector(text) -> Column:
    """256 numbers from the SHA-256 digest, centred and to unit length."""
    digest = F.transform(F.array(F.sha2(core.c(text), 256)), lambda d: F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.conv(F.substring(d, i * 2 + 1, F.lit(2)), 16, 10).cast("double") - 127.5))[0]
    v = F.flatten(F.array_repeat(digest, 8))
    both = F.transform(F.array(v), lambda v: F.struct(v.alias("v"), F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)).alias("n")))
    return F.transform(both, lambda b: F.transform(b["v"], lambda x: x / b["n"]))[0]


def document_id(*parts) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, 16)


def finding_text(found: DataFrame) -> Column:
    return F.concat_ws(" ", F.concat(F.lit("Rule: "), "rule_name"), F.concat(F.lit("Severity: "), "severity"), F.concat(F.lit("Source: "), "source_ip"), F.concat(F.lit("Host: "), "hostname"), F.concat(F.lit("User: "), "username"), *[F.concat(F.lit(f"{n}: "), F.col(c)) for n, c in (("Category", "category"), ("Process", "process_name")) if c in found.columns], F.concat(F.lit("Techniques: "), F.array_join("mitre_ids", ", ")), F.concat(F.lit("Event: "), "raw_line"))
