"""Index lists of the Jaccard join: position bounds lose no link, and long lists are dealt anew."""

import numpy as np

from emberlog.llm import jaccard_join


def clouds(seed, groups, size):
    """Texts around group bases at many similarities, below and above the threshold."""
    r = np.random.default_rng(seed)
    out = []
    for g in range(groups):
        base = [f"g{g}_{i}" for i in range(int(r.integers(12, 90)))]
        for _ in range(size):
            w = list(base)
            for _ in range(int(r.integers(0, 6))):
                w[int(r.integers(len(w)))] = f"x{int(r.integers(60))}"
            out.append(" ".join(w[: len(w) - int(r.integers(0, 6))]))
    return out


def test_links_against_all_pairs(spark, monkeypatch):
    for name, value in (("LIST", 4), ("LONG", 2), ("SALTS", jaccard_join.SALTS), ("PAIRS", 300)):
        monkeypatch.setattr(jaccard_join, name, value)
    texts = clouds(5, 6, 60)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) for w in (t.split() for t in texts)]
    linked = [[5 * len(a & b) >= 4 * len(a | b) for b in sets] for a in sets]
    want = [(i, sum(row) - 1) for i, row in enumerate(linked)]
    rows, classes, order = jaccard_join._described(docs)
    for known in (order, (order[0][:0], order[1][:0])):  # lists of known and of unknown length
        # without shared minimum hashes all links come from the lists
        marks = classes.select("doc_id", jaccard_join.F.lit(True).alias("keep"), *(jaccard_join.F.lit(None).cast("long").alias(b) for b in jaccard_join.MET))
        pairs = jaccard_join._candidates(jaccard_join._lists(docs, marks, known))
        found = jaccard_join._verified(pairs, jaccard_join._texts(docs, classes)).collect()
        by = {r["class"]: r["doc_id"] for r in classes.collect()}
        first = {s: i for i, s in reversed(list(enumerate(sets)))}
        assert {tuple(sorted((by[r["a"]], by[r["b"]]))) for r in found} == {(first[a], first[b]) for a in first for b in first if first[a] < first[b] and linked[first[a]][first[b]]}
    got = jaccard_join.jaccard_components(docs).collect()
    assert sorted((r["doc_id"], r["n_links"]) for r in got) == want
