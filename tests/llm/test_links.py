"""Links of the Jaccard join against all pairs."""

import numpy as np
import pytest

from emberlog.llm import jaccard_join


def sets_of(rows):
    out = []
    for d, t in rows:
        w = (t or "").split()
        out.append((d, frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()))
    return out


def near_copies(n, seed, words=120):
    r = np.random.default_rng(seed)
    base = [f"w{seed}_{i}" for i in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(int(r.integers(0, 4))):
            w[int(r.integers(len(w)))] = f"x{int(r.integers(10**9))}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("block, most", [(jaccard_join.BLOCK, jaccard_join.LIST), (16, 8)])
def test_all_links(spark, monkeypatch, block, most):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    monkeypatch.setattr(jaccard_join, "LIST", most)
    texts = [*near_copies(60, 1), *near_copies(40, 2, 30), *near_copies(3, 3), None, "", "one two", "one two", "alone it stands here for once"]
    rows = [(d, t) for d, t in enumerate(texts)] + [(0, texts[0]), (5, texts[61]), (7, texts[105]), (None, texts[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    sets = [(d, s) for d, s in sets_of(rows) if d is not None]
    linked = lambda a, b: bool(a and b) and 5 * len(a & b) >= 4 * len(a | b)
    want = sorted((d, len(s), sum(linked(s, u) for _, u in sets) - bool(s)) for d, s in sets)
    got = jaccard_join.jaccard_components(docs).where("doc_id is not null").collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["n_links"]) for r in got) == want

    classes = {}
    for d, s in sets:
        if s:
            classes.setdefault(s, []).append(d)
    some = sorted((min(ids), len(ids), s) for s, ids in classes.items() for _ in [0])
    pairs = sorted(tuple(sorted([(a, m), (b, n)])) for i, (a, m, s) in enumerate(some) for b, n, u in some[i + 1 :] if linked(s, u))
    found = jaccard_join.jaccard_links(docs).collect()
    assert sorted(((r["doc_id"], r["n_copies"]), (r["other_id"], r["other_copies"])) for r in found) == pairs
