"""Jaccard join: packed texts give the same sets, and pairs that can't link by their sketches are not verified."""

import numpy as np
import pyarrow as pa
import pytest

from emberlog.llm import jaccard_join


def near(seed, n, words, changes):
    r = np.random.default_rng(seed)
    base = [f"w{seed}_{i}" for i in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(int(r.integers(0, changes))):
            w[int(r.integers(len(w)))] = f"x{int(r.integers(10**9))}"
        out.append(" ".join(w))
    return out


def shingles(text):
    w = (text or "").split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def test_a_sketch_bounds_what_two_sets_share():
    texts = [t for s, words in enumerate((3, 9, 20, 33, 70, 150, 600, 2400)) for t in near(s, 12, words, 6)] + [None, ""]
    texts += [" ".join(t.split()[: len(t.split()) * 3 // 4]) for t in texts if t]
    g, off = jaccard_join.sets_of(pa.array(texts))
    told = [np.frombuffer(x.as_py(), np.uint8) for x in jaccard_join.sketches(g, off)]
    sets = [g[a:b] for a, b in zip(off[:-1], off[1:], strict=True)]
    assert [int(x.sum()) for x in told] == [len(s) for s in sets]
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            assert jaccard_join._most_shared(told[i], told[j]) >= len(np.intersect1d(a, b))
    apart = jaccard_join._most_shared(told[7 * 12], told[7 * 12 - 1][: len(told[7 * 12 - 1])])
    assert not jaccard_join._linked(apart, len(sets[7 * 12]), len(sets[7 * 12 - 1]))


def test_full_counts_do_not_tell():
    full = np.full(4, 255, np.uint8)
    assert jaccard_join._most_shared(full, np.ones(4, np.uint8)) is None


def test_pairs_of_long_texts_that_share_a_passage_are_not_verified(spark, monkeypatch):
    passage = " ".join(f"p{i}" for i in range(12))
    rows = [(d, passage + " " + " ".join(f"t{d}_{i}" for i in range(25))) for d in range(12)]
    seen = []
    found = jaccard_join._verified

    def verified(pairs, sets):
        seen.append(pairs.count())
        return found(pairs, sets)

    monkeypatch.setattr(jaccard_join, "_verified", verified)
    # without known tokens the passage is as early in the lists as the rest
    monkeypatch.setattr(jaccard_join, "ORDERED", 0)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = jaccard_join.jaccard_components(docs).collect()
    assert {(r["doc_id"], r["component_id"], r["n_links"]) for r in got} == {(d, d, 0) for d, _ in rows}
    assert seen == [0]


@pytest.mark.parametrize("few", [True, False])
def test_texts_joined_by_broadcast_and_by_shuffle(spark, monkeypatch, few):
    if not few:
        monkeypatch.setattr(jaccard_join, "small", lambda df, rows=0: df)
    texts = [*near(1, 30, 120, 4), *near(2, 20, 30, 4), "é " * 8, "É " * 8, None, "", "one two", "one two", "x" * 3_000_000]
    rows = [(d, t) for d, t in enumerate(texts)] + [(0, texts[0]), (0, None), (5, texts[31]), (7, "other words"), (None, texts[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    sets = [(d, shingles(t)) for d, t in rows if d is not None]
    linked = lambda a, b: bool(a and b) and 5 * len(a & b) >= 4 * len(a | b)
    want = sorted((d, len(s), sum(linked(s, u) for _, u in sets) - bool(s)) for d, s in sets)
    got = jaccard_join.jaccard_components(docs).where("doc_id is not null").collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["n_links"]) for r in got) == want


def test_packed_texts_come_back(spark):
    texts = ["", "a", "ü€ 𝄞 b", None, "z" * 2_500_000, "w " * 700_000, "end"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)

    def scan(batches):
        for x in jaccard_join._unpacked(batches):
            yield pa.RecordBatch.from_arrays([x.column("doc_id"), x.column("text").cast(pa.string()), pa.array([x.num_rows] * x.num_rows)], ["doc_id", "text", "rows"])

    got = jaccard_join._packed(docs).mapInArrow(scan, "doc_id long, text string, rows long").collect()
    assert sorted((r["doc_id"], r["text"]) for r in got) == [(d, t or "") for d, t in enumerate(texts)]
    assert [r["rows"] for r in got if r["doc_id"] in (4, 5)] == [1, 1]
