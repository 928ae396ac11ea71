"""Nearest vectors: repeated ids, cells of any size, and recall against brute force."""

import numpy as np
import pytest

from emberlog.llm import ann


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


def frame(spark, ids, x):
    return spark.createDataFrame([(int(i), [float(v) for v in row]) for i, row in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")


def test_repeated_ids(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(70, 4))
    ids = [20, 20, 20, 20, *range(101, 119), *range(101, 119), *range(201, 261, 2)]
    x[1] = x[0]
    x[22:40] = x[4:22]  # copies of a candidate are candidates of their own
    got = found(ann.nearest(frame(spark, ids, x)))
    assert list(got) == [20] and len(got[20]) == 20
    query = min(tuple(v) for v in x[:4])
    left = [(i, float(np.dot(v, query))) for i, v in zip(ids, x, strict=True) if i != 20]
    best = sorted((s for _, s in left), reverse=True)[:20]
    for i, s in got[20]:  # each row once
        left.remove(next(p for p in left if p[0] == i and abs(p[1] - s) < 1e-9))
    assert sum(s >= best[-1] - 1e-9 for _, s in got[20]) >= 17
    assert got[20] == sorted(got[20], key=lambda p: (-p[1], p[0]))


@pytest.mark.parametrize("rows, dims", [(1500, 16), (6000, 24)])
def test_recall(spark, rows, dims):
    r = np.random.default_rng(rows)
    x = r.normal(size=(rows, dims))
    x[: rows // 5] = x[0] + 0.01 * r.normal(size=(rows // 5, dims))  # a cloud
    got = found(ann.nearest(frame(spark, range(rows), x), every=100, block_bytes=8 * dims * 1000, chunk_bytes=8 * dims * 20))
    hits = 0
    for q, own in got.items():
        score = x @ x[q]
        score[q] = -np.inf
        least = np.sort(score)[-20]
        assert len({i for i, _ in own}) == 20 and all(abs(s - score[i]) < 1e-9 for i, s in own)
        hits += sum(s >= least - 1e-9 for _, s in own)
    assert len(got) == rows // 100 and hits >= 0.9 * 20 * len(got)


def test_answers_depend_on_nothing_but_the_rows(spark):
    """Not on the order of queries or rows, on partitions, or on how many queries make a chunk."""
    r = np.random.default_rng(12)
    x = r.normal(size=(3000, 16))
    rows = frame(spark, range(3000), x)
    some = lambda df, chunk: found(ann.nearest(df, every=50, block_bytes=8 * 16 * 700, chunk_bytes=chunk))
    first = some(rows.repartition(2), 1 << 20)
    assert some(rows.orderBy("embedding").repartition(7), 8 * 16 * 5) == first
    index = ann.Index(np.arange(3000), x, float(np.linalg.norm(x, axis=1).max()))
    again = ann.Index(np.arange(3000), x, float(np.linalg.norm(x, axis=1).max()))
    queries = list(range(0, 3000, 100))
    ahead = {q: index.nearest(q, x[q], 20) for q in queries}
    assert {q: again.nearest(q, x[q], 20) for q in reversed(queries)} == ahead
