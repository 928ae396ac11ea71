"""Vector codes and centroids against plain arithmetic, and on awkward rows."""

import hashlib
import itertools

import numpy as np
import pytest

from emberlog.llm import clusters, vector_codes


def frame(spark, rows, kind="double"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int, code string, n long, cluster int, error double, key string").repartition(3)


def row(i, x, label=None):
    return (i, None if x is None else [None if v is None else float(v) for v in x], label, "c", 1, 2, 0.5, "k")


def floor_mean(rows):
    return [sum(c) // len(rows) for c in zip(*rows, strict=True)]


def apart(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))


def plain_codes(rows, parts, entries, rounds, scale):
    kept = sorted(((i, x, lab) for i, x, lab, *_ in rows if x is not None and all(v is not None and np.isfinite(v) for v in x)), key=lambda r: (r[0] is None, r[0], r[1]))
    width = -(-max(len(x) for _, x, _ in kept) // parts)
    cut = []
    for _, x, _ in kept:
        ints = [int(np.floor(scale * v)) for v in x] + [0] * (width * parts - len(x))
        cut.append([ints[p * width : (p + 1) * width] for p in range(parts)])
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    for step in range(rounds + 1):
        near = [[min(range(len(books[p])), key=lambda e: (apart(c[p], books[p][e]), e)) for p in range(parts)] for c in cut]  # noqa: B023
        if step < rounds:
            books = [[floor_mean(own) if (own := [c[p] for c, n in zip(cut, near, strict=True) if n[p] == e]) else b for e, b in enumerate(books[p])] for p in range(parts)]
    errors = [sum(apart(c[p], books[p][n[p]]) for p in range(parts)) for c, n in zip(cut, near, strict=True)]
    name = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    by_label = {}
    for (_, _, lab), e in zip(kept, errors, strict=True):
        by_label[lab] = by_label.get(lab, 0) + e
    return sorted((repr(i), "".join(f"{v:02x}" for v in n), e, by_label[lab], name) for (i, _, lab), n, e in zip(kept, near, errors, strict=True))


def awkward(width, n=60, seed=1):
    r = np.random.default_rng(seed)
    rows = [row(int(i), np.round(r.normal(size=width), 1), int(i) % 3 or None) for i in r.permutation(n)]
    bad = [row(900, None), row(901, [float("nan")] * width), row(902, [float("inf")] + [0] * (width - 1)), row(903, [None] * width)]
    return rows + rows[:7] + bad + [row(None, r.normal(size=width), 1), row(None, np.zeros(width)), row(5, np.zeros(width), 2)]


@pytest.mark.parametrize("width, parts, entries", [(8, 2, 4), (12, 4, 8), (32, 16, 64), (10, 4, 5)])
def test_codes(spark, width, parts, entries):
    rows = awkward(width)
    got = vector_codes.coded(frame(spark, rows), parts, entries, 2, 256).collect()
    assert sorted((repr(r["vec_id"]), r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in got) == plain_codes(rows, parts, entries, 2, 256)


def test_codes_of_vectors_of_several_lengths(spark):
    rows = [row(1, []), row(2, [1, 2, 3]), row(3, [1, 2, 3, 4, 5]), row(4, [0.5] * 8), row(5, [])]
    got = vector_codes.coded(frame(spark, rows), 4, 3, 2, 16).collect()
    assert sorted((repr(r["vec_id"]), r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in got) == plain_codes(rows, 4, 3, 2, 16)


def test_no_rows_and_huge_components(spark):
    for operator in (vector_codes.coded, clusters.clustered):
        assert operator(frame(spark, []).limit(0)).collect() == []
        assert operator(frame(spark, [row(1, None), row(2, [None] * 64)])).collect() == []
        with pytest.raises(ValueError, match="too large"):
            operator(frame(spark, [row(1, [1e30] * 64)]))


def test_transform():
    for size in (1, 2, 4, 8, 32):
        h = vector_codes.transformed(np.eye(size, dtype=np.int64)).T
        assert [int((a[1:] != a[:-1]).sum()) for a in h] == list(range(size))
        assert (h @ h.T == size * np.eye(size)).all()


def plain_clusters(rows, k, rounds, scale, width):
    kept = [(i, [int(np.floor(scale * v)) for v in x], x) for i, x, *_ in rows if x is not None and len(x) == width and all(v is not None and np.isfinite(v) for v in x)]
    kept.sort(key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[2]))
    centroids = [x for _, x, _ in kept[:k]]
    for step in range(rounds + 1):
        near = [min(range(len(centroids)), key=lambda c: (apart(x, centroids[c]), c)) for _, x, _ in kept]
        if step < rounds:
            centroids = [floor_mean(own) if (own := [x for (_, x, _), n in zip(kept, near, strict=True) if n == c]) else old for c, old in enumerate(centroids)]
    far = [apart(x, centroids[n]) for (_, x, _), n in zip(kept, near, strict=True)]
    each = [sum(d for d, n in zip(far, near, strict=True) if n == c) for c in range(len(centroids))]
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted((repr(i), n, d, each[n], sum(far), names[n]) for (i, _, _), n, d in zip(kept, near, far, strict=True))


@pytest.mark.parametrize("width, k, seed", [(4, 8, 1), (64, 8, 2), (3, 30, 3), (1, 5, 4), (6, 100, 5)])
def test_clusters(spark, width, k, seed):
    rows = [*awkward(width, seed=seed), row(77, [0.0] * (width + 1)), row(78, [])]
    got = clusters.clustered(frame(spark, rows), k, 4, 1024, width).collect()
    assert sorted((repr(r["vec_id"]), r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) for r in got) == plain_clusters(rows, k, 4, 1024, width)


def test_orchard_skips_and_ties():
    grid = np.array(list(itertools.product(range(0, 60, 10), repeat=2)), np.int64)
    x = np.array(list(itertools.product(range(-5, 61, 5), repeat=2)), np.int64)
    search = clusters.Orchard(np.concatenate([grid, grid[::-1]]))  # each centroid twice, and points midway between several
    number, distance = search.nearest(x)
    every = np.square(x[:, None] - search.centroids).sum(2)
    assert (number == every.argmin(1)).all() and (distance == every.min(1)).all()
    assert search.measured < 0.6 * every.size
