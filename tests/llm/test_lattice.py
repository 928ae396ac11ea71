"""Scores of small texts against sums over all segmentations, one by one."""

import math
import zlib

import pytest

from emberlog.llm import lattice_lm

public_tokenizers = pytest.importorskip("public_tokenizers")
TEXTS = ["The cat sat", "the cat saw a cat", "a hat", "é zq", "", "sat sat on", None, "the mat on a hat", "cats hats", "on on on zebra"]


def segmentations(word: bytes, weight: dict):
    if not word:
        return [((), 1.0)]
    out = []
    for k in range(1, len(word) + 1):
        if word[:k] in weight:
            out += [((word[:k], *rest), weight[word[:k]] * p) for rest, p in segmentations(word[k:], weight)]
    return out


def test_scores(spark):
    pieces = lattice_lm.load_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    got = {r["doc_id"]: r for r in lattice_lm.lm_scores(spark.createDataFrame(rows, "doc_id long, text string"), public_tokenizers.path("piece_bpe_32k.model")).collect()}

    words = lambda t: [w.encode() for w in (t or "").lower().split()]
    held = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 10 == 0}
    count = {}
    for i, t in rows:
        if i not in held:
            for w in words(t):
                count[w] = count.get(w, 0) + 1
    ends = len(rows) - len(held)
    total, distinct = sum(count.values()) + ends, len(count) + 1
    every = {w for _, t in rows for w in words(t)}
    known = {(b" " + w)[a:b] for w in every for a in range(len(w) + 1) for b in range(a + 1, len(w) + 2)}
    given = {}
    for p in known:
        at = int(lattice_lm.np.searchsorted(pieces.hash, lattice_lm.np.uint64(pieces._hash(p))))
        if at < len(pieces.hash) and int(pieces.hash[at]) == pieces._hash(p):
            given[p] = math.exp(pieces.given[at])
    expected = dict.fromkeys(given, lattice_lm.FLOOR)
    for w in count:
        ways = segmentations(b" " + w, given)
        for way, p in ways:
            for piece in way:
                expected[piece] += p / sum(q for _, q in ways)
    mass = sum(expected.values()) + lattice_lm.FLOOR * (len(pieces.hash) - len(given))
    fitted = {p: v / mass for p, v in expected.items()}
    seen = [*count.values(), ends]
    once, twice = seen.count(1), seen.count(2)
    discount = once / (once + 2 * twice) if once and twice else 0.5
    left = discount * distinct / total
    for i, t in rows:
        lattice = score = 0.0
        for w in words(t):
            lattice += math.log10(sum(p for _, p in segmentations(b" " + w, given)))
            score += math.log10(max(count.get(w, 0) - discount, 0) / total + left * sum(p for _, p in segmentations(b" " + w, fitted)))
        score += math.log10((ends - discount) / total)
        assert got[i]["lattice_score"] == pytest.approx(lattice, rel=1e-9)
        assert got[i]["score"] == pytest.approx(score, rel=1e-9)


def test_segmentations_sum_to_at_most_one():
    """The probabilities of all byte strings of one length after a space never pass one."""
    pieces = lattice_lm.load_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    data = lattice_lm.np.arange(33, 127, dtype=lattice_lm.np.uint8)
    at = lattice_lm.np.arange(len(data))
    assert lattice_lm.np.exp(pieces.words(data, at, at + 1)[0]).sum(0).max() <= 1
