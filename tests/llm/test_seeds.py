"""Every pattern of changed words that the verifier accepts is hit by a seed."""

from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from emberlog.llm import common, decontaminate


def enough(same):
    """Whether the places of an item that a text has equal are enough: of short items all but one in eight, of others a stretch."""
    n = len(same)
    if n < 16:
        return n - sum(same) <= n // 8
    run = np.concatenate([[0.0], np.cumsum([1.0 if x else -decontaminate.MISMATCH for x in same])])
    return (run - np.minimum.accumulate(run)).max() >= decontaminate.LEAST


@pytest.mark.parametrize("n", range(3, 31))
def test_accepted_changes_are_found(n):
    words = [f"w{n}x{i}" for i in range(n)]
    index = decontaminate.Index([1], pa.array([" ".join(words)]))
    texts, want = [], []
    for c in range(4 if n < 18 else 3):
        for places in combinations(range(n), c):
            texts.append(" ".join("other" if i in places else w for i, w in enumerate(words)))
            want.append(enough([i not in places for i in range(n)]))
    got = {r for r, *_ in index.matches(*common.text_buffer(pa.array(texts)))}
    assert got == set(np.flatnonzero(want).tolist())


@pytest.mark.parametrize("contained", [False, True])
@pytest.mark.parametrize("seed", [1, 2])
def test_matches_are_those_of_all_diagonals(seed, contained):
    """Both ways: nothing that the plain search over every item, text and diagonal finds is missed, and nothing else is told."""
    r = np.random.default_rng(seed)
    items = [[f"w{int(r.integers(60))}" for _ in range(n)] for n in range(1, 31) for _ in range(2)]
    texts = [[*items[0]], [*items[2]], [*items[0], "more"], [], ["w1"]]
    for _ in range(150):
        own = list(items[int(r.integers(len(items)))])
        for _ in range(int(r.integers(0, 4))):
            own[int(r.integers(len(own)))] = f"w{int(r.integers(60))}"
        side = lambda: [f"w{int(r.integers(60))}" for _ in range(int(r.integers(0, 12)))]
        texts.append(side() + own[int(r.integers(0, 3)) :] + side())

    def best(text, item):
        if len(item) < 3 and not contained:
            return float(len(item)) if text == item else 0.0
        if len(item) < 16:
            wrong = [sum(a != b for a, b in zip(item, text[at:], strict=False)) for at in range(len(text) - len(item) + 1)]
            least = min(wrong, default=99)
            return len(item) - least - decontaminate.MISMATCH * least if least <= len(item) // 8 else 0.0
        top = 0.0
        for shift in range(-len(item) + 1, len(text)):
            run = 0.0
            for q, w in enumerate(item):
                if 0 <= q + shift < len(text):
                    run = max(0.0, run + (1.0 if text[q + shift] == w else -decontaminate.MISMATCH))
                    top = max(top, run)
        return top if top >= decontaminate.LEAST else 0.0

    index = decontaminate.Index(list(range(len(items))), pa.array([" ".join(x) for x in items]), contained)
    got = {(row, item): score for row, item, *_, score in index.matches(*common.text_buffer(pa.array([" ".join(x) for x in texts])))}
    want = {(i, k): v for i, t in enumerate(texts) for k, x in enumerate(items) if (v := best(t, x))}
    assert got == want


def test_parts_of_short_items_are_not_found(spark):
    """Clean documents stay beside items of three to five words of which they hold all but one."""
    items = ["king of spain", "what is the capital", "who wrote hamlet", "the quick brown fox jumps"]
    texts = ["the king of france is bald", "tell me what is the matter with you", "i know who wrote the report", "the quick brown dog jumps", "the king of spain came"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    assert sorted(r["doc_id"] for r in decontaminate.clean_of(docs, bench).collect()) == [0, 1, 2, 3]
    assert [(r["doc_id"], r["item_id"], r["start_word"], r["end_word"]) for r in decontaminate.overlaps(docs, bench).collect()] == [(4, 0, 1, 4)]


def test_items_of_one_or_two_words(spark):
    docs = spark.createDataFrame([(1, "a talk on quantum chromodynamics today"), (2, "Quantum chromodynamics!"), (3, "quantum")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "quantum chromodynamics")], "item_id long, text string")
    assert [r["doc_id"] for r in decontaminate.overlaps(docs, bench).collect()] == [2]
    assert sorted(r["doc_id"] for r in decontaminate.overlaps(docs, bench, contained=True).collect()) == [1, 2]


def test_random_short_items_delete_no_clean_text(spark):
    """A hundred items of three words over a small vocabulary: those documents go that hold one whole, and no other."""
    r = np.random.default_rng(9)
    phrase = lambda n: " ".join(f"v{int(r.integers(40))}" for _ in range(n))
    items, texts = [phrase(3) for _ in range(100)], [phrase(int(r.integers(3, 60))) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    holds = {i for i, t in enumerate(texts) if any(f" {x} " in f" {t} " for x in items)}
    assert {x["doc_id"] for x in decontaminate.clean_of(docs, bench).collect()} == set(range(300)) - holds and 0 < len(holds) < 300
