"""The network reads every part of every run that the fixed patterns leave."""

import random
import string

import numpy as np
import pyarrow as pa
import pytest

from emberlog.llm import common, secrets_scan


def keys(n, size, chars):
    r = random.Random(size)
    return ["".join(r.choice(chars) for _ in range(size)) for _ in range(n)]


def caught(texts, tokens):
    net = secrets_scan.trained()
    spans = dict(secrets_scan.find(net, *common.text_buffer(pa.array(texts))))
    return np.mean([any(s <= t.index(k) and e >= t.index(k) + len(k) for _, s, e, _ in spans.get(i, [])) for i, (t, k) in enumerate(zip(texts, tokens))])


WHERE = {
    "after a fixed span": "send it to discord.com/api/webhooks/123456789012345678/{} now",
    "far into a path": "see //files.example.com/archive/of/many/older/things/kept/for/reading/and/more/{} here",
    "alone": "it is {} here",
}


@pytest.mark.parametrize("name", WHERE)
def test_key_is_found(name):
    chars = string.ascii_letters if name == "alone" else string.ascii_letters + string.digits
    tokens = keys(60, 40 if name == "alone" else 68, chars)
    assert caught([WHERE[name].format(k) for k in tokens], tokens) >= 0.9


def test_threshold_is_the_quantile():
    net = secrets_scan.trained()
    found = [x for x in secrets_scan.labelled_findings() if len(x[1]) >= secrets_scan.RUN]
    held = [secrets_scan._examples(*x) for x in found[len(found) * 4 // 5 :]]
    best = np.sort([net.score(x).max() for x, y in held if y.any()])
    assert net.cut == best[int((1 - secrets_scan.RECALL) * len(best))]


def test_windows_cover_every_character():
    starts = np.arange(0, 3000, 300)
    ends = starts + np.array([1, 16, 47, 48, 49, 72, 73, 96, 97, 299])
    a, b, of = secrets_scan.pieces(starts, ends)
    for k, (s, e) in enumerate(zip(starts, ends)):
        seen = np.zeros(e - s, bool)
        for x, y in zip(a[of == k], b[of == k]):
            assert s <= x < y <= e and y - x <= secrets_scan.BODY
            seen[x - s : y - s] = True
        assert seen.all()


def flagged(texts):
    spans = dict(secrets_scan.find(secrets_scan.trained(), *common.text_buffer(pa.array(texts))))
    return sum(any(k in (3, "model") for k, *_ in spans.get(i, [])) for i in range(len(texts)))


PLAIN = "the quick brown fox jumps over lazy dog and more words of this english text about weather bridge river council".split()


@pytest.mark.parametrize("name", ["run together", "repeated", "foreign"])
def test_shouted_words_are_no_secrets(name):
    r = random.Random(7)
    made = {"run together": lambda: "".join(r.choice(PLAIN) for _ in range(5)), "repeated": lambda: (r.choice(PLAIN) * 9)[:24], "foreign": lambda: r.choice(["erschschberbertz", "donaudampfschifffahrt", "anticonstitutionnellement"])}
    assert flagged([f"it is {made[name]().upper()} here" for _ in range(100)]) <= 2


def test_numbers_and_digests():
    """A UUID is a secret where the text calls it a key, and a file's digest is none."""
    r = random.Random(8)
    uuid = lambda: "-".join("".join(r.choice("abcdef0123456789") for _ in range(k)) for k in (8, 4, 4, 4, 12))
    digest = lambda: "".join(r.choice(string.ascii_letters + string.digits + "+/") for _ in range(64))
    assert flagged([f"the id {uuid()} of it" for _ in range(100)]) <= 5
    assert flagged([f"my api key {uuid()} here" for _ in range(100)]) >= 80
    assert flagged([f'integrity="sha384-{digest()}" x' for _ in range(100)]) <= 20


KEYS = {"ghp": ("use {} ok", "ghp_", 36), "sk": ("use {} ok", "sk_live_", 30), "mixed": ("it is {} here", "", 40), "token": ("Bearer {}", "eyJ", 90)}


@pytest.mark.parametrize("name", KEYS)
def test_recall_by_kind(name):
    where, head, size = KEYS[name]
    assert flagged([where.format(head + k) for k in keys(100, size, string.ascii_letters + string.digits)]) >= 85
