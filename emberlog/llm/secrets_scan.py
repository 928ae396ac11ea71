"""Secret scans: fixed patterns, and a character convolutional network over every other candidate.

A candidate is a run of sixteen or more characters of keys and codes, or what the fixed patterns leave of
one. The network reads all of it, in overlapping windows, with the characters around each; the highest
score counts. It is trained in numpy on labelled findings of common key formats and look-alikes
(identifiers, checksums, times, numbers, paths), then calibrated on findings kept out, with the
highest threshold that keeps the wanted recall.
"""

from __future__ import annotations

import base64
import hashlib
import re
import string
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, in_batches, slices, text_buffer, words_of

KINDS = ("assign", "access", "hex", "model")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 12, "access": 18, "hex": 16}
RUN = 16
CODE = np.zeros(256, bool)
CODE[[ord(c) for c in string.ascii_letters + string.digits + "+/_.=-"]] = True
WORDLY = np.zeros(256, bool)
WORDLY[[ord(c) for c in string.ascii_letters + string.digits]] = True

LEFT, BODY, RIGHT = 32, 48, 16  # characters that the network sees
WIDTH = LEFT + BODY + RIGHT
STEP = BODY // 2  # between windows of a longer candidate
DIM, FILTERS, SPANS = 8, 12, (3, 5)
RECALL = 0.97
FINDINGS, EPOCHS, BATCH, RATE = 9000, 10, 64, 5e-3


def windows(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Characters around each candidate, 0 for none, 127 for other than ASCII; its first BODY characters, then what follows it."""
    at = np.concatenate([starts[:, None] + np.arange(-LEFT, BODY), ends[:, None] + np.arange(RIGHT)], 1)
    ok = (at >= lo[:, None]) & (at < hi[:, None])
    ok[:, LEFT : LEFT + BODY] &= at[:, LEFT : LEFT + BODY] < ends[:, None]
    c = data[np.clip(at, 0, max(len(data) - 1, 0))] if len(data) else np.zeros(at.shape, np.uint8)
    return np.where(ok, np.minimum(c, 127), 0).astype(np.int16)


def pieces(starts: np.ndarray, ends: np.ndarray):
    """Start, end and candidate of windows of BODY characters at most, STEP apart, that cover each candidate; the last one ends with it."""
    count = 1 + -(-np.maximum(ends - starts - BODY, 0) // STEP)
    of = np.repeat(np.arange(len(starts)), count)
    k = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    at = np.minimum(starts[of] + STEP * k, np.maximum(starts, ends - BODY)[of])
    return at, np.minimum(at + BODY, ends[of]), of


class Net:
    """Embedding of characters and of the three zones, filters, the strongest answer in each zone, logistic layer."""

    def __init__(self, seed: int = 3):
        r = np.random.default_rng(seed)
        f = np.float32
        zones = np.repeat([0, 1, 2], [LEFT, BODY, RIGHT])
        self.zone = zones
        self.p = {"e": r.normal(0, 0.3, (3 * 128, DIM)).astype(f), "o": r.normal(0, 0.1, 3 * FILTERS * len(SPANS)).astype(f), "c": np.zeros(1, f)}
        for w in SPANS:
            self.p[f"w{w}"] = r.normal(0, (w * DIM) ** -0.5, (w * DIM, FILTERS)).astype(f)
            self.p[f"b{w}"] = np.zeros(FILTERS, f)
        self.m = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.v = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.t, self.scale, self.shift, self.cut = 0, 1.0, 0.0, 0.5

    def _forward(self, x: np.ndarray):
        idx = x + 128 * self.zone
        e = self.p["e"][idx]
        pooled, arg, cols = [], [], []
        for w in SPANS:
            col = np.lib.stride_tricks.sliding_window_view(e, w, axis=1).transpose(0, 1, 3, 2).reshape(len(x), WIDTH - w + 1, w * DIM)
            a = col @ self.p[f"w{w}"] + self.p[f"b{w}"]
            cols.append(col)
            for z in range(3):
                s, t = np.flatnonzero(self.zone[: WIDTH - w + 1] == z)[[0, -1]]
                at = s + np.argmax(a[:, s : t + 1], 1)
                arg.append(at)
                pooled.append(np.take_along_axis(a, at[:, None, :], 1)[:, 0])
        h = np.maximum(np.concatenate(pooled, 1), 0)
        return idx, cols, arg, h, h @ self.p["o"] + self.p["c"]

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self._forward(x[at : at + 256])[-1] for at in range(0, len(x), 256)]) if len(x) else np.zeros(0)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.raw(x).astype(np.float64) + self.shift, -40, 40)))

    def step(self, x: np.ndarray, y: np.ndarray) -> None:
        idx, cols, arg, h, z = self._forward(x)
        d = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)).astype(np.float32)
        g = {"o": h.T @ d, "c": d.sum(keepdims=True), "e": np.zeros_like(self.p["e"])}
        dh = d[:, None] * self.p["o"] * (h > 0)
        rows = np.arange(len(x))[:, None]
        for k, w in enumerate(SPANS):
            g[f"w{w}"], g[f"b{w}"] = np.zeros_like(self.p[f"w{w}"]), np.zeros(FILTERS, np.float32)
            for z3 in range(3):
                j = 3 * k + z3
                dk = dh[:, j * FILTERS : (j + 1) * FILTERS]
                g[f"b{w}"] += dk.sum(0)
                g[f"w{w}"] += np.einsum("nfc,nf->cf", cols[k][rows, arg[j]], dk)
                for s in range(w):
                    dx = dk[:, :, None] * self.p[f"w{w}"][s * DIM : (s + 1) * DIM].T
                    np.add.at(g["e"], idx[rows, arg[j] + s], dx)
        self.t += 1
        for k, v in g.items():
            self.m[k] = 0.9 * self.m[k] + 0.1 * v
            self.v[k] = 0.99 * self.v[k] + 0.01 * v * v
            self.p[k] -= RATE * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.99**self.t)) + 1e-8)


def labelled_findings(n: int = FINDINGS, seed: int = 5):
    """(text before, candidate, text after, is a secret), in equal shares."""
    r = np.random.default_rng(seed)
    pick = lambda x: x[int(r.integers(len(x)))]
    chars = lambda a, lo, hi=0: "".join(pick(a) for _ in range(int(r.integers(lo, max(lo, hi) + 1))))
    low, up, dig = string.ascii_lowercase, string.ascii_uppercase, string.digits
    word = lambda: chars(low, 2, 9)
    prose = lambda k: " ".join(word() for _ in range(int(r.integers(0, k))))
    b64 = lambda k: base64.b64encode(r.bytes(k)).decode()
    url64 = lambda k: base64.urlsafe_b64encode(r.bytes(k)).decode().rstrip("=")
    secrets = [
        lambda: ("", "ghp_" + chars(low + up + dig, 36)),
        lambda: ("", pick(["sk_live_", "rk_live_", "sk-", "pk_live_"]) + chars(low + up + dig, 24, 40)),
        lambda: ("", "xox" + pick("bp") + "-" + chars(dig, 11) + "-" + chars(low + up + dig, 24)),
        lambda: ("", "AIza" + chars(low + up + dig + "_-", 35)),
        lambda: ("Bearer ", url64(24) + "." + url64(40)),
        lambda: ("", "eyJ" + url64(20) + ".eyJ" + url64(30) + "." + url64(24)),
        lambda: (pick(["key: ", "access key = ", "aws_secret_access_key = ", "credentials ", "auth="]), b64(30)),
        lambda: (pick(["pass ", "pwd=", "passphrase: ", "client secret ", "private key "]), chars(low + up + dig, 16, 32)),
        lambda: (pick(["", "login ", "key "]), chars(low + up + dig, 20, 44)),
        lambda: ("", "AKIA" + chars(up + dig, 16)),
        lambda: (pick(["token ", "signature ", "session "]), chars("abcdef" + dig, 32, 64)),
        lambda: ("glpat-", chars(low + up + dig, 20)),
        lambda: (pick(["", "key ", "token "]), chars(low + up, 20, 48)),
        lambda: ("", url64(51)),
        lambda: ("", chars(low + up, 32, 64)),
        lambda: ("", chars(low + up + dig, 32, 64)),
        lambda: (pick(["key ", "api key ", "access token ", "client secret ", "x-api-key "]), "-".join(chars("abcdef" + dig, k) for k in (8, 4, 4, 4, 12))),
    ]
    path = lambda: pick(["//", "/", ""]) + pick([word() + ".com/", ""]) + "".join(word() + "/" for _ in range(int(r.integers(1, 12))))
    others = [
        lambda: (pick(["", "id ", "uuid: "]), "-".join(chars("abcdef" + dig, k) for k in (8, 4, 4, 4, 12))),
        lambda: (pick(["at ", "on ", ""]), f"20{chars(dig, 2)}-0{pick(dig[1:])}-1{pick(dig)}T1{pick(dig)}-2{pick(dig)}-3{pick(dig)}.{chars(dig, 3, 6)}"),
        lambda: ("", "_".join(word() for _ in range(int(r.integers(2, 6)))) + "_" + chars(dig, 1, 3)),
        lambda: ("", "/".join(word() for _ in range(int(r.integers(3, 6)))) + "/" + chars(dig, 1, 5)),
        lambda: (pick(["http ", "see ", "//"]), "www." + word() + chars(dig, 1, 2) + ".example.com/" + word() + "/" + word()),
        lambda: ("", word() + "." + word() + "." + chars(dig, 1, 3) + ".example." + pick(["com", "org", "net"])),
        lambda: (pick(["call ", "no. ", "card "]), chars(dig, 16, 19)),
        lambda: ("", pick(["IMG_", "DSC-", "scan_"]) + chars(dig, 8) + "_" + chars(dig, 6) + pick([".jpg", ".png", ""])),
        lambda: ("", "-".join(word() for _ in range(int(r.integers(3, 7)))) + "-" + chars(dig, 1, 4)),
        lambda: (pick(["version ", "release "]), word() + "-" + ".".join(chars(dig, 1, 2) for _ in range(3)) + "-" + word() + pick(["", ".tar.gz"])),
        lambda: ("", chars(low, 12, 24) + chars(dig, 1, 2)),
        lambda: ("", "=" * 8 + chars(dig, 1, 3) + "=" * int(r.integers(8, 20))),
        lambda: (pick(["isbn ", "order "]), "-".join(chars(dig, k) for k in (3, 1, 5, 4, 4))),
        lambda: ("", word().capitalize() + word().capitalize() + word().capitalize() + chars(dig, 1, 2)),
        lambda: ("", pick("/_-.").join(word() for _ in range(int(r.integers(4, 14))))),
        lambda: ("", path() + pick(["", word(), "index.html"]) + "/" * RUN),
        lambda: ("", pick("=-_.") * int(r.integers(16, 80))),
        lambda: ("", chars(low, 16, 30)),
        lambda: ("", "".join(word().capitalize() for _ in range(int(r.integers(3, 6))))),
        lambda: (pick(["//", ""]) + path(), word() + "-" + word() + "-" + word() + "-" + word()),
        # shouted words, alone, run together, repeated or with a number
        lambda: ("", "".join(word() for _ in range(int(r.integers(2, 7)))).upper()),
        lambda: ("", (word().upper() * 16)[: int(r.integers(16, 40))]),
        lambda: ("", pick("_-").join(word().upper() for _ in range(int(r.integers(3, 7)))) + pick(["", chars(dig, 1, 4)])),
        # digests of files
        lambda: (pick(["", "integrity ", '"']), pick(["sha256-", "sha384-", "sha512-"]) + b64(int(pick((32, 48, 64))))),
    ]
    out = []
    for i in range(n):
        before, c = pick((others, secrets)[i % 2])()
        out.append((prose(6) + pick([" ", " ", "\n", ' "', " ("]) + (before or (path() if i % 2 and r.random() < 0.2 else "")), c, pick([" ", ".", "\n", '"', ", ", ") "]) + prose(4), i % 2))
    return out


def _examples(before: str, candidate: str, after: str, secret: int):
    """Windows of the run that the candidate stands in and of the candidate itself, and their labels; windows that hold a part of a secret too short to tell are left out."""
    data = np.frombuffer((before + candidate + after).encode(), np.uint8)
    s, e = len(before), len(before) + len(candidate)
    starts, ends, _ = words_of(data, np.array([0, len(data)]), CODE)
    own = (starts <= s) & (ends >= e)
    starts, ends, _ = pieces(np.append(starts[own], s), np.append(ends[own], e))
    at = np.unique(np.stack([starts, ends], 1), axis=0)
    held = np.minimum(at[:, 1], e) - np.maximum(at[:, 0], s)
    keep = (held >= RUN) | (held <= 0) if secret else np.ones(len(at), bool)
    at, held, n = at[keep], held[keep], int(keep.sum())
    return windows(data, at[:, 0], at[:, 1], np.zeros(n, np.int64), np.full(n, len(data))), (held > 0) * float(secret)


@lru_cache(1)
def trained() -> Net:
    """Fits on four fifths of the findings; scale, shift and threshold come from the rest."""
    found = [_examples(*x) for x in labelled_findings() if len(x[1]) >= RUN]
    n = len(found) * 4 // 5
    x, y = (np.concatenate([f[k] for f in found[:n]]) for k in (0, 1))
    y = y.astype(np.float32)
    net, r = Net(), np.random.default_rng(1)
    for _ in range(EPOCHS):
        order = r.permutation(len(y))
        for at in range(0, len(y), BATCH):
            net.step(x[order[at : at + BATCH]], y[order[at : at + BATCH]])
    z, held = net.raw(np.concatenate([f[0] for f in found[n:]])).astype(np.float64), np.concatenate([f[1] for f in found[n:]])
    for _ in range(200):  # Platt scaling by gradient steps
        q = 1 / (1 + np.exp(-np.clip(net.scale * z + net.shift, -30, 30)))
        net.scale -= 0.05 * float(((q - held) * z).mean())
        net.shift -= 0.05 * float((q - held).mean())
    s = np.sort([net.score(f[0]).max() for f in found[n:] if f[1].any()])
    net.cut = float(s[int((1 - RECALL) * len(s))])
    return net


def find(net: Net, data: np.ndarray, off: np.ndarray):
    """(row, kind, start, end, score) in code points of the row, by row, start and kind; and the row's text.

    The first three kinds are the fixed patterns; of the network's candidates, which are what the fixed spans
    leave of the runs, those that reach its threshold. score: the network's, null where it wasn't asked.
    """
    found: dict[int, list] = {}
    starts, ends, owner = words_of(data, off, CODE)
    long = ends - starts >= RUN
    starts, ends, owner = starts[long], ends[long], owner[long]
    raw = data.tobytes()
    for s, e, i in zip(starts.tolist(), ends.tolist(), owner.tolist(), strict=True):
        run = raw[s:e].decode()
        for kind, pattern in (("access", ACCESS), ("hex", HEX)):
            for m in pattern.finditer(run):
                if m.end() - m.start() >= LEAST[kind]:
                    found.setdefault(i, []).append((s + m.start(), KINDS.index(kind), s + m.end(), None))
    sign = np.concatenate([[0], np.cumsum((data == 58) | (data == 61))])
    for i in np.flatnonzero(sign[off[1:]] > sign[off[:-1]]).tolist():
        lo = int(off[i])
        text = raw[lo : int(off[i + 1])].decode("latin-1")  # bytes as characters: the pattern is ASCII
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= LEAST["assign"]:
                found.setdefault(i, []).append((lo + m.start(), 0, lo + m.end(), None))
    dot = data[ends - 1] == 46  # a full stop after it
    parts = []
    for s, e, i in zip(starts.tolist(), (ends - dot).tolist(), owner.tolist(), strict=True):
        if i not in found:
            parts.append((s, e, i))
            continue
        at = s
        for a, _, b, _ in sorted(x for x in found[i] if x[0] < e and s < x[2]):
            parts.append((at, a, i))
            at = max(at, b)
        parts.append((at, e, i))
    wordly = np.concatenate([[0], np.cumsum(WORDLY[data])])
    parts = [x for x in parts if x[1] > x[0] and wordly[x[1]] > wordly[x[0]]]
    if parts:
        s, e, i = np.array(parts).T
        score = np.zeros(len(s))
        for lo in range(0, len(s), 4096):
            a, b, of = pieces(s[lo : lo + 4096], e[lo : lo + 4096])
            for k in range(0, len(a), 4096):
                row = i[lo + of[k : k + 4096]]
                np.maximum.at(score, lo + of[k : k + 4096], net.score(windows(data, a[k : k + 4096], b[k : k + 4096], off[row], off[row + 1])))
        for k in np.flatnonzero(score >= net.cut).tolist():
            found.setdefault(int(i[k]), []).append((int(s[k]), 3, int(e[k]), float(score[k])))
    for i in sorted(found):
        lo, hi = int(off[i]), int(off[i + 1])
        point = np.concatenate([[0], np.cumsum((data[lo:hi] & 0xC0) != 0x80)])
        yield i, [(KINDS[k], int(point[s - lo]), int(point[e - lo]), q) for s, k, e, q in sorted(found[i], key=lambda x: x[:3])]


SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())])
_ARROW_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def secret_spans(docs: DataFrame) -> DataFrame:
    """doc_id and secrets, an array of spans (kind, start, end in code points, score), of every row.

    Null or empty text: an empty array. A text of any length is read whole. Repeated rows each give a row, null doc_ids stay;
    no rows give no rows; other columns play no part.
    """
    shared = docs.sparkSession.sparkContext.broadcast(trained())

    def scan(batches):
        net = shared.value
        for batch in batches:
            for part in slices(batch):
                spans = [[] for _ in range(part.num_rows)]
                for i, own in find(net, *text_buffer(part.column("text"))):
                    spans[i] = [dict(zip(("kind", "start", "end", "score"), s, strict=True)) for s in own]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(spans, _ARROW_SPAN)], ["doc_id", "secrets"])

    schema = T.StructType([docs.schema["doc_id"], T.StructField("secrets", T.ArrayType(SPAN))])
    return in_batches(docs).select("doc_id", "text").mapInArrow(scan, schema)


def redacted(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The documents with every secret span replaced, and n_chars after that; all columns and rows stay."""
    shared = docs.sparkSession.sparkContext.broadcast(trained())
    names = docs.columns

    def scan(batches):
        net = shared.value
        for batch in batches:
            for part in slices(batch):
                texts, sizes = None, None
                for i, own in find(net, *text_buffer(part.column("text"))):
                    if texts is None:
                        texts = part.column("text").to_pylist()
                        sizes = part.column("n_chars").to_pylist() if "n_chars" in names else None
                    out, at = [], 0
                    for _, s, e, _ in own:
                        if s >= at:
                            out += [texts[i][at:s], mark]
                        at = max(at, e)
                    texts[i] = "".join([*out, texts[i][at:]])
                    if sizes is not None:
                        sizes[i] = len(texts[i])
                if texts is None:
                    yield part
                else:
                    new = {"text": texts} | ({"n_chars": sizes} if sizes is not None else {})
                    yield pa.RecordBatch.from_arrays([pa.array(new[c], part.schema.field(c).type) if c in new else part.column(c) for c in names], names)

    return in_batches(docs).mapInArrow(scan, docs.schema)


def op6_secret_scan(spark, sf_dir):
    found = secret_spans(documents(spark, sf_dir, "doc_id", "text"))
    base = F.filter("secrets", lambda s: s["kind"] != "model")
    line = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *(count(k) for k in KINDS[:3]), F.sha2(line(base), 256).alias("base_sha256"), line(F.col("secrets")).alias("spans"))


def base_spans(text: str | None) -> str:
    """The fixed patterns' spans of one text, plainly; for tests."""
    found = []
    for k, pattern in enumerate((ASSIGN, ACCESS, HEX)):
        for m in pattern.finditer(text or ""):
            if len(m[2] if k == 0 else m[0]) >= LEAST[KINDS[k]]:
                found.append((m.start(), k, m.end()))
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(found))


def digest(spans: str) -> str:
    return hashlib.sha256(spans.encode()).hexdigest()
