"""Toxicity by a convolutional text classifier, trained and applied in numpy.

Words and their first four and six bytes are hashed to one table of embeddings and added;
filters of one, two and three words pass over them, the strongest answer of each
filter is kept, and a logistic layer gives the score. Scores are calibrated on labelled texts
kept out of training; decision thresholds are calibrated for each language.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ALNUM, LOWER, documents, hashes_of, in_batches, slices, small, text_buffer, words_of, written

BUCKETS, DIM, FILTERS, WIDTHS = 1 << 15, 16, 12, (1, 2, 3)
PREFIXES = (4, 6)
SHARD = 32 << 20  # bytes of labelled texts of a partition that takes steps of its own, about
RUN = 1 << 16  # words that the net looks at at once while it learns
ADDED = 1 << 14  # numbers of partitions' vectors that are added at once
BIN = 1 / 128  # of raw answers, for the cuts
EPOCHS, BATCH, RATE, DECAY = 6, 32, 4e-3, 1e-4
CUT = 0.3  # the score from which a text counts as toxic
LEAST_PER_LANG = 50
PAD = BUCKETS


def features(column: pa.Array):
    """Bucket numbers of word and prefixes, (n, 3), and the row starts; each row ends in pads as many as the widest filter."""
    data, off = text_buffer(column)
    data = LOWER[data]
    starts, ends, rows = words_of(data, off, ALNUM)
    pads = max(WIDTHS)
    n = len(off) - 1
    at = np.arange(len(starts)) + pads * rows
    out = np.full((len(starts) + pads * n, 1 + len(PREFIXES)), PAD, np.int32)
    for k, h in enumerate([hashes_of(data, starts, ends), *(hashes_of(data, starts, np.minimum(ends, starts + p)) for p in PREFIXES)]):
        out[at, k] = (h >> np.uint64(40)).astype(np.int64) % BUCKETS
    first = np.searchsorted(rows, np.arange(n)) + pads * np.arange(n)
    return out, first


class Net:
    """The classifier: float32 parameters, forward pass, and one training step by Adam."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        f = np.float32
        self.p = {"e": r.normal(0, 0.1, (BUCKETS + 1, DIM)).astype(f), "o": r.normal(0, 0.1, len(WIDTHS) * FILTERS).astype(f), "c": np.zeros(1, f)}
        self.p["e"][PAD] = 0
        for w in WIDTHS:
            self.p[f"w{w}"] = r.normal(0, (w * DIM) ** -0.5, (w * DIM, FILTERS)).astype(f)
            self.p[f"b{w}"] = np.zeros(FILTERS, f)
        self.m = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.v = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.t = 0
        self.scale, self.shift = 1.0, 0.0

    def copy(self) -> Net:
        """The same parameters, with no steps taken."""
        out = Net.__new__(Net)
        out.p = {k: v.copy() for k, v in self.p.items()}
        out.m = {k: np.zeros_like(v) for k, v in self.p.items()}
        out.v = {k: np.zeros_like(v) for k, v in self.p.items()}
        out.t, out.scale, out.shift = 0, self.scale, self.shift
        return out

    def __getstate__(self):
        return self.p, self.scale, self.shift

    def __setstate__(self, state):
        self.p, self.scale, self.shift = state
        self.m = self.v = None
        self.t = 0

    def seed_with(self, seen: np.ndarray, n: np.ndarray) -> None:
        """Sets the first embedding dimension to the bucket's class log-odds by texts, which the first filter reads; seen: texts by class and bucket, n: by class."""
        rate = (seen + 0.5) / (n[:, None] + 1)
        sure = seen.sum(0) / (seen.sum(0) + 2)
        self.p["e"][:, 0] = (0.3 * sure * np.log(rate[1] / rate[0])).astype(np.float32)
        self.p["e"][PAD] = 0
        self.p["w1"][:, 0] = 0
        self.p["w1"][0, 0] = 1
        self.p["o"][0] = 2

    def _answers(self, x: np.ndarray, w: int) -> np.ndarray:
        n = len(x) - w + 1
        y = x[:n] @ self.p[f"w{w}"][:DIM]
        for j in range(1, w):
            y += x[j : j + n] @ self.p[f"w{w}"][j * DIM : (j + 1) * DIM]
        return y

    def raw(self, idx: np.ndarray, first: np.ndarray) -> np.ndarray:
        if not len(first):
            return np.zeros(0, np.float32)
        x = self.p["e"][idx[:, 0]]
        for k in range(1, idx.shape[1]):
            x += self.p["e"][idx[:, k]]
        pooled = []
        for w in WIDTHS:
            y = self._answers(x, w)
            across = (np.append(first[1:], len(x))[:, None] - np.arange(1, w)).ravel()  # windows that reach into the next row
            y[across[across < len(y)]] = -np.inf
            pooled.append(np.maximum(np.maximum.reduceat(y, first, axis=0) + self.p[f"b{w}"], 0))
        return np.concatenate(pooled, 1) @ self.p["o"] + self.p["c"]

    def score(self, idx: np.ndarray, first: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.raw(idx, first).astype(np.float64) + self.shift, -40, 40)))

    def _strongest(self, idx: np.ndarray, bounds: np.ndarray):
        """For each width, each text's strongest answers and where their windows begin."""
        x = self.p["e"][idx].sum(1)
        pooled, arg = [], []
        for w in WIDTHS:
            a = self._answers(x, w)
            # windows that begin in a text's pads would cross into the next text
            at = np.stack([s + np.argmax(a[s : e - w + 1], 0) for s, e in zip(bounds[:-1], bounds[1:], strict=True)])
            arg.append(at)
            pooled.append(np.maximum(a[at, np.arange(FILTERS)] + self.p[f"b{w}"], 0))
        return pooled, arg

    def _strongest_by_runs(self, idx: np.ndarray, bounds: np.ndarray):
        """The same, text by text and of each in runs, so that memory does not follow a text's length."""
        pooled, arg = [[] for _ in WIDTHS], [[] for _ in WIDTHS]
        for s, e in zip(bounds[:-1], bounds[1:], strict=True):
            best = [np.full(FILTERS, -np.inf, np.float32) for _ in WIDTHS]
            where = [np.zeros(FILTERS, np.int64) for _ in WIDTHS]
            for lo in range(s, e, RUN):
                x = self.p["e"][idx[lo : min(e, lo + RUN + max(WIDTHS) - 1)]].sum(1)
                for k, w in enumerate(WIDTHS):
                    if len(x) >= w:
                        a = self._answers(x, w)[:RUN]
                        at = np.argmax(a, 0)
                        top = a[at, np.arange(FILTERS)]
                        where[k] = np.where(top > best[k], lo + at, where[k])
                        best[k] = np.maximum(top, best[k])
            for k, w in enumerate(WIDTHS):
                arg[k].append(where[k])
                pooled[k].append(np.maximum(best[k] + self.p[f"b{w}"], 0))
        return [np.stack(v) for v in pooled], [np.stack(v) for v in arg]

    def step(self, idx: np.ndarray, first: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
        """One update over a batch of texts; weight: of each text."""
        bounds = np.append(first, len(idx))
        pooled, arg = self._strongest(idx, bounds) if len(idx) <= RUN else self._strongest_by_runs(idx, bounds)
        h = np.concatenate(pooled, 1)
        z = np.clip(h @ self.p["o"] + self.p["c"], -30, 30)
        q = 1 / (1 + np.exp(-z))
        d = ((q - y) * weight / len(y)).astype(np.float32)
        g = {"o": h.T @ d, "c": d.sum(keepdims=True)}
        dh = d[:, None] * self.p["o"] * (h > 0)
        rows, grads = [], []
        for k, w in enumerate(WIDTHS):
            dk = dh[:, k * FILTERS : (k + 1) * FILTERS]
            g[f"b{w}"] = dk.sum(0)
            gw = np.zeros_like(self.p[f"w{w}"])
            for j in range(w):
                seen = self.p["e"][idx[arg[k] + j]].sum(2)  # (texts, filters, DIM)
                gw[j * DIM : (j + 1) * DIM] = np.einsum("tfd,tf->df", seen, dk)
                dx = dk[:, :, None] * self.p[f"w{w}"][j * DIM : (j + 1) * DIM].T
                live = dk != 0
                for c in range(idx.shape[1]):
                    rows.append(idx[arg[k] + j, c][live])
                    grads.append(dx[live])
            g[f"w{w}"] = gw
        self.t += 1
        rows, grads = np.concatenate(rows), np.concatenate(grads)
        keep = rows != PAD
        u, inv = np.unique(rows[keep], return_inverse=True)
        ge = np.zeros((len(u), DIM), np.float32)
        np.add.at(ge, inv, grads[keep])
        self._adam("e", ge, u)
        for k, v in g.items():
            self._adam(k, v, slice(None))
        loss = -(weight * (y * np.log(q + 1e-9) + (1 - y) * np.log(1 - q + 1e-9))).mean()
        return float(loss)

    def _adam(self, k: str, g: np.ndarray, at) -> None:
        p, m, v = self.p[k], self.m[k], self.v[k]
        g = g + DECAY * p[at]
        m[at] = 0.9 * m[at] + 0.1 * g
        v[at] = 0.99 * v[at] + 0.01 * g * g
        p[at] -= RATE * (m[at] / (1 - 0.9**self.t)) / (np.sqrt(v[at] / (1 - 0.99**self.t)) + 1e-8)


def _best_cut(low: np.ndarray, n: np.ndarray, toxic: np.ndarray) -> float:
    """The cut with the best F1, of bins' lower bounds with their numbers of texts and of toxic ones; between the two bins that it separates."""
    order = np.argsort(-low, kind="stable")
    low, n, toxic = low[order], n[order], toxic[order]
    f1 = 2 * np.cumsum(toxic) / (np.cumsum(n) + toxic.sum())
    k = int(np.argmax(f1))
    return float(low[k] + low[k + 1] + BIN) / 2 if k + 1 < len(low) else float(low[k])


class Model:
    """A fitted net with its decision thresholds by language; "" is that for any other language."""

    def __init__(self, net: Net, cuts: dict[str, float]):
        self.net, self.cuts = net, cuts

    def scores(self, column: pa.Array) -> np.ndarray:
        return self.net.score(*features(column))


PACKED = "held boolean, y binary, words binary, lang array<string>, body binary"


def _bodies(texts: DataFrame) -> DataFrame:
    """doc_id, lang, words and body of each text: its number of words and pads, and its compressed bucket numbers, which are dealt in place of the text."""
    names = ["doc_id", "lang", "words", "body"]
    schema = T.StructType([texts.schema["doc_id"], texts.schema["lang"], T.StructField("words", T.LongType()), T.StructField("body", T.BinaryType())])

    def scan(batches):
        for batch in batches:
            for part in slices(batch):
                idx, first = features(part.column("text"))
                bounds, idx = np.append(first, len(idx)), idx.astype(np.uint16)
                body = [pa.compress(idx[a:b].tobytes(), "zstd", asbytes=True) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("lang"), pa.array(np.diff(bounds)), pa.array(body, pa.binary())], names)

    return in_batches(texts.select("doc_id", "lang", "text")).mapInArrow(scan, schema)


def _packed(batches):
    """Batches of the net, as rows: of at most BATCH texts, all for training or all held, their labels, lengths and languages, and the compressed bucket numbers."""
    open_: dict[bool, list] = {False: [], True: []}

    def row(held):
        took, open_[held] = open_[held], []
        body = np.concatenate([x[0] for x in took])
        y, words = np.array([x[1] for x in took], np.uint8), np.array([len(x[0]) for x in took], np.int64)
        arrays = [[held], [y.tobytes()], [words.tobytes()], [[x[2] for x in took]], [pa.compress(body.tobytes(), "zstd", asbytes=True)]]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(arrays, [pa.bool_(), pa.binary(), pa.binary(), pa.list_(pa.string()), pa.binary()], strict=True)], ["held", "y", "words", "lang", "body"])

    for batch in batches:
        for y, held, lang, words, body in zip(*(batch.column(c).to_pylist() for c in ("toxic", "held", "lang", "words", "body")), strict=True):
            own = open_[held]
            if own and (len(own) == BATCH or sum(len(x[0]) for x in own) + words > RUN):
                yield row(held)
            body = pa.decompress(body, words * 2 * (1 + len(PREFIXES)), "zstd", asbytes=True)
            open_[held].append((np.frombuffer(body, np.uint16).reshape(-1, 1 + len(PREFIXES)), y, lang))
    for held in (False, True):
        if open_[held]:
            yield row(held)


def _unpacked(batches):
    """held, bucket numbers, row starts, labels and languages of each packed row."""
    for batch in batches:
        for held, y, words, lang, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            words = np.frombuffer(words, np.int64)
            body = pa.decompress(body, int(words.sum()) * 2 * (1 + len(PREFIXES)), "zstd", asbytes=True)
            idx = np.frombuffer(body, np.uint16).reshape(-1, 1 + len(PREFIXES)).astype(np.int32)
            yield held, idx, np.append(0, np.cumsum(words)[:-1]), np.frombuffer(y, np.uint8), lang


def _summed(rows: DataFrame, vector) -> np.ndarray:
    """The sum over all partitions of the vector that each gives for its rows; added by Spark in blocks, in the partitions' order."""

    def blocks(batches):
        v = vector(batches)
        if v is not None:
            at = range(0, len(v), ADDED)
            cut = [v[i : i + ADDED].astype(np.float32).tobytes() for i in at]
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()] * len(cut), pa.int32()), pa.array(range(len(cut)), pa.int32()), pa.array(cut, pa.binary())], ["part", "block", "v"])

    def add(table):
        table = table.sort_by("part")
        total = np.zeros(len(table.column("v")[0].as_py()) // 4)
        for v in table.column("v"):
            total += np.frombuffer(v.as_py(), np.float32)
        return pa.table({"block": table.column("block").slice(0, 1), "v": pa.array([total.tobytes()], pa.binary())})

    added = rows.mapInArrow(blocks, "part int, block int, v binary").groupBy("block").applyInArrow(add, "block int, v binary").collect()
    return np.concatenate([np.frombuffer(r["v"], np.float64) for r in sorted(added, key=lambda r: r["block"])])


def _seen(batches) -> np.ndarray:
    """Numbers of training texts of each class with each bucket, and of training texts of each class."""
    seen, n = np.zeros((2, BUCKETS + 1)), np.zeros(2)
    for held, idx, first, y, _ in _unpacked(batches):
        if not held:
            for own, c in zip(np.split(idx, first[1:]), y, strict=True):
                seen[c, np.unique(own)] += 1
                n[c] += 1
    return np.append(seen.ravel(), n)


def _round(net: Net, rows: DataFrame, steps: bool = True) -> tuple[Net, float]:
    """The net after one pass over all texts, and the loss of the given one on the held texts.

    Each partition takes its own steps from the given net. A bucket's change is the mean over the partitions that
    moved it, that of any other parameter the mean over all that took steps.
    """
    shared = rows.sparkSession.sparkContext.broadcast(net)

    def vector(batches):
        now, own = shared.value, shared.value.copy()
        loss = held_n = took = 0
        for held, idx, first, y, _ in _unpacked(batches):
            if held:
                z = now.raw(idx, first).astype(np.float64)
                loss, held_n = loss + float((np.logaddexp(0, z) - y * z).sum()), held_n + len(y)
            elif steps:
                own.step(idx, first, y.astype(np.float32), np.ones(len(y), np.float32))
                took = 1
        if not took and not held_n:
            return None
        change = {k: own.p[k] - now.p[k] for k in own.p}
        return np.concatenate([[loss, held_n, took], change["e"].any(1), *(change[k].ravel() for k in sorted(change))])

    total = _summed(rows, vector)
    shared.destroy()
    loss, held_n, took = total[:3]
    moved, at, after = total[3 : BUCKETS + 4], BUCKETS + 4, net.copy()
    for k in sorted(net.p):
        change = total[at : at + net.p[k].size].reshape(net.p[k].shape)
        at += net.p[k].size
        after.p[k] += (change / np.maximum(1, moved[:, None] if k == "e" else took)).astype(np.float32)
    return after, loss / max(1, held_n)


def _cuts(net: Net, rows: DataFrame) -> dict[str, float]:
    """The best cuts of raw answers, on the held texts: "" over all, and by language where LEAST_PER_LANG texts of both classes have it."""
    shared = rows.sparkSession.sparkContext.broadcast(net)

    def bins(batches):
        for held, idx, first, y, lang in _unpacked(batches):
            if held:
                z = np.clip(shared.value.raw(idx, first).astype(np.float64), -40, 40)
                yield pa.RecordBatch.from_arrays([pa.array([x or "" for x in lang], pa.string()), pa.array(np.floor(z / BIN).astype(np.int32)), pa.array(y.astype(np.int64))], ["lang", "bin", "y"])

    def best(table):
        at, n, y = (table.column(c).to_numpy() for c in ("bin", "n", "y"))
        lang = table.column("lang")[0].as_py()
        good = not lang or (n.sum() >= LEAST_PER_LANG and 0 < y.sum() < n.sum())
        return pa.table({"lang": [lang] if good else pa.array([], pa.string()), "cut": [_best_cut(at * BIN, n, y)] if good else pa.array([], pa.float64())})

    each = rows.mapInArrow(bins, "lang string, bin int, y long").groupBy("lang", "bin").agg(F.count("*").alias("n"), F.sum("y").alias("y"))
    all_ = each.groupBy("bin").agg(F.sum("n").alias("n"), F.sum("y").alias("y")).select(F.lit("").alias("lang"), "bin", "n", "y")
    return {r["lang"]: r["cut"] for r in each.where("lang <> ''").unionByName(all_).groupBy("lang").applyInArrow(best, "lang string, cut double").collect()}


def _fit(rows: DataFrame, n_train: int) -> Model:
    """Fits on all packed training texts, a round of each partition's own steps after the other, and calibrates on the held; the round with the least loss on these stays."""
    net = Net()
    seen = _summed(rows, _seen)
    net.seed_with(seen[:-2].reshape(2, -1), seen[-2:])
    least, kept = np.inf, net
    rounds = max(EPOCHS, min(10, EPOCHS * 1000 // n_train))
    for i in range(rounds + 1):
        after, loss = _round(net, rows, i < rounds)
        if i and loss < least:
            least, kept = loss, net
        if least < 0.01 and loss > 1.5 * least:
            break
        net = after
    net, cuts = kept, _cuts(kept, rows)
    # the score at the best cut is CUT, so that one cut serves all texts
    net.shift = float(np.log(CUT / (1 - CUT)) - net.scale * cuts.pop(""))
    cuts = {k: float(1 / (1 + np.exp(-np.clip(net.scale * z + net.shift, -40, 40)))) for k, z in cuts.items()}
    return Model(net, {"": CUT, **cuts})


def held_out(doc_id) -> F.Column:
    """crc32 of the id as text, modulo 4, is 2; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), F.lit(4)) == 2


def train(docs: DataFrame, labels: DataFrame, text_bytes: int | None = None) -> Model:
    """Fits on all labelled texts that are not held out; a fifth of them, by a hash of doc_id, calibrates.

    Texts are dealt, as bucket numbers, by doc_id to partitions of about SHARD bytes of text, each of which takes its own steps; only nets and counts, of
    a fixed size, come back. With text_bytes, longer labelled texts are not fitted, though scored all the same; a class that
    has labels but no text left then raises ValueError, unless no label has a text.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    known = small(written(known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")), "labels"))
    held = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(5)) == 0
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    fits = F.lit(True) if text_bytes is None else size <= text_bytes
    own = docs.where(~held_out("doc_id")).select("doc_id", "text", "lang")
    found = own.select("doc_id", size.alias("size"), fits.alias("fits")).join(known, "doc_id").groupBy("toxic", "fits", held.alias("held")).agg(F.count("*").alias("n"), F.sum("size").alias("size")).collect()
    n = {(c, h): sum(r["n"] for r in found if r["fits"] and r["toxic"] == c and r["held"] == h) for c in (0, 1) for h in (False, True)}
    for c in {r["toxic"] for r in found}:
        if not n[c, False] + n[c, True]:
            raise ValueError(f"none of the labelled texts with toxic = {c} has at most {text_bytes} bytes (text_bytes)")
    texts = {c: n[c, False] + n[c, True] for c in (0, 1)}
    if not texts[0] or not texts[1]:
        net = Net()
        net.scale, net.shift = 0.0, (30.0 if texts[1] else -3.0)
        return Model(net, {"": CUT})
    shards = max(1, -(-sum(r["size"] for r in found if r["fits"]) // SHARD))
    # texts are left where they are: the bucket numbers of those with labels are dealt, after the join, which would else deal them anew
    rows = _bodies(own.where(fits).join(known, "doc_id", "left_semi")).join(known, "doc_id").repartition(shards, "doc_id")
    if not min(n.values()):  # too few texts to keep a fifth apart: each trains and calibrates
        rows, n = rows.withColumn("held", F.explode(F.array(F.lit(False), F.lit(True)))), {(c, h): texts[c] for c, h in n}
    else:
        rows = rows.withColumn("held", held)
    rows = rows.sortWithinPartitions(F.md5(F.col("doc_id").cast("string")), "doc_id", "body", "lang", "held").select("lang", "toxic", "held", "words", "body")
    rows = rows.mapInArrow(_packed, PACKED).persist(StorageLevel.DISK_ONLY)
    try:
        return _fit(rows, n[0, False] + n[1, False])
    finally:
        rows.unpersist()


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of docs, with tox_score, tox_threshold (by lang) and tox_flag, in place of any such columns.

    Null or empty text: the score of no words. A text of any length is scored whole. Rows are independent, so repeats and ties
    score alike; no rows give no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("tox_score", "tox_threshold", "tox_flag")
    names = [*docs.columns, "tox_score", "tox_threshold", "tox_flag"]
    added = [T.StructField("tox_score", T.DoubleType()), T.StructField("tox_threshold", T.DoubleType()), T.StructField("tox_flag", T.BooleanType())]
    schema = T.StructType([*docs.schema.fields, *added])

    def scan(batches):
        model = shared.value
        for batch in batches:
            for part in slices(batch):
                s = model.scores(part.column("text"))
                cut = np.array([model.cuts.get(x or "", model.cuts[""]) for x in part.column("lang").to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s), pa.array(cut), pa.array(s >= cut)], names)

    return in_batches(docs).mapInArrow(scan, schema)


def clean_of(docs: DataFrame, model: Model) -> DataFrame:
    """The documents below their language's threshold, with all of their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches):
        model = shared.value
        for batch in batches:
            for part in slices(batch):
                cut = np.array([model.cuts.get(x or "", model.cuts[""]) for x in part.column("lang").to_pylist()])
                yield part.filter(pa.array(model.scores(part.column("text")) < cut))

    return in_batches(docs).mapInArrow(scan, docs.schema)


def op8_toxicity(spark, sf_dir):
    docs = documents(spark, sf_dir, "doc_id", "text", "lang")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), F.col("tox_score").alias("score"), (F.col("tox_score") >= CUT).cast("int").alias("predicted"))
