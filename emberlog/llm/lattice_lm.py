"""Language-model scores by subword lattices.

The pieces of an existing unigram vocabulary span a lattice over each word; the sum over all
segmentations, by forward recursion in log space, is the marginal probability. Two weightings of the pieces run
through one recursion: the vocabulary's own scores, which give lattice_score, and those fitted to the
corpus, which give score. For score, a word of the training
texts has one more arc in its lattice, over the whole word: its count less a discount.
What is discounted is the weight of the pieces' arcs, so that the sum over all words is one; the
discount comes from the numbers of words seen once and twice. A text's probability is the product over
its words and one end token. The file's scores are the start; one step of
expectation-maximisation over the distinct words of all training texts fits them to the
corpus. Beside it a word unigram model with additive smoothing gives the base score.

Words are counted once per run of slices before Spark sums them. For scoring,
frequent words' counts are broadcast (a fixed number of them); the other words of each
text meet their counts in a shuffled join.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _BYTE, _P, LOWER, NOT_SPACE, documents, hashes_of, in_batches, mix, slices, text_buffer, words_of, written

RUN_BYTES = 4 << 20  # text of one run: its distinct words are segmented together
DISTINCT = 400_000  # distinct words that a task counts before it passes sums on
MARGINALS = 1_000_000  # words in a worker's cache, 24 MB
FREQUENT = 131_072  # words in the broadcast table, 2 MB
ALPHA = 0.1
FLOOR = 0.01  # expected count added to every piece
_U = np.uint64
_INV = pow(int(_P), -1, 1 << 64)


class Pieces:
    """A unigram vocabulary: hashes of its pieces' bytes, and log probabilities."""

    def __init__(self, pieces: list[bytes], logp: np.ndarray):
        h = np.array([self._hash(p) for p in pieces], _U)
        order = np.argsort(h)
        self.hash, self.given = h[order], logp[order]
        self.logp = self.given.copy()  # of the fitted model
        self.length = np.array([len(p) for p in pieces])[order]
        self.longest = int(self.length.max())
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(h >> _U(44)).astype(np.int64)] = True

    @staticmethod
    def _hash(piece: bytes) -> int:
        h, p = 0, 1
        for b in piece:
            h, p = (h + int(_BYTE[b]) * p) % (1 << 64), p * int(_P) % (1 << 64)
        return int(mix(np.array([(h + len(piece)) % (1 << 64)], _U))[0])

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in h that are pieces, and which."""
        may = np.flatnonzero(self.bits[(h >> _U(44)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.hash, h[may]), len(self.hash) - 1)
        ok = self.hash[at] == h[may]
        return may[ok], at[ok]

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, weight: np.ndarray | None = None):
        """Log probability of each word after a space, by the fitted and by the given scores; with weights, by the fitted alone, and the expected count of every piece."""
        out = np.zeros((len(starts), 2 if weight is None else 1))
        expected = np.zeros(len(self.hash)) if weight is not None else None
        size = ends - starts
        order = np.argsort(size, kind="stable")
        cut = np.flatnonzero(np.diff(size[order])) + 1
        for group in np.split(order, cut):
            n = int(size[group[0]]) if len(group) else 0
            step = max(1, (1 << 21) // (n + 1))
            for at in range(0, len(group), step):
                ids = group[at : at + step]
                z = self._lattice(data, starts[ids], n, None if weight is None else weight[ids], expected)
                out[ids] = z
        return out, expected

    def _lattice(self, data, starts, n, weight, expected):
        u, power, inverse = len(starts), 1, 1
        total = np.zeros((n + 2, u), _U)
        inv = np.empty(n + 2, _U)
        for t in range(n + 1):
            byte = np.full(u, 0x20) if t == 0 else data[starts + t - 1]
            inv[t] = inverse
            total[t + 1] = total[t] + _BYTE[byte] * _U(power)
            power, inverse = power * int(_P) % (1 << 64), inverse * _INV % (1 << 64)
        scores = [self.logp] if weight is not None else [self.logp, self.given]
        both = np.full((len(scores), n + 2, u), -np.inf)
        both[:, 0] = 0
        ahead, arcs = both[0], []
        for t in range(1, n + 2):
            for k in range(1, min(t, self.longest) + 1):
                ids, which = self.find(mix((total[t] - total[t - k]) * inv[t - k] + _U(k)))
                if len(ids):
                    for way, logp in zip(both, scores, strict=True):
                        way[t, ids] = np.logaddexp(way[t, ids], way[t - k, ids] + logp[which])
                    if weight is not None:
                        arcs.append((t, k, ids, which))
        z = ahead[n + 1]
        if weight is not None:
            back = np.full((n + 2, u), -np.inf)
            back[n + 1] = 0
            for t, k, ids, which in reversed(arcs):
                through = back[t, ids] + self.logp[which]
                back[t - k, ids] = np.logaddexp(back[t - k, ids], through)
                share = np.exp(ahead[t - k, ids] + through - z[ids]) * weight[ids]
                expected += np.bincount(which, share, minlength=len(expected))
        return both[:, n + 1].T


class Marginals:
    """A worker's log probabilities of words met so far, by sorted hash; emptied when full."""

    def __init__(self, pieces: Pieces):
        self.pieces, self.key, self.value = pieces, np.zeros(0, _U), np.zeros((0, 2))

    def of(self, key: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Of distinct words with ascending hashes, by the fitted and by the given scores."""
        out = np.empty((len(key), 2))
        at = np.searchsorted(self.key, key)
        known = np.zeros(len(key), bool)
        if len(self.key):
            known = self.key[np.minimum(at, len(self.key) - 1)] == key
            out[known] = self.value[at[known]]
        new = np.flatnonzero(~known)
        out[new] = self.pieces.words(data, starts[new], ends[new])[0]
        if len(self.key) + len(new) > MARGINALS:
            self.key, self.value = key, out
        else:
            self.key, self.value = np.insert(self.key, at[new], key[new]), np.insert(self.value, at[new], out[new], axis=0)
        return out


def load_pieces(path: str) -> Pieces:
    """The pieces of a sentencepiece model that can occur in a lower-cased word after a space.

    Its scores fall with the piece's rank; the starting probabilities are one over
    rank. Byte pieces make every string of bytes segmentable.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    size = sp.get_piece_size()
    scores = np.array([sp.get_score(i) for i in range(size)])
    found: dict[bytes, float] = {}
    for i in range(size):
        if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
            continue
        text = sp.id_to_piece(i)
        raw = bytes([int(text[3:5], 16)]) if sp.is_byte(i) else text.replace("▁", " ").encode()
        rank = size if sp.is_byte(i) else 1 - scores[i]
        if raw and not raw[1:].count(b" ") and raw == bytes(LOWER[np.frombuffer(raw, np.uint8)]):
            found[raw] = max(found.get(raw, 0.0), 1.0 / max(rank, 1.0))
    pieces = sorted(found)
    p = np.array([found[x] for x in pieces])
    return Pieces(pieces, np.log(p / p.sum()))


def is_held_out() -> F.Column:
    """crc32 of the id as text, modulo 10, is 0; so it is for a null id, whose text is empty."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(10)) == 0


WORD, PIECE, END = 0, 1, 2


def taken(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spans' bytes one after the other, and their offsets."""
    off = np.concatenate([[0], np.cumsum(ends - starts)])
    return data[np.repeat(starts - off[:-1], ends - starts) + np.arange(off[-1])], off


def _binary(data: np.ndarray, off: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(off) - 1, [None, pa.py_buffer(off.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n: counts over the training rows; the end token is the empty word."""

    def count(batches):
        held: list[tuple] = []
        size = texts = 0

        def merged():
            key, n, data, off = held[0]
            if len(held) > 1:
                data = np.concatenate([x[2] for x in held])
                n = np.concatenate([x[1] for x in held])
                length = np.concatenate([np.diff(x[3]) for x in held])
                off = np.concatenate([[0], np.cumsum(length)])
                key, at, inv = np.unique(np.concatenate([x[0] for x in held]), return_index=True, return_inverse=True)
                n = np.bincount(inv, n, minlength=len(key))
                data, off = taken(data, off[at], off[at + 1])
            return key, n, data, off

        def told(found):
            _, n, data, off = found
            for at in range(0, len(n), 20_000):
                o = off[at : at + 20_001]
                yield pa.RecordBatch.from_arrays([_binary(data[o[0] : o[-1]], o - o[0]), pa.array(n[at : at + 20_000].astype(np.float64))], ["word", "n"])

        for batch in batches:
            for part in slices(batch, limit=RUN_BYTES):
                data, off = text_buffer(part.column("text"))
                data = LOWER[data]
                starts, ends, _ = words_of(data, off, NOT_SPACE)
                texts += part.num_rows
                if not len(starts):
                    continue
                key, at, n = np.unique(hashes_of(data, starts, ends), return_index=True, return_counts=True)
                held.append((key, n, *taken(data, starts[at], ends[at])))
                size += len(key)
                if size > 2 * DISTINCT:
                    held = [merged()]
                    size = len(held[0][0])
                    if size > DISTINCT:
                        yield from told(held[0])
                        held, size = [], 0
        if held:
            yield from told(merged())
        if texts:
            yield pa.RecordBatch.from_arrays([pa.array([b""], pa.binary()), pa.array([float(texts)])], ["word", "n"])

    train = docs.where(~is_held_out()).select("text")
    return train.mapInArrow(count, "word binary, n double").groupBy("word").agg(F.sum("n").alias("n"))


def statistics(docs: DataFrame, pieces: Pieces) -> DataFrame:
    """kind, key, n: counts of words (by hash), of ends, and expected counts of pieces (to be summed), over the training rows."""
    shared = docs.sparkSession.sparkContext.broadcast(pieces)

    def expect(batches):
        model = shared.value
        expected = np.zeros(len(model.hash))

        def rows(kind, key, n):
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int32)), pa.array(key.astype(np.int64)), pa.array(n, pa.float64())], ["kind", "key", "n"])

        for batch in batches:
            n = batch.column("n").to_numpy()
            data, off = text_buffer(batch.column("word").cast(pa.large_binary()).view(pa.large_string()))
            starts, ends = off[:-1], off[1:]
            word = ends > starts
            if not word.all():
                yield rows(END, np.zeros(1, np.int64), n[~word])
            starts, ends, n = starts[word], ends[word], n[word]
            if len(n):
                expected += model.words(data, starts, ends, np.ones(len(n)))[1]
                yield rows(WORD, hashes_of(data, starts, ends), n)
        some = np.flatnonzero(expected)
        yield rows(PIECE, some, expected[some])

    return word_counts(docs).mapInArrow(expect, "kind int, key long, n double")


def lm_scores(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and lattice_score of every row.

    vocabulary: path of a sentencepiece model. lattice_score: the log10 probability of the text's words by the
    vocabulary's scores alone, summed over all segmentations; it has no weight for the end. Null or empty text: only the
    end token, lattice_score 0. A text of any length is scored whole. A null doc_id is held out. Repeated rows each give a row, as each counts
    in training. No training rows: all counts are zero, the base score is that of
    unseen tokens and the lattice has the file's scores alone. Other columns play no part.
    """
    spark = docs.sparkSession
    pieces = load_pieces(vocabulary)
    counts = written(statistics(docs, pieces), "lm-counts")
    row = counts.groupBy().agg(
        F.coalesce(F.sum(F.when(F.col("kind") != PIECE, F.col("n"))), F.lit(0)).cast("long"),
        F.count(F.when(F.col("kind") != PIECE, 1)),
        F.coalesce(F.max(F.when(F.col("kind") == END, F.col("n"))), F.lit(0)).cast("long"),
        F.count(F.when((F.col("kind") != PIECE) & (F.col("n") == 1), 1)),
        F.count(F.when((F.col("kind") != PIECE) & (F.col("n") == 2), 1)),
    ).first()
    n_train, n_distinct, n_end, once, twice = row
    discount = once / (once + 2 * twice) if once and twice else 0.5
    left = discount * n_distinct / n_train if n_train else 1.0  # weight of the pieces' arcs
    den = float(np.log10(n_train + ALPHA * (n_distinct + 1)))
    fitted = counts.where(F.col("kind") == PIECE).groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    expected = np.full(len(pieces.hash), FLOOR)
    expected[fitted.column("key").to_numpy()] += fitted.column("n").to_numpy()
    if n_distinct:
        pieces.logp = np.log(expected / expected.sum())
    words = counts.where(F.col("kind") == WORD).select("key", "n")
    top = words.orderBy(F.desc("n"), "key").limit(FREQUENT).toArrow()
    key = top.column("key").to_numpy().astype(np.int64).view(_U)
    order = np.argsort(key)
    shared = spark.sparkContext.broadcast((Marginals(pieces), key[order], top.column("n").to_numpy()[order]))

    def scan(batches):
        model, frequent, count = shared.value
        log_count = np.log10(count + ALPHA)
        arc = np.maximum(count - discount, 0) / max(n_train, 1)
        base = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in slices(batch, limit=RUN_BYTES):
                rows = part.num_rows
                data, off = text_buffer(part.column("text"))
                data = LOWER[data]
                starts, ends, owner = words_of(data, off, NOT_SPACE)
                h = hashes_of(data, starts, ends)
                key, first, inv = np.unique(h, return_index=True, return_inverse=True)
                marginal, given = model.of(key, data, starts[first], ends[first]).T
                at = np.searchsorted(frequent, key) if len(frequent) else np.zeros(len(key), np.int64)
                known = np.zeros(len(key), bool)
                if len(frequent):
                    at = np.minimum(at, len(frequent) - 1)
                    known = frequent[at] == key
                part_base = np.where(known, log_count[at], 0.0) if len(frequent) else np.zeros(len(key))
                part_score = np.where(known, np.log10(arc[at] + left * np.exp(marginal)), 0.0) if len(frequent) else np.zeros(len(key))
                n = np.bincount(owner, minlength=rows)
                score = np.bincount(owner, part_score[inv], minlength=rows)
                lattice = np.bincount(owner, given[inv], minlength=rows) / np.log(10)
                sums = np.bincount(owner, part_base[inv], minlength=rows)
                hits = np.bincount(owner, known[inv], minlength=rows).astype(np.int64)
                # other words: one row for each text and word
                rare = np.flatnonzero(~known[inv])
                pair, times = np.unique(np.stack([owner[rare], inv[rare]]), axis=1, return_counts=True) if len(rare) else (np.zeros((2, 0), np.int64), np.zeros(0, np.int64))
                r = np.concatenate([np.arange(rows), pair[0]])
                no = np.zeros(len(times))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(base + r), part.column("doc_id").take(pa.array(r)), pa.array(np.concatenate([np.zeros(rows, np.int64), key[pair[1]].astype(np.int64)]), mask=np.arange(len(r)) < rows),
                        pa.array(np.concatenate([n, times]).astype(np.int64)), pa.array(np.concatenate([hits, no.astype(np.int64)])), pa.array(np.concatenate([sums, no])), pa.array(np.concatenate([score, marginal[pair[1]]])), pa.array(np.concatenate([lattice, no])),
                    ],
                    ["row", "doc_id", "word", "n", "n_known", "base", "score", "lattice"],
                )
                base += rows

    kind = docs.schema["doc_id"].dataType.simpleString()
    scanned = in_batches(docs).select("doc_id", "text").mapInArrow(scan, f"row long, doc_id {kind}, word long, n long, n_known long, base double, score double, lattice double")
    rare = words.join(F.broadcast(spark.createDataFrame(pa.table({"key": top.column("key")}))) if top.num_rows else words.limit(0), "key", "left_anti")
    joined = scanned.join(rare.select(F.col("key").alias("word"), F.col("n").alias("c")), "word", "left")
    c = F.coalesce("c", F.lit(0.0))
    is_word = F.col("word").isNotNull()
    end_base = float(np.log10(n_end + ALPHA))
    end_score = float(np.log10(max(n_end - discount, FLOOR) / max(n_train, 1)))
    # log10 of arc + left * exp(marginal), also where the second is too small for a double
    by_pieces = (F.col("score") + float(np.log(left))) / float(np.log(10))
    arc = (c - discount) / float(max(n_train, 1))
    word_score = F.when(c > 0, F.log10(arc + F.pow(F.lit(10.0), by_pieces))).otherwise(by_pieces)
    sums = joined.groupBy("row", "doc_id").agg(
        F.sum(F.when(~is_word, F.col("n"))).alias("n"),
        F.sum(F.when(is_word, F.when(F.col("c") > 0, F.col("n")).otherwise(0)).otherwise(F.col("n_known"))).alias("known"),
        F.sum(F.when(is_word, F.col("n") * F.log10(c + ALPHA)).otherwise(F.col("base"))).alias("base"),
        F.sum(F.when(is_word, F.col("n") * word_score).otherwise(F.col("score"))).alias("score"),
        F.sum("lattice").alias("lattice"),
    )
    return sums.select(
        "doc_id", is_held_out().alias("held_out"), (F.col("n") + 1).alias("n_tokens"),
        (F.col("known") + (1 if n_end else 0)).cast("long").alias("n_known"), F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("base") + end_base - (F.col("n") + 1) * den).alias("base_score"),
        (F.col("score") + end_score).alias("score"), F.col("lattice").alias("lattice_score"),
    )


def op4_lm_scores(spark, sf_dir):
    import public_tokenizers

    return lm_scores(documents(spark, sf_dir, "doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))
