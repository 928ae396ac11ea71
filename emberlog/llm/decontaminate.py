"""Benchmark decontamination by spaced-seed hashing.

A mask looks at some word positions of a window and ignores the others, so a changed
word at an ignored place leaves the hash as it is. The hashes of all windows of the test
items are joined map-side with those of the texts; around each hit the words of text
and item are compared along the whole diagonal, and the best-matching stretch decides.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, LOWER, documents, hashes_of, in_batches, mix, slices, text_buffer, words_of

#: 1: position looked at; weights of 8 and 9, different gaps
MASKS = ("11111111", "1101100110101", "101011001101011", "11100101100111")
MISMATCH = 2.0  # a changed word costs as much as this many equal ones gain
LEAST = 10.0  # least score of a stretch
SHORT = 16  # items of fewer words are found whole only, with one changed word for each EIGHT of theirs
EIGHT = 8
BLOCK_WORDS = 2_000_000  # words of test items in one broadcast, about 100 MB with their hashes
_K = np.uint64(0x9E3779B97F4A7C15)


def least_run(n: int) -> int:
    """Words that an accepted stretch of an item of n words has equal in a row at least: x changes cut the equal words in x + 1 runs."""
    if n < SHORT:
        return -(-(n - n // EIGHT) // (n // EIGHT + 1))
    runs = []
    for x in range(n):
        equal = int(np.ceil(LEAST + MISMATCH * x))
        if equal + x <= n:
            runs.append(-(-equal // (x + 1)))
    return min(runs)


def _seed(h: np.ndarray, owner: np.ndarray, mask: str):
    """Hash of each window of the mask's length within one row, and its first word's index."""
    n = len(h) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.full(n, len(mask), np.uint64)
    for j, bit in enumerate(mask):
        if bit == "1":
            total = total * _K + h[j : j + n]
    keep = np.flatnonzero(owner[:n] == owner[len(mask) - 1 :])
    return mix(total[keep]), keep


class Index:
    """Seed hashes of test items, sorted, with the word index of each; each item also gets the contiguous mask that no accepted stretch of it can miss."""

    def __init__(self, ids: list, texts: pa.Array, contained: bool = False):
        data, off = text_buffer(texts)
        data = LOWER[data]
        starts, ends, owner = words_of(data, off, ALNUM)
        self.ids, self.owner, self.words = ids, owner, hashes_of(data, starts, ends)
        self.first = np.searchsorted(owner, np.arange(len(ids) + 1))
        size = np.diff(self.first)
        self.short: dict[tuple, list[int]] = {}  # items of one or two words, by their hashes
        least = 1 if contained else 3
        for k in np.flatnonzero((size > 0) & (size < least)).tolist():
            self.short.setdefault(tuple(self.words[self.first[k] : self.first[k + 1]].tolist()), []).append(k)
        run = np.array([least_run(int(n)) if n >= least else 0 for n in size], np.int64)
        self.masks = [*MASKS, *("1" * int(r) for r in np.unique(run[run > 0]))]
        self.seeds = []
        for k, mask in enumerate(self.masks):
            h, at = _seed(self.words, owner, mask)
            if k >= len(MASKS):
                own = run[owner[at]] == len(mask)
                h, at = h[own], at[own]
            order = np.argsort(h, kind="stable")
            bits = np.zeros(1 << 22, bool)
            bits[(h & np.uint64(0x3FFFFF)).astype(np.int64)] = True
            self.seeds.append((h[order], at[order], bits))

    def matches(self, data: np.ndarray, off: np.ndarray):
        """(row, item, start, end, equal words, score) of the best stretch of each row and item that is enough; items of one or two words by the whole row, unless contained."""
        data = LOWER[data]
        starts, ends, owner = words_of(data, off, ALNUM)
        h = hashes_of(data, starts, ends)
        tried, best = set(), {}
        for mask, (keys, at, bits) in zip(self.masks, self.seeds, strict=True):
            g, i = _seed(h, owner, mask)
            hit = bits[(g & np.uint64(0x3FFFFF)).astype(np.int64)]
            g, i = g[hit], i[hit]
            lo, hi = np.searchsorted(keys, g, "left"), np.searchsorted(keys, g, "right")
            for p, a, b in zip(i[hi > lo], lo[hi > lo], hi[hi > lo], strict=True):
                for q in at[a:b]:
                    place = (int(owner[p]), int(self.owner[q]), int(p - q))
                    if place not in tried:
                        tried.add(place)
                        found = self._stretch(h, owner, *place)
                        if found and found[3] > best.get(place[:2], (0, 0, 0, 0))[3]:
                            best[place[:2]] = found
        row_first = np.searchsorted(owner, np.arange(len(off)))
        if self.short:
            n = np.diff(row_first)
            for r in np.flatnonzero((n > 0) & (n < 3)).tolist():
                s, e = int(row_first[r]), int(row_first[r + 1])
                for t in self.short.get(tuple(h[s:e].tolist()), ()):
                    best[r, t] = (s, e, e - s, float(e - s))
        return [(r, t, s - int(row_first[r]), e - int(row_first[r]), m, score) for (r, t), (s, e, m, score) in sorted(best.items())]

    def _stretch(self, h, owner, row, item, shift):
        """The best-scoring stretch where text and item lie on one diagonal; of a short item the whole, or none."""
        a, b = int(self.first[item]), int(self.first[item + 1])
        lo, hi = max(a + shift, 0), min(b + shift, len(h))
        lo += int(np.searchsorted(owner[lo:hi], row, "left"))
        hi = lo + int(np.searchsorted(owner[lo:hi], row, "right"))
        same = h[lo:hi] == self.words[lo - shift : hi - shift]
        if b - a < SHORT:
            equal = int(same.sum())
            whole = hi - lo == b - a and b - a - equal <= (b - a) // EIGHT
            return (lo, hi, equal, equal - MISMATCH * (b - a - equal)) if whole else None
        run = np.concatenate([[0.0], np.cumsum(np.where(same, 1.0, -MISMATCH))])
        gain = run - np.minimum.accumulate(run)
        end = int(np.argmax(gain))
        start = int(np.argmin(run[: end + 1]))
        score = float(gain[end])
        return (lo + start, lo + end, int(same[start:end].sum()), score) if score >= LEAST else None


def _blocks(bench: DataFrame, block_words: int, contained: bool):
    """The test items as broadcasts of a bounded number of words each."""
    bench = bench.where(F.col("text").isNotNull()).select("item_id", "text")
    total = bench.agg(F.sum(F.length("text"))).first()[0] or 0
    n = 1 + total // (2 * block_words)  # a word and its separator are two characters at least
    for k in range(n):
        own = bench.where(F.pmod(F.xxhash64("text"), F.lit(n)) == k).orderBy("item_id", "text").toArrow()
        if own.num_rows:
            yield bench.sparkSession.sparkContext.broadcast(Index(own.column("item_id").to_pylist(), own.column("text").combine_chunks(), contained))


def overlaps(docs: DataFrame, bench: DataFrame, block_words: int = BLOCK_WORDS, contained: bool = False) -> DataFrame:
    """One row for each document and test item that overlap.

    doc_id, item_id, start_word, end_word (of the text, end exclusive), n_equal and score.
    An item of 16 words or more is found by a stretch that scores LEAST. A shorter one is found whole only, with one changed word from 8 words on; one
    of one or two words where it is the whole text, as such words alone stand in any text, or anywhere if contained says so.
    Null or empty texts overlap nothing. Equal items are all reported, repeated rows each. Without items or rows the
    result is empty. A text of any length is searched whole.
    A test set of any size is taken in blocks, each against all texts.
    """
    kinds = docs.schema["doc_id"].dataType.simpleString(), bench.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, start_word long, end_word long, n_equal long, score double"
    out = docs.sparkSession.createDataFrame([], schema)
    for shared in _blocks(bench, block_words, contained):

        def scan(batches, shared=shared):
            index = shared.value
            for batch in batches:
                for part in slices(batch):
                    if found := index.matches(*text_buffer(part.column("text"))):
                        r, t, s, e, m, score = zip(*found, strict=True)
                        yield pa.RecordBatch.from_arrays(
                            [part.column("doc_id").take(pa.array(r, pa.int64())), pa.array([index.ids[x] for x in t]), pa.array(s, pa.int64()), pa.array(e, pa.int64()), pa.array(m, pa.int64()), pa.array(score, pa.float64())],
                            ["doc_id", "item_id", "start_word", "end_word", "n_equal", "score"],
                        )

        out = out.unionByName(in_batches(docs).select("doc_id", "text").mapInArrow(scan, schema))
    return out


def clean_of(docs: DataFrame, bench: DataFrame, block_words: int = BLOCK_WORDS, contained: bool = False) -> DataFrame:
    """The documents that overlap no test item, with all of their columns."""
    for shared in _blocks(bench, block_words, contained):

        def keep(batches, shared=shared):
            index = shared.value
            for batch in batches:
                for part in slices(batch):
                    mask = np.ones(part.num_rows, bool)
                    mask[[x[0] for x in index.matches(*text_buffer(part.column("text")))]] = False
                    yield part.filter(pa.array(mask))

        docs = in_batches(docs).mapInArrow(keep, docs.schema)
    return docs


def op2_decontaminate(spark, sf_dir):
    return overlaps(documents(spark, sf_dir, "doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
