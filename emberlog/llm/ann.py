"""Nearest vectors by inner product, by collision-counting hashing.

Each projection on a random line is one sorted array. Around the query's own projections
windows widen step by step (virtual rehashing: a wider window is a coarser hash), and each
vector counts the windows it falls into. Those that collide in COLLIDE of the lines or more are
verified with the original vectors. The k-th best distance verified so far tells when to stop: once the
windows are so wide that a vector at that distance collides often enough with a chance of 0.88 or more
(nearer ones with a larger one). One more coordinate makes all vectors equally long, so that nearness
by inner product is nearness by distance.

Vectors and queries are dealt to cells, each a block of rows and a chunk of the queries, both bounded in
bytes; a cell indexes its block, so every row is indexed and every query meets every row. The
work is that of all queries against all rows, at the share of rows that the windows leave.
"""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LINES = 80
COLLIDE = 0.45  # share of the lines that a candidate collides in
SURE = 1.2  # standard deviations of that share that a vector at the k-th distance is above it
WIDEN = 1.1
BLOCK_BYTES, CHUNK_BYTES = 16 << 20, 2 << 20
LEAST_CHUNK = 256  # queries
PROBES = 9  # rows of a block that tell how wide its windows get


def reach(lines: int = LINES) -> float:
    """Half a window's width, in distances, at which a vector at that distance collides in COLLIDE of the lines for SURE."""
    share = COLLIDE + SURE * (COLLIDE * (1 - COLLIDE) / lines) ** 0.5
    return NormalDist().inv_cdf((1 + share) / 2)


class Index:
    """Sorted projections of one block of vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, longest: float, lines: int = LINES):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors, self.lines = ids[order], vectors[order], lines
        n, d = vectors.shape
        self.axes = np.random.default_rng(23).normal(size=(d + 1, lines))
        self.longest = longest
        extra = np.sqrt(np.maximum(longest**2 - (self.vectors**2).sum(1), 0))
        h = np.concatenate([self.vectors, extra[:, None]], 1) @ self.axes
        # all lines in one ascending array, each in a range of its own
        self.gap = 4.0 * max(1e-9, float(np.abs(h).max()), longest * float(np.linalg.norm(self.axes, axis=0).max()))
        at = np.argsort(h, axis=0, kind="stable").T
        self.who = np.ascontiguousarray(at).astype(np.int64).ravel()
        self.keys = (np.take_along_axis(h.T, at, 1) + self.gap * np.arange(lines)[:, None]).ravel()
        self.start = 0.2 * max(float(np.median(h.std(0))), 1e-6 * self.gap)
        self.reach = reach(lines)
        self.begin: float | None = None
        self.verified = 0

    def nearest(self, query_id: int, query: np.ndarray, k: int) -> list[tuple[int, float]]:
        """The k best found of the rows of other ids, and all that tie with the last. The answer depends on the block and the query alone."""
        if self.begin is None:
            # the block's first rows as queries tell how wide windows get; widening begins a little within that
            own = [self._verified(int(i), v, k, self.start)[2] for i, v in zip(self.ids[:PROBES], self.vectors[:PROBES], strict=True)]
            self.begin, self.verified = float(np.median(own)) / WIDEN**2, 0
        found, score, _ = self._verified(query_id, query, k, self.begin)
        if len(found) > k:
            near = score >= np.partition(score, -k)[-k]
            found, score = found[near], score[near]
        order = np.lexsort((self.ids[found], -score))
        return [(int(self.ids[found[i]]), float(score[i])) for i in order[:k]]

    def _verified(self, query_id: int, query: np.ndarray, k: int, half: float) -> tuple[np.ndarray, np.ndarray, float]:
        """Rows verified, their scores, and half the width at which the windows end, where they begin with half."""
        length = float(np.linalg.norm(query))
        center = (query * (self.longest / length)) @ self.axes[:-1] + self.gap * np.arange(self.lines)
        n, count = len(self.ids), np.zeros(len(self.ids), np.int64)
        first = n * np.arange(self.lines)
        need = int(np.ceil(COLLIDE * self.lines))
        done = self.ids == query_id
        found, score = np.zeros(0, np.int64), np.zeros(0)
        half = min(half, self.gap / 4)
        lo = hi = None
        while True:
            a = np.maximum(np.searchsorted(self.keys, center - half), first)
            b = np.minimum(np.searchsorted(self.keys, center + half, "right"), first + n)
            if lo is None:
                new = [self.who[s:e] for s, e in zip(a, b, strict=True)]
            else:
                new = [self.who[s:e] for s, e in zip(a, lo, strict=True) if s < e] + [self.who[s:e] for s, e in zip(hi, b, strict=True) if s < e]
            if new:
                count += np.bincount(np.concatenate(new), minlength=n)
            lo, hi = a, b
            fresh = np.flatnonzero((count >= need) & ~done)
            done[fresh] = True
            found, score = np.append(found, fresh), np.append(score, np.einsum("ij,j->i", self.vectors[fresh], query))
            wanted = self.gap / 2
            if len(found) >= k:
                best = float(np.partition(score, -k)[-k])
                wanted = min(wanted, self.reach * max(0.0, 2 * self.longest * (self.longest - best / length)) ** 0.5)
            if half >= wanted:
                self.verified += len(found)
                return found, score, half
            half = min(half * WIDEN, wanted)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and x, an array of doubles: without nulls, non-finite components or zero vectors, of the commonest length."""
    x = F.col("embedding").cast("array<double>")
    ok = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    found = vectors.select("vec_id", x.alias("x")).where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & ok)
    length = found.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return found.where(F.size("x") == (length["d"] if length else 0))


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, block_bytes: int = BLOCK_BYTES, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each vector whose id is divisible by every.

    Null, zero or non-finite vectors, null ids and vectors of another than the commonest length take no
    part. Rows of one query id are one query, that of the least vector. Rows of a query's own id are no
    candidates; all other rows are, those of one id each. Ties go to the smaller vec_id. Fewer candidates
    than k: all of them. No rows give no rows; other columns play no part.
    """
    found = usable(vectors)
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v))
    n, longest, asked, d = found.agg(F.count("*"), F.max(norm), F.count_distinct(F.when(F.col("vec_id") % every == 0, F.col("vec_id"))), F.max(F.size("x"))).first()
    row_bytes = 8 * (d or 1)
    blocks = max(1, -(-n * row_bytes // block_bytes))
    # small tables still give every core a cell; how queries are dealt changes no answer
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    chunks = max(1, -(-asked * row_bytes // chunk_bytes), min(-(-asked // LEAST_CHUNK), -(-2 * cores // blocks)))
    block = F.pmod(F.xxhash64("vec_id", "x"), F.lit(blocks)).cast("int").alias("block")
    rows = found.select(block, "vec_id", "x").select("block", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), "vec_id", "x")
    asks = found.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("x").alias("x"))
    chunk = F.pmod(F.xxhash64("vec_id"), F.lit(chunks)).cast("int").alias("chunk")
    asks = asks.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), chunk, "vec_id", "x")
    longest = float(longest or 1.0)
    schema = "query_id long, vec_id long, score double"

    def matrix(table: pa.Table) -> np.ndarray:
        flat = table.column("x").combine_chunks().flatten().to_numpy()
        return flat.reshape(table.num_rows, -1)

    def search(rows: pa.Table, asks: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        if rows.num_rows and asks.num_rows:
            index = Index(rows.column("vec_id").to_numpy(), matrix(rows), longest)
            for q, x in zip(asks.column("vec_id").to_pylist(), matrix(asks), strict=True):
                for v, s in index.nearest(q, x, k):
                    for column, value in zip(out, (q, v, s), strict=True):
                        column.append(value)
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})

    each = rows.groupBy("block", "chunk").cogroup(asks.groupBy("block", "chunk")).applyInArrow(search, schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return each.select("query_id", rank.cast("int").alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def op3_nearest(spark, sf_dir):
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
