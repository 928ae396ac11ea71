"""Vectors by their nearest centroid, exactly, in integers, by Orchard's search.

Each centroid has a list of all others, sorted by their distance from it. A vector walks along the list of its current
centroid; when it meets a closer one it goes over to that one's list. Centroids met before are passed over. It stops when the next on the list
is strictly farther from the current centroid than twice the vector's distance: all that follow are farther from the vector than the
current one, and one that ties is still met. Squared distances are compared, four times for twice.

Centroids are few (a parameter) and travel to the tasks. Each task returns one row of sums for each centroid; Spark adds
them up, and the driver gets as many rows as there are centroids. Every round scans the vectors anew; no row is shuffled.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectors as V
from .common import in_batches, written

CENTROIDS, ROUNDS, SCALE, WIDTH, SEED = 8, 10, 1024, 64, 3
ROWS = 8192  # vectors that walk at a time


class Orchard:
    """The sorted neighbour lists of centroids."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        apart = np.stack([np.square(centroids - c).sum(1) for c in centroids])
        self.order = np.argsort(apart, axis=1, kind="stable")
        self.apart = np.take_along_axis(apart, self.order, 1)
        self.measured = 0

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest centroid of each row, the smaller one of a tie, and the squared distance."""
        n, k = len(x), len(self.centroids)
        now, place, met = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros((n, k), bool)
        met[:, 0] = True
        best = np.square(x - self.centroids[0]).sum(1)
        self.measured += n
        walking = np.arange(n)
        while len(walking):
            walking = walking[place[walking] < k]
            walking = walking[self.apart[now[walking], place[walking]] <= 4 * best[walking]]
            other = self.order[now[walking], place[walking]]
            place[walking] += 1
            fresh = ~met[walking, other]
            rows, other = walking[fresh], other[fresh]
            met[rows, other] = True
            distance = np.square(x[rows] - self.centroids[other]).sum(1)
            self.measured += len(rows)
            closer = (distance < best[rows]) | (distance == best[rows]) & (other < now[rows])
            rows = rows[closer]
            now[rows], best[rows], place[rows] = other[closer], distance[closer], 0
        return now, best

    def walked(self, column: pa.Array, scale: int):
        """Integers, numbers and distances of a batch of vectors, some at a time."""
        for at in range(0, len(column), ROWS):
            x = V.as_matrix(column.slice(at, ROWS), self.centroids.shape[1], scale)
            yield at, x, *self.nearest(x)


def _sums(rows: DataFrame, centroids: np.ndarray, scale: int) -> DataFrame:
    """cluster, n, sums: of the rows that each task assigns to each centroid."""

    def scan(batches):
        search, (k, width) = Orchard(centroids), centroids.shape
        count, total = np.zeros(k, np.int64), np.zeros((k, width), np.int64)
        for batch in batches:
            for _, x, number, _ in search.walked(batch.column("x"), scale):
                count += np.bincount(number, minlength=k)
                np.add.at(total, number, x)
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_pydict({"cluster": pa.array(used, pa.int32()), "n": pa.array(count[used]), "sums": pa.array(total[used].tolist(), pa.list_(pa.int64()))})

    return rows.select("x").mapInArrow(scan, "cluster int, n long, sums array<long>")


def clustered(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, scale: int = SCALE, width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of each vector of width finite components.

    Vectors that are null, of another length, or hold null, NaN or infinite components are dropped; other columns play no
    part. Repeated rows count each; equal ids begin in order of their vectors, and a null vec_id comes last. Fewer vectors
    than k: as many centroids as vectors. No vectors give no rows. A centroid without vectors stays as it is. Components so
    large that distances leave 64 bits raise an error.
    """
    x = F.col("embedding").cast("array<double>")
    rows = in_batches(vectors.select("vec_id", x.alias("x")).where(F.size("x") == width).where(V.finite("x")))
    largest = rows.agg(F.max(F.array_max(F.transform("x", F.abs)))).first()[0]
    V.bounded(largest, scale, int((2**58 / width) ** 0.5))
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = rows.orderBy(rank.asc_nulls_last(), "x").select("x").limit(k).toArrow().column("x").combine_chunks()
    centroids = V.as_matrix(first, width, scale)
    if not len(centroids):
        return rows.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        for r in V.totals(_sums(rows, centroids, scale), ["cluster"], width):
            centroids[r["cluster"]] = V.floor_means(r["n"], r["sums"])

    def scan(batches):
        search = Orchard(centroids)
        for batch in batches:
            for at, _, number, distance in search.walked(batch.column("x"), scale):
                yield pa.RecordBatch.from_arrays([batch.column("vec_id").slice(at, len(number)), pa.array(number, pa.int32()), pa.array(distance)], ["vec_id", "cluster", "distance"])

    out = written(rows.mapInArrow(scan, "vec_id long, cluster int, distance long"), "clusters")
    sums = {r["cluster"]: r["s"] for r in out.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    names = [(c, s, sum(sums.values()), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, s in sums.items()]
    about = rows.sparkSession.createDataFrame(names, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_clusters(spark, sf_dir):
    return clustered(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _sql(k: int = CENTROIDS, rounds: int = ROUNDS, scale: int = SCALE, width: int = WIDTH, seed: int = SEED) -> str:
    """The same by all distances."""
    floor_mean = "cast((s - ((s % n) + n) % n) // n as bigint)"
    steps = [
        f"kept as materialized (select row_number() over (order by sha256('{seed}:' || vec_id) nulls last, embedding) - 1 as r, vec_id, embedding from embeddings where len(embedding) = {width} and len(list_filter(embedding, lambda v: v is null or not isfinite(v))) = 0)",
        f"cells as materialized (select r, i as pos, cast(floor({scale}::double * embedding[i]) as bigint) as v from kept, range(1, {width + 1}) t(i))",
        f"cent0 as materialized (select r as cluster, pos, v from cells where r < {k})",
    ]
    for i in range(rounds + 1):
        steps.append(f"near{i} as materialized (select r, cluster, d from (select r, cluster, d, row_number() over (partition by r order by d, cluster) as place from (select c.r, b.cluster, sum((c.v - b.v) * (c.v - b.v)) as d from cells c join cent{i} b using (pos) group by all)) where place = 1)")
        if i < rounds:
            mean = f"select cluster, pos, {floor_mean} as v from (select n.cluster, c.pos, sum(c.v) as s, count(*) as n from near{i} n join cells c using (r) group by all)"
            steps.append(f"cent{i + 1} as materialized (select cluster, pos, coalesce(m.v, b.v) as v from cent{i} b left join ({mean}) m using (cluster, pos))")
    steps.append(f"named as (select cluster, sha256(string_agg(v::varchar, ',' order by pos)) as centroid_sha256 from cent{rounds} group by cluster)")
    return (
        f"with {', '.join(steps)} select vec_id, cast(cluster as int) as cluster, cast(d as bigint) as distance, cast(sum(d) over (partition by cluster) as bigint) as cluster_inertia, "
        f"cast(sum(d) over () as bigint) as inertia, centroid_sha256 from kept join near{rounds} using (r) join named using (cluster)"
    )


SQL = _sql()
