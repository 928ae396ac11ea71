"""Vectors as short codes: the nearest entry of a codebook for each of their parts, exactly, in integers.

Distances are taken after an integer Walsh-Hadamard transform of the parts and the entries, both filled up with zeros to a
power of two: the sum of squared differences is then the squared distance times that power. The coefficients are added
in sequency order (slow changes first, which hold most of the difference), and an entry goes as soon as its sum exceeds
the whole distance of the entry that leads; entries that tie stay to the end. No floating point is used after the components are floored.

The codebooks are of fixed size (parts x entries) and travel to the tasks; each task returns the sums of its rows for each
entry, which Spark adds up. Rows are dealt as the scan deals them: no row is shuffled but for the sums by label.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectors as V
from .common import in_batches, small, unused, written

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
ROWS = 2048  # rows whose parts meet all entries at a time


def transformed(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of each row of integers, filled up with zeros to a power of two, in sequency order."""
    n, width = x.shape
    size = 1 << max(0, (width - 1).bit_length())
    y = np.zeros((n, size), np.int64)
    y[:, :width] = x
    step = 1
    while step < size:
        pairs = y.reshape(n, size // (2 * step), 2, step)
        y = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], 2).reshape(n, size)
        step *= 2
    return y[:, sequency(size)]


def sequency(size: int) -> np.ndarray:
    """The rows of the Hadamard matrix in order of their changes of sign: Gray code, with bits reversed."""
    bits = max(1, size.bit_length() - 1)
    gray = [i ^ i >> 1 for i in range(size)]
    return np.array([int(f"{g:0{bits}b}"[::-1], 2) for g in gray])


class Codebook:
    """The entries of one part."""

    def __init__(self, entries: np.ndarray):
        self.entries = transformed(entries)

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry of each row, the lower one of a tie, and the squared distance."""
        n, k, size = len(parts), *self.entries.shape
        y = transformed(parts)
        row, entry = np.repeat(np.arange(n), k), np.tile(np.arange(k), n)
        total = np.square(y[:, :1] - self.entries[:, 0]).ravel()
        for j in range(1, size):
            first = np.searchsorted(row, np.arange(n))
            lead = np.minimum.reduceat(total * k + entry, first) % k
            most = np.square(y - self.entries[lead]).sum(1)
            keep = total <= most[row]
            row, entry, total = row[keep], entry[keep], total[keep]
            total = total + np.square(y[row, j] - self.entries[entry, j])
        first = np.searchsorted(row, np.arange(n))
        best = np.minimum.reduceat(total * k + entry, first)
        return best % k, best // k // size


def kept(vectors: DataFrame) -> DataFrame:
    """vec_id, label and x, the vector, of rows whose vector is there and finite."""
    return vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x")).where(V.finite("x"))


def _coder(books: np.ndarray, parts: int, width: int):
    """A function that gives the components of a batch, the index of each part, and the distance of each part."""
    own = [Codebook(b) for b in books]

    def code(column: pa.Array, scale: int):
        x = V.as_matrix(column, parts * width, scale).reshape(len(column), parts, width)
        index, distance = np.zeros((len(x), parts), np.int64), np.zeros((len(x), parts), np.int64)
        for at in range(0, len(x), ROWS):
            for p in range(parts):
                index[at : at + ROWS, p], distance[at : at + ROWS, p] = own[p].nearest(x[at : at + ROWS, p])
        return x, index, distance

    return code


def _sums(rows: DataFrame, books: np.ndarray, parts: int, width: int, scale: int) -> DataFrame:
    """part, entry, n, sums: of the parts that each task's rows assign to each entry."""

    def scan(batches):
        code, k = _coder(books, parts, width), books.shape[1]
        count, total = np.zeros(parts * k, np.int64), np.zeros((parts * k, width), np.int64)
        for batch in batches:
            if batch.num_rows:
                x, index, _ = code(batch.column("x"), scale)
                flat = (index + k * np.arange(parts)).ravel()
                count += np.bincount(flat, minlength=parts * k)
                np.add.at(total, flat, x.reshape(-1, width))
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_pydict({"part": pa.array(used // k, pa.int32()), "entry": pa.array(used % k, pa.int32()), "n": pa.array(count[used]), "sums": pa.array(total[used].tolist(), pa.list_(pa.int64()))})

    return rows.select("x").mapInArrow(scan, "part int, entry int, n long, sums array<long>")


def codebooks(rows: DataFrame, width: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> np.ndarray:
    """Entries by part and number: at first the parts of the smallest vec_ids, then rounds times the floored means of their rows' parts."""
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "x").select("x").limit(entries).toArrow().column("x").combine_chunks()
    books = V.as_matrix(first, parts * width, scale).reshape(len(first), parts, width).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        for r in V.totals(_sums(rows, books, parts, width, scale), ["part", "entry"], width):
            books[r["part"], r["entry"]] = V.floor_means(r["n"], r["sums"])
    return books


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def coded(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """vec_id, label, code, error of each kept vector, and label_error and codebooks_sha256; other columns play no part.

    code has two hex digits for each part. Rows whose vector is null or holds null, NaN or infinite components are dropped. Vectors of
    fewer components than the longest, or of a number that the parts do not divide, count as filled up with zeros.
    Repeated rows are coded each; a null vec_id comes after all others, equal ids in order of their vectors. Fewer rows
    than entries: as many entries as rows. No rows give no rows. Components so large that distances leave 64 bits raise an error.
    """
    if entries > 256:
        raise ValueError("two hex digits name 256 entries at most")
    rows = in_batches(kept(vectors))
    longest, largest = rows.agg(F.max(F.size("x")), F.max(F.array_max(F.transform("x", F.abs)))).first()
    width = max(1, -(-(longest or 1) // parts))
    size = 1 << (width - 1).bit_length()
    V.bounded(largest, scale, int((2**61 / (4 * size * width * entries)) ** 0.5))
    schema = "vec_id long, label int, code string, error long".replace("label int", f"label {dict(rows.dtypes)['label']}")
    if longest is None:
        return rows.sparkSession.createDataFrame([], f"{schema}, label_error long, codebooks_sha256 string")
    books = codebooks(rows, width, parts, entries, rounds, scale)

    def scan(batches):
        code = _coder(books, parts, width)
        for batch in batches:
            if batch.num_rows:
                _, index, distance = code(batch.column("x"), scale)
                names = [row.astype(np.uint8).tobytes().hex() for row in index]
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(names, pa.string()), pa.array(distance.sum(1))], ["vec_id", "label", "code", "error"])

    out = written(rows.mapInArrow(scan, schema), "vector-codes")
    key = unused(out, "key")
    by_label = out.groupBy(F.col("label").alias(key)).agg(F.sum("error").alias("label_error"))
    return out.join(small(by_label), F.col("label").eqNullSafe(F.col(key))).drop(key).withColumn("codebooks_sha256", F.lit(digest(books)))


def op11_vector_codes(spark, sf_dir):
    return coded(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """The same by plain squared differences."""
    floor_mean = "cast((s - ((s % n) + n) % n) // n as bigint)"
    steps = [
        "kept as materialized (select row_number() over (order by vec_id nulls last, embedding) - 1 as r, vec_id, label, embedding from embeddings where embedding is not null and len(list_filter(embedding, lambda v: v is null or not isfinite(v))) = 0)",
        f"width as (select max(len(embedding)) // {parts} as w from kept)",
        f"cells as materialized (select r, (i - 1) // w as part, (i - 1) % w as pos, cast(floor({scale}::double * embedding[i]) as bigint) as v from kept, width, range(1, {parts} * w + 1) t(i))",
        f"book0 as materialized (select part, r as entry, pos, v from cells where r < {entries})",
    ]
    for i in range(rounds + 1):
        steps.append(f"near{i} as materialized (select r, part, entry, d from (select r, part, entry, d, row_number() over (partition by r, part order by d, entry) as place from (select c.r, c.part, b.entry, sum((c.v - b.v) * (c.v - b.v)) as d from cells c join book{i} b on c.part = b.part and c.pos = b.pos group by all)) where place = 1)")
        if i < rounds:
            mean = f"select part, entry, pos, {floor_mean} as v from (select n.part, n.entry, c.pos, sum(c.v) as s, count(*) as n from near{i} n join cells c on n.r = c.r and n.part = c.part group by all)"
            steps.append(f"book{i + 1} as materialized (select part, entry, pos, coalesce(m.v, b.v) as v from book{i} b left join ({mean}) m using (part, entry, pos))")
    steps.append(f"coded as (select r, string_agg(printf('%02x', entry), '' order by part) as code, cast(sum(d) as bigint) as error from near{rounds} group by r)")
    steps.append(f"named as (select sha256(string_agg(v::varchar, ',' order by part, entry, pos)) as codebooks_sha256 from book{rounds})")
    return f"with {', '.join(steps)} select vec_id, label, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, codebooks_sha256 from kept join coded using (r), named"


SQL = _sql()
