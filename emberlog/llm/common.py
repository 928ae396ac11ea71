"""Vectorised text handling for Arrow batches, and small Spark helpers.

A batch of texts is seen as one byte array with offsets, so that words are cut
and hashed by numpy for a whole slice at once. Slices are bounded in bytes, so
a task's memory does not follow the number of rows in a batch; a text longer
than the bound makes a slice of its own and is never cut.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 20
_HASH_BYTES = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
NOT_SPACE = ~SPACE
#: lower-case A-Z, other bytes as they are
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: a-z, 0-9 and every byte of a non-ASCII character (after LOWER)
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True

_rng = np.random.default_rng(0x5EED)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_M1 = np.uint64(0xFF51AFD7ED558CCD)
_M2 = np.uint64(0xC4CEB9FE1A85EC53)
_pow: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * _M1
    h = h ^ (h >> np.uint64(33))
    h = h * _M2
    return h ^ (h >> np.uint64(33))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_pow[0]) < n:
        for k, p in enumerate((_P, _P_INV)):
            full = np.full(n, p, np.uint64)
            full[0] = 1
            _pow[k] = np.multiply.accumulate(full)
    return _pow[0][:n], _pow[1][:n]


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES):
    """Cuts a batch in runs of rows of at most limit text bytes, or one row."""
    if not batch.num_rows:
        return
    _, off = text_buffer(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def words_of(data: np.ndarray, off: np.ndarray, table: np.ndarray):
    """Start, end and row of every run of bytes that the table marks; runs never cross rows."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = table[data]
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    first = off[:-1]
    before[first[first < n]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    last = off[1:]
    after[last[last > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    rows = np.searchsorted(off, starts, "right") - 1
    return starts, ends, rows


def hashes_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span, by running sums; spans are ascending and disjoint."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + _HASH_BYTES, "right")))
        lo, hi = int(starts[at]), int(ends[to - 1])
        up, down = _powers(hi - lo + 1)
        run = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(_BYTE[data[lo:hi]] * up[:-1], out=run[1:])
        s, e = starts[at:to] - lo, ends[at:to] - lo
        out[at:to] = (run[e] - run[s]) * down[s] + (e - s).astype(np.uint64)
        at = to
    return mix(out)


def hash_word(word: bytes) -> int:
    data = np.frombuffer(word, np.uint8)
    return int(hashes_of(data, np.array([0]), np.array([len(data)]))[0])


def grams(hashes: np.ndarray, rows: np.ndarray, k: int):
    """Hash and index of the first word of each run of k words of one row."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(n, np.uint64)
    for j in range(k):
        total = total * _P + hashes[j : j + n]
    keep = np.flatnonzero(rows[:n] == rows[k - 1 :])
    return mix(total[keep]), keep


def word_counts(rows: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows, minlength=n).astype(np.int64)


# --- Spark helpers -----------------------------------------------------------------


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. In local mode, where none need be named, one of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="emberlog-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", named)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes a table to the shared folder and reads it again."""
    path = os.path.join(shared_dir(df.sparkSession), f"emberlog-{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def forget(*tables: DataFrame | None) -> None:
    """Deletes written tables that nothing will read again."""
    for df in tables:
        if df is not None:
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_at)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


#: A table of two longs of this many rows takes about 32 MB as a hash relation.
BROADCAST_ROWS = 500_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Marks a materialised narrow table for broadcast if its counted rows allow it; else Spark shuffles."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


BATCH_BYTES = 4 << 20


def in_batches(df: DataFrame) -> DataFrame:
    """Bounds the session's Arrow batches in bytes, so that neither JVM nor Python holds thousands of long texts at once."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = re.match(r"(\d+)", str(conf.get(name)))
    if not now or not 0 < int(now[1]) <= BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))
    return df


def unused(df: DataFrame, name: str) -> str:
    """The name, with as many underscores before it that no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return df.select(*columns) if columns else df
