"""Vectors as rows of integers, for operators that are exact."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(x: Column | str) -> Column:
    """Whether an array is there and all its components are finite numbers."""
    return F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))


def as_matrix(column: pa.Array, width: int, scale: int) -> np.ndarray:
    """floor(scale * x) of a batch's vectors, in rows of width integers; shorter vectors go on with zeros."""
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    values = np.floor(flat.astype(np.float64) * scale).astype(np.int64)
    if len(values) == n * width:
        return values.reshape(n, width)
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((n, width), np.int64)
    out[np.arange(width) < sizes[:, None]] = values
    return out


def bounded(largest: float | None, scale: int, limit: int) -> None:
    """Raises where a component would be so large that squared distances leave 64 bits."""
    if largest is not None and largest * scale >= limit:
        raise ValueError(f"a component of {largest} is too large for exact distances in 64 bits; the limit is {limit / scale}")


def totals(parts: DataFrame, keys: list[str], width: int) -> list:
    """For each of the keys, rows counted and the sums of their components: partial sums (keys, n, sums) of all tasks added up."""
    sums = F.array(*[F.sum(F.col("sums")[i]) for i in range(width)])
    return parts.groupBy(*keys).agg(F.sum("n").alias("n"), sums.alias("sums")).collect()


def floor_means(n: int, sums: list[int]) -> list[int]:
    return [s // n for s in sums]
