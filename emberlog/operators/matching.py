"""Joins on more than equality: values contained in lines, and times within a window of each other."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .contained import Values, slices

#: lengths of the pieces by which a value is looked for: the longest that it has
GRAMS = (1, 2, 3, 6, 12, 24)
#: values up to which they are broadcast (they are counted), and characters of all of them
SMALL, SMALL_TEXT = 500_000, 1 << 26
SECOND = 1_000_000


def _pieces(text: Column, length: int) -> Column:
    """All pieces of a length, at every position; one pass over the text."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{length}}}))"), F.lit(1))


def rarest_pieces(values: DataFrame) -> DataFrame:
    """value, size and piece: for each distinct value its piece that fewest other values hold, so that what they share, as a prefix, is no piece of theirs."""
    size = F.lit(GRAMS[0])
    for n in GRAMS[1:]:
        size = F.when(F.length("value") >= n, n).otherwise(size)
    each = F.lit(None).cast("array<string>")
    for n in GRAMS:
        each = F.when(F.col("size") == n, _pieces(F.col("value"), n)).otherwise(each)
    rows = values.select("value").distinct().select("value", size.alias("size"))
    rows = rows.select("value", "size", F.explode(F.array_distinct(each)).alias("piece"))
    held = rows.groupBy("piece").agg(F.count("*").alias("held"))
    return rows.join(held, "piece").groupBy("value", "size").agg(F.min_by("piece", F.struct("held", F.xxhash64("piece"), "piece")).alias("piece"))


def containing(lines: DataFrame, values: DataFrame, text: str, keys: list[str], small: int = SMALL) -> DataFrame:
    """The lines with value, one row for each distinct value (a column value, lower case, not empty) that the text holds, whatever its case.

    Up to small values, which are counted, are broadcast and looked for in each batch of lines at once (contained.py); lines aren't shuffled. More of
    them: an inverted table of the values by one piece of each meets the pieces of the lines by an equal join of keys and pieces, the pairs found are
    joined back to the lines, and contains() then decides. Every value is looked for, however short or many.
    """
    values = values.where("value is not null and value <> ''").select("value").distinct()
    few = _few(values, small)
    if few is not None:
        if not few:
            return lines.withColumn("value", F.lit(None).cast("string")).limit(0)
        return _lines_with(lines, few, text)
    table = rarest_pieces(values)
    sizes = sorted(r[0] for r in table.select("size").distinct().collect())
    low = F.lower(text)
    pieces = F.array_distinct(F.concat(*[_pieces(low, n) for n in sizes]))
    pairs = lines.select(*keys, F.explode(pieces).alias("piece")).join(table.select("value", "piece"), "piece").select(*keys, "value").distinct()
    return lines.join(pairs, keys).where(low.contains(F.col("value")))


def _few(values: DataFrame, small: int) -> list[str] | None:
    """The values in order where they are so few that they are broadcast; else None."""
    n, size = values.agg(F.count("*"), F.coalesce(F.sum(F.length("value")), F.lit(0))).first()
    return sorted(r[0] for r in values.collect()) if n <= small and size <= SMALL_TEXT else None


def _lines_with(lines: DataFrame, values: list[str], text: str) -> DataFrame:
    shared = lines.sparkSession.sparkContext.broadcast((Values(values), pa.array(values, pa.string())))
    rows = lines.where(F.col(text).isNotNull()).withColumn("_low", F.lower(text))
    names = [*lines.columns, "value"]

    def scan(batches):
        known, told = shared.value
        for batch in batches:
            low = batch.column("_low")
            for lo, hi in slices(low):
                row, place = known.found_in(low.slice(lo, hi - lo))
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(pa.array(row)) for c in names[:-1]), told.take(pa.array(place))], names)

    return rows.mapInArrow(scan, T.StructType([*lines.schema.fields, T.StructField("value", T.StringType())]))


def lines_of_values(lines: DataFrame, values: DataFrame, text: str, number: str, small: int = SMALL) -> DataFrame | None:
    """value, n, first: in how many lines each value is held (see containing), whatever their case, and the smallest number of such a line; None where the values are too many to be broadcast.

    Tasks count what their batches hold, so what is shuffled is a row for each batch and value, never the lines. Each row of lines counts once.
    """
    values = values.where("value is not null and value <> ''").select("value").distinct()
    few = _few(values, small)
    if few is None:
        return None
    shared = lines.sparkSession.sparkContext.broadcast(Values(few))
    rows = lines.where(F.col(text).isNotNull()).select(F.lower(text).alias("_low"), F.col(number).cast("long").alias("_number"))

    def scan(batches):
        known = shared.value
        n, first = np.zeros(len(few), np.int64), np.full(len(few), np.iinfo(np.int64).max)
        for batch in batches:
            low, numbers = batch.column("_low"), batch.column("_number").to_numpy()
            for lo, hi in slices(low):
                row, place = known.found_in(low.slice(lo, hi - lo))
                n += np.bincount(place, minlength=len(few))
                np.minimum.at(first, place, numbers[lo:hi][row])
        have = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(have), pa.array(n[have]), pa.array(first[have])], ["place", "n", "first"])

    counted = rows.mapInArrow(scan, "place long, n long, first long").groupBy("place").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    told = lines.sparkSession.createDataFrame(pa.table({"place": pa.array(range(len(few)), pa.int64()), "value": pa.array(few, pa.string())}))
    return counted.join(told, "place").select("value", "n", "first")


def interval_join(left: DataFrame, right: DataFrame, on: list[str], seconds: int, left_us: str = "us", right_us: str = "right_us") -> DataFrame:
    """Pairs of rows with equal keys of which the right one is up to seconds later, both ends included; null times and keys meet none.

    Times fall into buckets as long as the window. A left row stands in its own bucket and in the next, a right row in its own: an equal
    join on keys and bucket finds each pair once, and a key with many rows is split by its buckets. Column names must differ but for the keys.
    """
    width = seconds * SECOND
    b = F.floor(F.col(left_us) / width)
    early = left.where(F.col(left_us).isNotNull()).withColumn("_bucket", F.explode(F.array(b, b + 1)))
    late = right.where(F.col(right_us).isNotNull()).withColumn("_bucket", F.floor(F.col(right_us) / width))
    return early.join(late, [*on, "_bucket"]).where((F.col(right_us) >= F.col(left_us)) & (F.col(right_us) <= F.col(left_us) + width)).drop("_bucket")


def last_other(rows: DataFrame, key: str, value: str, order: list[str], carried: list[str], seconds: int, us: str = "us") -> DataFrame:
    """Each row that has an earlier one with its key and another value within the window: with other_<c>, the latest such row's value, time and carried columns.

    Rows stand in the bucket of their time and in the next, and each key and bucket is sorted by itself: what grows with a key is the number of its
    buckets. No pairs are made: before a run of equal values stands the row that all of the run look for. Null keys, values and times take no part.
    """
    width = seconds * SECOND
    b = F.floor(F.col(us) / width)
    own = rows.where(F.col(key).isNotNull() & F.col(value).isNotNull() & F.col(us).isNotNull()).withColumn("_bucket", F.explode(F.array(b, b + 1)))
    w = Window.partitionBy(key, "_bucket").orderBy(us, *order)
    facts = F.struct(F.col(value).alias("v"), F.col(us).alias("t"), *[F.col(c).alias(f"c_{c}") for c in carried])
    before = F.lag(facts).over(w)
    own = own.withColumn("_before", before)
    turn = F.when(F.col("_before.v").isNotNull() & (F.col("_before.v") != F.col(value)), F.col("_before"))
    own = own.withColumn("_other", F.last(turn, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    own = own.where((F.col("_bucket") == b) & (F.col("_other.t") >= F.col(us) - width))
    more = [F.col("_other.v").alias(f"other_{value}"), F.col("_other.t").alias(f"other_{us}"), *[F.col(f"_other.c_{c}").alias(f"other_{c}") for c in carried]]
    return own.select("*", *more).drop("_bucket", "_before", "_other")
