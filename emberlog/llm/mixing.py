"""Mixing sources to target weights, with DataFrame functions only.

The text is read once, for sizes. The mix takes documents in the order of a
hash; where to stop is found by nested histograms of token sums over hash
digits: the first level holds every source, each further level only the one
bucket that the source's budget cuts, until the cut lies between two hashes. The last
pass is a filter. No document is ever sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, small, unused, written

WEIGHTS = (3, 1, 2)
BUDGET = 1.5
MOST = 2
#: hash digits of four hexadecimal places, three of them
LEVELS, PLACES = 3, 4


def word_count(text: Column) -> Column:
    """Runs of other characters than space, tab to carriage return; null has none."""
    blank = F.trim(F.translate(text, "\t\n\x0b\x0c\r", "     "))
    return F.when(
        F.length(F.coalesce(blank, F.lit(""))) > 0,
        F.size(F.filter(F.split(blank, " "), lambda w: w != "")),
    ).otherwise(0).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and hash digits; a document without id hashes by its text."""
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.coalesce("text", F.lit("")))))
    hexa = F.substring(digest, 1, LEVELS * PLACES)
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.conv(hexa, 16, 10).cast("long").alias("h"))


def targets(sizes: DataFrame, weights=WEIGHTS) -> DataFrame:
    """Each source's target: its share by weight, stopped at twice its size, the excess reshared.

    The resharing ends where every source not stopped has the same target per
    weight; sources stop in the order of size by weight, so running sums over
    that order find the level. One row for each source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    per = per.select("source", "source_size", w.cast("long").alias("w"))
    every = Window.partitionBy()
    by_ratio = Window.orderBy(F.col("source_size") / F.col("w"), F.col("source").asc_nulls_last())
    so_far = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    s = per.select(
        "*",
        (3 * F.sum("source_size").over(every)).alias("budget2"),
        F.coalesce(F.sum("source_size").over(so_far), F.lit(0)).alias("stopped"),
        (F.sum("w").over(every) - F.coalesce(F.sum("w").over(so_far), F.lit(0))).alias("left_w"),
    )
    # budget2 is twice the budget of 1.5 times all sizes; a stopped source has 2 * source_size
    level = (F.col("budget2") - 4 * F.col("stopped")).cast("double") / (2 * F.col("left_w")).cast("double")
    s = s.select("*", level.alias("level"))
    s = s.select("*", F.min(F.when(F.col("level") * F.col("w") <= MOST * F.col("source_size"), F.struct("stopped", "level"))).over(every)["level"].alias("final"))
    target = F.least(F.col("w") * F.coalesce("final", F.lit(0.0)), (MOST * F.col("source_size")).cast("double"))
    return s.select("source", "source_size", target.alias("target"))


def _digit(level: int) -> Column:
    return F.shiftright("h", 4 * PLACES * (LEVELS - level - 1)).bitwiseAND((1 << 4 * PLACES) - 1)


def cuts(sizes: DataFrame, plan: DataFrame) -> DataFrame:
    """Adds to each source the hash from which on no further copy is taken.

    base copies of every document are taken, and one more of those whose hash is
    below cut. Documents of one hash go together. A hash is taken if at
    least half of its tokens fit, so a source misses its target by at most half
    the tokens of one hash.
    """
    whole = F.when((F.col("source_size") > 0) & (F.col("target") >= F.col("source_size")), 1).otherwise(0)
    state = plan.select("*", whole.alias("base"), (F.col("target") - whole * F.col("source_size")).alias("rest"), F.lit(0).cast("long").alias("prefix"))
    for level in range(LEVELS):
        last = level == LEVELS - 1
        here = sizes
        if level:
            at = F.shiftright("h", 4 * PLACES * (LEVELS - level))
            cut = small(state.select(F.col("source").alias("s"), "prefix"))
            here = sizes.join(cut, sizes["source"].eqNullSafe(F.col("s")) & (at == F.col("prefix")), "left_semi")
        hist = here.groupBy("source", _digit(level).alias("digit")).agg(F.sum("size").alias("tokens"))
        ordered = Window.partitionBy("source").orderBy("digit")
        hist = hist.select("source", "digit", "tokens", (F.sum("tokens").over(ordered) - F.col("tokens")).alias("before"))
        s = state.select(F.col("source").alias("s"), "rest")
        joined = hist.join(small(s), hist["source"].eqNullSafe(F.col("s")))
        fits = F.col("before") + (F.col("tokens") / 2 if last else F.col("tokens")) <= F.col("rest")
        # the first digit that does not fit whole; beyond all of them if each fits
        found = joined.groupBy("s").agg(F.min(F.when(~fits, F.struct("digit", "before"))).alias("f"))
        state = (
            state.join(found, state["source"].eqNullSafe(found["s"]), "left")
            .select(
                "source", "source_size", "target", "base",
                (F.col("rest") - F.coalesce("f.before", F.lit(0))).alias("rest"),
                (F.col("prefix") * (1 << 4 * PLACES) + F.coalesce("f.digit", F.lit((1 << 4 * PLACES) - (0 if last else 1)))).alias("prefix"),
            )
        )
        state = written(state, f"cut{level}")
    return state.withColumnRenamed("prefix", "cut")


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken of every row.

    taken is 0, 1 or 2 times size. Null source: a source of its own, the last.
    Null or empty text: size 0, taken 0. A text of any length is counted whole. Rows of one doc_id go together; no rows
    give no rows. Other columns of docs play no part. Reruns agree, as the hash
    is of doc_id alone.
    """
    sizes = written(sized(docs), "sizes")
    plan = written(targets(sizes), "targets")
    state = cuts(sizes, plan).select(F.col("source").alias("s"), "source_size", "target", "base", "cut")
    joined = sizes.join(small(state), sizes["source"].eqNullSafe(F.col("s")))
    copies = F.col("base") + F.when(F.col("h") < F.col("cut"), 1).otherwise(0)
    return joined.select("doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents that the mix takes, with mix_copies, the times that each is taken, in place of any such column.

    Nulls, repeated rows and empty tables as in mix; all other columns stay.
    """
    sizes = written(sized(docs), "sizes")
    state = cuts(sizes, written(targets(sizes), "targets"))
    s, base, cut = (unused(docs, x) for x in ("mix_source", "mix_base", "mix_cut"))
    state = state.select(F.col("source").alias(s), F.col("base").alias(base), F.col("cut").alias(cut))
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.coalesce("text", F.lit("")))))
    h = F.conv(F.substring(digest, 1, LEVELS * PLACES), 16, 10).cast("long")
    copies = F.col(base) + F.when(h < F.col(cut), 1).otherwise(0)
    joined = docs.join(small(state), F.col("source").eqNullSafe(F.col(s))).where(copies > 0)
    return joined.select(*[f"`{c}`" for c in docs.columns if c.lower() != "mix_copies"], copies.cast("int").alias("mix_copies"))


def op5_mix(spark, sf_dir):
    return mix(documents(spark, sf_dir, "doc_id", "text", "source"))


SQL = r"""
with sizes as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
         ('0x' || substr(md5(coalesce(doc_id::varchar, 'text:' || coalesce(text, ''))), 1, 12))::bigint as h
  from documents),
per as (select source, sum(size)::bigint as source_size from sizes group by source),
weighted as (select *, ([3, 1, 2])[1 + ((row_number() over (order by source asc nulls last) - 1) % 3)::int]::bigint as w from per),
running as (
  select *, 3 * sum(source_size) over () as budget2,
         coalesce(sum(source_size) over (order by source_size::double / w::double, source asc nulls last rows between unbounded preceding and 1 preceding), 0) as stopped,
         sum(w) over () - coalesce(sum(w) over (order by source_size::double / w::double, source asc nulls last rows between unbounded preceding and 1 preceding), 0) as left_w
  from weighted),
levels as (select *, (budget2 - 4 * stopped)::double / (2 * left_w)::double as level from running),
final as (select level as final_level from levels where level * w <= 2 * source_size order by stopped, level limit 1),
plan as (
  select source, source_size, least(w * coalesce((select final_level from final), 0.0), (2 * source_size)::double) as target from levels),
state as (
  select *, case when source_size > 0 and target >= source_size then 1 else 0 end as base from plan),
by_hash as (select source, h, sum(size) as tokens from sizes group by source, h),
run as (select *, sum(tokens) over (partition by source order by h) - tokens as before from by_hash),
cut as (
  select r.source, r.h, r.before + r.tokens / 2.0 <= s.target - s.base * s.source_size as fits
  from run r join state s on r.source is not distinct from s.source)
select d.doc_id, d.size, s.source_size::bigint as source_size, s.target, (d.size * (s.base + case when c.fits then 1 else 0 end))::bigint as taken
from sizes d join state s on d.source is not distinct from s.source
join cut c on d.source is not distinct from c.source and d.h = c.h
"""
