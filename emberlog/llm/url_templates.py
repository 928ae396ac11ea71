"""Verdicts on urls: by rules for hosts and paths, and for the rest by a tree of path templates.

Each host has a tree, built level by level. At a node a segment stands by its own name if it has at least SHARE of the
node's urls and LEAST of them; all others are variable and become one wildcard. Branches of a node are merged as long as two of them do not differ
significantly, neither in what kinds of segment follow nor in how many of their urls are labelled blocked, labelled allowed or not labelled (chi-square
tests of homogeneity). So a node has at most 1 / SHARE + 1 branches, whatever the number of its urls. A template is a
path of branches; of its n labelled urls, b blocked, it is rejected if (b + 1) / (n + 2) reaches PURITY.

Labels are the verdicts of the rules, and further ones where given. Counting is Spark's: one aggregation a level with partial
sums, so a host with most of all urls costs no task more than others; the branches of a node, few, are merged in a Python function. Urls meet the table of branches by a
join on host, node and segment, by broadcast where it is counted small.
"""

from __future__ import annotations

from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small, unused, written

#: verdict, and host with path
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
DEPTH = 8  # segments that a template names; all further ones are one wildcard
SHARE = 0.05
LEAST = 2
PURITY = 0.85  # five labelled urls, all blocked, reach it
NAME = 200  # characters of a segment that stands as it is; a longer one goes by its hash
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: kinds of segment, the first that fits; the last kind is the end of the path
KINDS = (("number", r"^[0-9]+$"), ("date", r"^[0-9]{4}-[0-9]{1,2}(-[0-9]{1,2})?$"), ("code", r"^(?=.*[0-9])[0-9a-fA-F-]{8,}$"), ("word", r"^\p{L}+$"), ("file", r"\.[A-Za-z0-9]{1,5}$"), ("slug", r"^[\p{L}0-9]+([-_][\p{L}0-9]+)+$"), ("other", ""))
# 95 % points of the chi-square distribution for 1, 2, ... degrees of freedom
CHI_SQUARE = (3.841, 5.991, 7.815, 9.488, 11.070, 12.592, 14.067, 15.507)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host after the first ://, with A-Z in lower case, and the path up to ? or #; both empty for null or without ://."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does. Of equally long ones a block comes first, then by code point."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, rule in sorted(rules, key=lambda r: (-len(r[1]), r[0] != "block", r[1]), reverse=True):
        own, slash, rest = rule.partition("/")
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(slash + rest)
        name, verdict = F.when(fits, rule).otherwise(name), F.when(fits, said).otherwise(verdict)
    return name, verdict


def segments(path: Column) -> Column:
    """The segments that are not empty; of those beyond DEPTH only one."""
    own = F.slice(F.filter(F.split(path, "/"), lambda s: s != ""), 1, DEPTH + 1)
    return F.transform(own, lambda s: F.when(F.length(s) > NAME, F.concat(F.lit("#"), F.sha2(s, 256))).otherwise(s))


def kind(segment: Column) -> Column:
    """Number of a segment's kind; that of the end for null."""
    out = F.lit(len(KINDS))
    for i, (_, pattern) in reversed(list(enumerate(KINDS))):
        out = F.when(segment.rlike(pattern), i).otherwise(out)
    return out


def differ(a, b) -> bool:
    """Whether two rows of counts differ significantly."""
    pairs = [(x, y) for x, y in zip(a, b, strict=True) if x + y]
    left, right = sum(x for x, _ in pairs), sum(y for _, y in pairs)
    if len(pairs) < 2 or not left or not right:
        return False
    each = ((x + y, x, y) for x, y in pairs)
    score = sum((x - left * s / (left + right)) ** 2 * (left + right) / (left * s) + (y - right * s / (left + right)) ** 2 * (left + right) / (right * s) for s, x, y in each)
    return score > CHI_SQUARE[len(pairs) - 2]


def distance(a, b) -> float:
    """Between shares of counts, 0 to 2."""
    return sum(abs(x / max(1, sum(a)) - y / max(1, sum(b))) for x, y in zip(a, b, strict=True))


def merged(branches: list[tuple[str, list[int], list[int]]]) -> dict[str, str]:
    """The name of the merged branch of each branch (name, counts of kinds, counts of labels); * stays *.

    The two that are most alike of those that do not differ become one, until all differ.
    """
    now = [((name,), list(kinds), list(labels)) for name, kinds, labels in sorted(branches)]
    while pairs := [(distance(a[1], b[1]) + distance(a[2], b[2]), i, j) for (i, a), (j, b) in combinations(enumerate(now), 2) if not differ(a[1], b[1]) and not differ(a[2], b[2])]:
        _, i, j = min(pairs)
        a, b = now[i], now.pop(j)
        now[i] = tuple(sorted(a[0] + b[0])), [x + y for x, y in zip(a[1], b[1], strict=True)], [x + y for x, y in zip(a[2], b[2], strict=True)]
    out = {}
    for names, _, _ in now:
        own = "*" if "*" in names else names[0] if len(names) == 1 else "{" + "|".join(names) + "}"
        out |= dict.fromkeys(names, own)
    return out


def _branches(rows: DataFrame, level: int) -> DataFrame:
    """host, node, segment, branch: of the named segments of each node at a level; all others are the wildcard."""
    segment, after = F.get("segments", F.lit(level)), F.get("segments", F.lit(level + 1))
    own = rows.select("host", "node", "label", segment.alias("segment"), kind(after).alias("kind")).where("segment is not null")
    counts = [F.count_if(F.col("kind") == i).alias(f"k{i}") for i in range(len(KINDS) + 1)] + [F.count_if("label").alias("l0"), F.count_if(~F.col("label")).alias("l1"), F.count_if(F.col("label").isNull()).alias("l2")]
    names = [f"k{i}" for i in range(len(KINDS) + 1)] + ["l0", "l1", "l2"]
    each = own.groupBy("host", "node", "segment").agg(F.count("*").alias("n"), *counts)
    whole = each.groupBy("host", "node").agg(F.sum("n").alias("all_n"), *[F.sum(c).alias(f"all_{c}") for c in names])
    named = each.where((F.col("n") >= LEAST) & ~F.col("segment").rlike(r"[*{}|]")).join(whole, ["host", "node"]).where(F.col("n") >= SHARE * F.col("all_n"))

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        split = lambda row: ([int(row[c]) for c in names[:-3]], [int(row[c]) for c in names[-3:]])
        branches = [(r["segment"], *split(r)) for r in group.to_dict("records")]
        total, kinds, labels = group.iloc[0], *split(group[names].sum())
        rest = [int(total[f"all_{c}"]) - x for c, x in zip(names, kinds + labels, strict=True)]
        if any(rest):
            branches.append(("*", rest[:-3], rest[-3:]))
        out = merged(branches)
        return pd.DataFrame({"host": total["host"], "node": total["node"], "segment": group["segment"], "branch": [out[s] for s in group["segment"]]})

    return named.groupBy("host", "node").applyInPandas(merge, "host string, node string, segment string, branch string")


def templates(rows: DataFrame) -> DataFrame:
    """The rows (host, path, label: true for blocked, false for allowed, null) with template, and purity: of its labelled urls, the smoothed share that is blocked."""
    out = rows.withColumn("segments", segments(F.col("path"))).withColumn("node", F.lit(""))
    deepest = out.agg(F.max(F.size("segments"))).first()[0] or 0
    for level in range(min(DEPTH, deepest)):
        branches = written(_branches(out, level), "url-branches")
        own = out.withColumn("segment", F.get("segments", F.lit(level)))
        named = own.join(small(branches), ["host", "node", "segment"], "left")
        node = F.when(F.col("segment").isNull(), F.col("node")).otherwise(F.concat("node", F.lit("/"), F.coalesce("branch", F.lit("*"))))
        out = named.withColumn("node", node).drop("segment", "branch")
    out = out.withColumn("template", F.when(F.size("segments") > DEPTH, F.concat("node", F.lit("/**"))).otherwise(F.col("node"))).drop("segments", "node")
    b, n = F.count_if("label"), F.count("label")
    purity = written(out.groupBy("host", "template").agg(((b + 1) / (n + 2)).alias("purity")), "url-templates")
    return out.join(small(purity), ["host", "template"])


def judged(pages: DataFrame, rules=RULES, labels: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity of each page: the longest fitting rule's verdict, else block where the template's purity reaches PURITY, else allow.

    labels (page_id, blocked) add to what the rules say; of several for one page a block counts, and a rule comes first. Null urls, and those without ://,
    have an empty host and path, meet no rule, and are allowed unless labelled ones like them are not. Repeated rows and ids are judged each; other
    columns play no part; no rows give no rows. Very long urls are read whole: segments beyond DEPTH are one wildcard, and a
    long segment goes by its hash. A template without labels has a purity of one half. Paths differ by case, hosts do not.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", "url").select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), verdict.alias("said"))
    label = F.col("said") == "block"
    if labels is not None:
        key = unused(rows, "labelled")
        known = labels.where("page_id is not null and blocked is not null").groupBy(F.col("page_id").alias(key)).agg(F.max(F.col("blocked").cast("boolean")).alias("blocked"))
        rows = rows.join(known, F.col("page_id") == F.col(key), "left").drop(key)
        label = F.coalesce(label, "blocked")
        rows = rows.withColumn("label", label).drop("blocked")
    else:
        rows = rows.withColumn("label", label)
    own = F.when(F.col("purity") >= PURITY, "block").otherwise("allow")
    return templates(rows).select("page_id", "host", "path", "rule", F.coalesce("said", own).alias("verdict"), "template", "purity")


def op13_url_filter(spark, sf_dir):
    return judged(spark.read.parquet(f"{sf_dir}/pages.parquet"))
