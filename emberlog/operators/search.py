"""Queries over findings: filters, hunts, timelines, pages, summaries, triage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import core
from . import shared

EQUAL = ("source_ip", "dest_ip", "username", "hostname", "process_name", "rule_id", "category", "session_id", "severity")
TEXT = ("raw_line", "rule_name", "rule_id")


def at_least(severity: str):
    return core.severity_rank("severity") >= core.SEVERITIES.index(severity)


def contains(q: str, columns=TEXT):
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.lower(c).contains(q.lower()), F.lit(False))
    return out


def hunt(found: DataFrame, *, text=None, min_severity=None, min_risk=None, technique=None, since_us=None, until_us=None, min_confidence=None, **equal) -> DataFrame:
    """The findings that meet every condition given; every condition is a column, so scans prune by it."""
    out = found
    for k, v in equal.items():
        if k not in EQUAL:
            raise ValueError(f"no such field: {k}")
        out = out.where(F.col(k) == v)
    if min_risk is not None:
        out = out.where(F.col("risk_score") >= min_risk)
    if min_confidence is not None:
        out = out.where(F.col("confidence") >= min_confidence)
    if since_us is not None:
        out = out.where(F.col("us") >= since_us)
    if until_us is not None:
        out = out.where(F.col("us") <= until_us)
    if min_severity:
        out = out.where(at_least(min_severity))
    if technique:
        out = out.where(F.exists("mitre_ids", lambda t: t.contains(technique)))
    return out.where(contains(text)) if text else out


def by_risk(found: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    return found.orderBy(F.desc("risk_score"), F.desc("us"), "line_number", "rule_id").offset(offset).limit(limit)


def page(found: DataFrame, number: int, size: int) -> DataFrame:
    """One page in order of risk, with has_more: whether another follows. One row more than the page is fetched."""
    rows = by_risk(found, size + 1, number * size)
    w = Window.orderBy(F.desc("risk_score"), F.desc("us"), "line_number", "rule_id")
    every = Window.partitionBy()
    return rows.select("*", F.row_number().over(w).alias("_n"), (F.count("*").over(every) > size).alias("has_more")).where(F.col("_n") <= size).drop("_n")


def timeline(found: DataFrame, severities=None, limit: int = 100, offset: int = 0, newest: bool = False, from_us: int | None = None, to_us: int | None = None) -> DataFrame:
    """Findings with a time in its order, or the newest first; of some severities, of a range of times with both ends."""
    out = found.where("us is not null")
    out = out.where(F.col("severity").isin(*severities)) if severities else out
    out = out.where(F.col("us") >= from_us) if from_us is not None else out
    out = out.where(F.col("us") <= to_us) if to_us is not None else out
    order = [F.desc("us"), F.desc("line_number"), "rule_id"] if newest else ["us", "line_number", "rule_id"]
    return out.orderBy(*order).offset(offset).limit(limit)


def detection_summary(found: DataFrame, rules, top: int = 5) -> DataFrame:
    """dimension, value, n: all findings, by type of rule and category, and the rules with most; rules tell each rule's type."""
    types = found.sparkSession.createDataFrame([(r.id, r.type) for r in rules], "rule_id string, rule_type string")
    rows = found.join(F.broadcast(types), "rule_id", "left")  # one row a rule
    return dimensions(rows, [("total", None), ("rule_type", None), ("category", None), ("rule_id", top)]).select("dimension", "value", "n")


def dimensions(found: DataFrame, dims: list[tuple[str, int | None]]) -> DataFrame:
    """dimension, value, n, max_risk, avg_risk, first_us, last_us: each column's values, the most frequent ones where a number is given; total is all findings.

    One pass and one shuffle of partial sums, whatever the number of dimensions.
    """
    value = lambda c: F.lit("all") if c == "total" else F.col(c).cast("string")
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("dimension"), value(c).alias("value")) for c, _ in dims])).alias("d")
    rows = found.select("risk_score", "us", each).where("d.value is not null")
    n = rows.groupBy("d.dimension", "d.value").agg(F.count("*").alias("n"), F.max("risk_score").alias("max_risk"), F.round(core.exact_mean("risk_score", 2), 6).alias("avg_risk"), F.min("us").alias("first_us"), F.max("us").alias("last_us"))
    rank = F.row_number().over(Window.partitionBy("dimension").orderBy(F.desc("n"), "value"))
    most = core.lookup({c: k for c, k in dims if k}, "dimension")
    return n.withColumn("_r", rank).where(F.coalesce(F.col("_r") <= most, F.lit(True))).drop("_r")


def summary(found: DataFrame, top: int = 10) -> DataFrame:
    """dimension, value, n, max_risk, avg_risk: by severity, category, and the top addresses, hosts and rules."""
    return dimensions(found, [("severity", None), ("category", None), ("source_ip", top), ("hostname", top), ("rule_id", top)]).drop("first_us", "last_us")


def threat_levels(found: DataFrame) -> DataFrame:
    """session_id, counts by severity, and the level and the label that they make."""
    n = lambda s: F.count(F.when(F.col("severity") == s, 1)).alias(s.lower())
    out = found.groupBy("session_id").agg(*(n(s) for s in core.SEVERITIES[1:]), F.max("risk_score").alias("max_risk"))
    counts = ("critical", "high", "medium", "low")
    return out.withColumn("level", core.threat_level(*counts)).withColumn("label", core.threat_label(*counts))


def triage(found: DataFrame, actions: DataFrame) -> DataFrame:
    """Findings with their latest analyst action as state, new without any."""
    last = actions.groupBy("id").agg(F.max_by("action", F.struct("created_us", "action")).alias("state"))
    return found.join(last, "id", "left").withColumn("state", F.coalesce("state", F.lit("new")))


def rule_tests(found: DataFrame, expected: DataFrame, forbidden: DataFrame) -> DataFrame:
    """rule_id and what is wrong: missing where an expected rule did not fire, forbidden where one did."""
    fired = found.select("rule_id").distinct()
    missing = expected.join(fired, "rule_id", "left_anti").withColumn("problem", F.lit("missing"))
    return missing.unionByName(forbidden.join(fired, "rule_id", "left_semi").withColumn("problem", F.lit("forbidden")))


def corpus_tests(found: DataFrame, tests: DataFrame, least: DataFrame) -> DataFrame:
    """test, findings, missing, forbidden and ok of each test, whose findings have its name in a column test.

    tests: test, rule_id and kind, expected or forbidden; least: test and least, the number of findings it needs. A test is ok if all expected rules
    fired, no forbidden one did, and there are findings enough. Tests without findings are there too.
    """
    counts = shared.written(found.groupBy("test", "rule_id").agg(F.count("*").alias("n")), "counts")  # read twice
    fired = counts.select("test", "rule_id", F.lit(True).alias("fired"))
    judged = tests.join(fired, ["test", "rule_id"], "left")
    wrong = lambda kind, bad: F.array_join(F.array_sort(F.collect_set(F.when((F.col("kind") == kind) & bad, F.col("rule_id")))), ",").alias(kind)
    rules = judged.groupBy("test").agg(wrong("expected", F.col("fired").isNull()), wrong("forbidden", F.col("fired").isNotNull())).withColumnRenamed("expected", "missing")
    out = least.join(counts.groupBy("test").agg(F.sum("n").alias("findings")), "test", "left").join(rules, "test", "left")
    out = out.select("test", F.coalesce("findings", F.lit(0)).alias("findings"), F.coalesce("missing", F.lit("")).alias("missing"), F.coalesce("forbidden", F.lit("")).alias("forbidden"), "least")
    return out.withColumn("ok", (F.col("missing") == "") & (F.col("forbidden") == "") & (F.col("findings") >= F.col("least"))).drop("least")


def without_session(table: DataFrame, session: str) -> DataFrame:
    return table.where(~F.col("session_id").eqNullSafe(session))


def save(found: DataFrame, path: str) -> None:
    found.write.mode("append").partitionBy("session_id").parquet(path)


def bundle(tables: dict[str, DataFrame], path: str) -> None:
    """One JSON directory for each table, and a manifest with their counts."""
    rows = []
    for name, table in tables.items():
        table.write.mode("overwrite").json(f"{path}/{name}")
        rows.append((name, table.sparkSession.read.json(f"{path}/{name}").count() if table.columns else 0))
    next(iter(tables.values())).sparkSession.createDataFrame(rows, "name string, n long").coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
