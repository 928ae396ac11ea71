"""Correlation of findings: kill chains, entity risk, behaviour, graphs, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import core
from . import matching, shared

# Categories of each chain and what it adds to confidence
CHAINS = [
    ("Full Web Compromise", ["recon", "web_attack", "persistence"], 0.15),
    ("Network Intrusion Chain", ["recon", "auth", "lateral_movement"], 0.15),
    ("Credential to Implant to Exfil", ["auth", "malware", "exfiltration"], 0.20),
    ("Webshell to Lateral Pivot", ["web_attack", "persistence", "lateral_movement"], 0.18),
    ("AI-Era Attack Chain", ["ai_attack", "exfiltration"], 0.20),
    ("Full Compromise to Ransomware", ["auth", "privilege_escalation", "impact"], 0.25),
    ("Supply Chain to Persistence", ["supply_chain", "persistence"], 0.18),
    ("Discovery to Exfiltration", ["discovery", "exfiltration"], 0.15),
    ("Living Off The Land Escalation", ["lolbin", "privilege_escalation", "lateral_movement"], 0.20),
    ("Insider Data Theft", ["insider_threat", "exfiltration"], 0.18),
    ("Red Team Full Chain", ["recon", "web_attack", "privilege_escalation", "exfiltration"], 0.25),
]
# What a tactic multiplies an entity's risk by
TACTIC_BONUS = {
    "Initial Access": 1.2, "Execution": 1.1, "Persistence": 1.5, "Privilege Escalation": 1.6, "Defense Evasion": 1.4, "Credential Access": 1.7,
    "Lateral Movement": 1.8, "Collection": 1.2, "Command and Control": 1.6, "Exfiltration": 2.0, "Impact": 2.0,
}
CHAIN_CATEGORIES, CHAIN_BONUS = ("lateral_movement", "persistence", "exfiltration", "privilege_escalation"), 1.15
SCALE = 2.4


def kill_chains(found: DataFrame) -> DataFrame:
    """chain_name, source_ip, categories, finding_count, max_risk_score, confidence_boost: sources whose findings cover a chain's categories."""
    chains = found.sparkSession.createDataFrame(CHAINS, "chain_name string, steps array<string>, confidence_boost double")
    steps = F.broadcast(chains.select("*", F.explode("steps").alias("category")))
    per = found.where(F.col("source_ip").isNotNull()).groupBy("source_ip", "category").agg(F.count("*").alias("n"), F.max("risk_score").alias("risk"))
    met = per.join(steps, "category").groupBy("chain_name", "source_ip", "confidence_boost", F.size("steps").alias("wanted"))
    met = met.agg(F.sort_array(F.collect_set("category")).alias("categories"), F.sum("n").alias("finding_count"), F.max("risk").alias("max_risk_score"))
    return met.where(F.size("categories") == F.col("wanted")).drop("wanted")


def entities(found: DataFrame) -> DataFrame:
    """A row for each finding and entity that it names: kind, value."""
    pairs = [("ip", "source_ip"), ("ip", "dest_ip"), ("user", "username"), ("host", "hostname"), ("process", "process_name")]
    one = F.array_compact(F.array(*[F.when(F.coalesce(F.col(c), F.lit("")) != "", F.struct(F.lit(k).alias("kind"), F.col(c).alias("value"))) for k, c in pairs]))
    return found.select("*", F.explode(one).alias("_e")).select("*", "_e.*").drop("_e")


def entity_risk(found: DataFrame) -> DataFrame:
    """kind, value, risk_score, risk_band, finding_count, latest_us of every entity."""
    bonus = F.array_max(F.transform("tactic_names", lambda t: core.lookup(TACTIC_BONUS, t, 1.0)))
    chain = F.when(F.col("category").isin(*CHAIN_CATEGORIES), CHAIN_BONUS).otherwise(1.0)
    part = F.greatest("risk_score", core.lookup(core.WEIGHTS, "severity", 2.0)) * F.coalesce(F.nullif("confidence", F.lit(0.0)), F.lit(0.75)) * F.coalesce(bonus, F.lit(1.0)) * chain
    score = F.least(F.lit(100.0), F.round(F.sum("part") * SCALE, 2))
    out = entities(found.withColumn("part", part)).groupBy("kind", "value").agg(score.alias("risk_score"), F.count("*").alias("finding_count"), F.max("us").alias("latest_us"))
    return out.withColumn("risk_band", core.risk_band("risk_score"))


def entity_top(found: DataFrame, column: str, k: int = 5) -> DataFrame:
    """kind, value, item, n, rank: each entity's most frequent values of a column; ties by value."""
    n = entities(found).where(F.col(column).isNotNull()).groupBy("kind", "value", F.col(column).alias("item")).agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("kind", "value").orderBy(F.desc("n"), "item"))
    return n.select("*", rank.alias("rank")).where(F.col("rank") <= k)


FEATURES = ["finding_count", "auth_failure_rate", "distinct_dests", "off_hours_share", "high_share", "mean_severity"]


def behaviour(found: DataFrame) -> DataFrame:
    """session_id, entity (the first of address, user, host) and its features; a finding whose category holds auth counts as a failure."""
    share = lambda cond: F.avg(F.when(F.coalesce(cond, F.lit(False)), 1.0).otherwise(0.0))
    rows = found.withColumn("entity", F.coalesce("source_ip", "username", "hostname")).where("entity is not null")
    return rows.groupBy("session_id", "entity").agg(
        F.count("*").cast("double").alias("finding_count"), share((F.col("auth_result") == "failure") | F.lower("category").contains("auth")).alias("auth_failure_rate"),
        F.countDistinct("dest_ip").cast("double").alias("distinct_dests"), share((F.col("hour_of_day") < 8) | (F.col("hour_of_day") >= 18)).alias("off_hours_share"),
        share(F.col("severity").isin("HIGH", "CRITICAL")).alias("high_share"), F.avg(core.severity_rank("severity")).alias("mean_severity"),
    )


def _long(features: DataFrame) -> DataFrame:
    pairs = ", ".join(f"'{f}', {f}" for f in FEATURES)
    return features.select("session_id", "entity", F.expr(f"stack({len(FEATURES)}, {pairs})").alias("feature", "x"))


def baseline(features: DataFrame) -> DataFrame:
    """entity, feature, mean, std, sessions: over past sessions; one session has deviation 1, and none is below 0.01."""
    std = F.greatest(F.coalesce(F.stddev_samp("x"), F.lit(1.0)), F.lit(0.01))
    return _long(features).groupBy("entity", "feature").agg(F.avg("x").alias("mean"), std.alias("std"), F.count("*").alias("sessions"))


def anomaly(features: DataFrame, session: str, threshold: float = 6.0) -> DataFrame:
    """entity, score, label, anomalous, has_baseline and flags of one session against all others: twice the mean absolute z, at most 10.

    An entity without a past scores points for high features: 3 each for failures and grave findings, 2 each for hours,
    destinations and mean severity.
    """
    now, past = features.where(F.col("session_id") == session), baseline(features.where(F.col("session_id") != session))
    z = _long(now).join(past, ["entity", "feature"], "left").groupBy("entity").agg(F.avg(F.abs((F.col("x") - F.col("mean")) / F.col("std"))).alias("z"))
    pts = lambda c, least, n: F.when(F.col(c) > least, n).otherwise(0)
    points = pts("auth_failure_rate", 0.5, 3) + pts("high_share", 0.3, 3) + pts("off_hours_share", 0.5, 2) + pts("distinct_dests", 10, 2) + pts("mean_severity", 2.5, 2)
    score = F.round(F.least(F.coalesce(F.col("z") * 2, points.cast("double")), F.lit(10.0)), 1)
    flag = lambda c, least, name: F.when(F.col(c) > least, name)
    flags = F.array_compact(F.array(flag("auth_failure_rate", 0.4, "failures"), flag("high_share", 0.25, "grave"), flag("off_hours_share", 0.4, "off hours"), flag("distinct_dests", 8, "many destinations")))
    out = now.join(z, "entity").select("entity", score.alias("score"), F.col("z").isNotNull().alias("has_baseline"), flags.alias("flags"))
    return out.select("entity", "score", core.anomaly_label("score").alias("label"), (F.col("score") >= threshold).alias("anomalous"), "has_baseline", "flags")


def ends(found: DataFrame) -> tuple[Column, Column]:
    """Source and target of a finding in graphs: the address or external; the first of host, address, process, file and category that there is."""
    some = lambda c: F.nullif(F.col(c), F.lit(""))
    name = F.element_at(F.split(some("source_file"), r"[/\\\\]"), -1)
    target = F.coalesce(some("hostname"), some("dest_ip"), F.concat(F.lit("process:"), some("process_name")), F.concat(F.lit("log:"), name), F.concat(F.lit("target:"), some("category")), F.lit("observed-target"))
    return F.coalesce(some("source_ip"), F.lit("external")), target


def graph_edges(found: DataFrame) -> DataFrame:
    """source, target, weight, max_risk, max_severity, techniques of the attack graph; see ends."""
    source, target = ends(found)
    rows = found.select("*", source.alias("_source"), target.alias("target"), core.severity_rank("severity").alias("rank"))
    top = F.element_at(F.array(*map(F.lit, core.SEVERITIES)), F.max("rank") + 1)
    return rows.groupBy(F.col("_source").alias("source"), "target").agg(
        F.count("*").alias("weight"), F.max("risk_score").alias("max_risk"), top.alias("max_severity"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("mitre_ids")))).alias("techniques"),
    )


def graph_nodes(edges: DataFrame) -> DataFrame:
    """node, weight, max_risk, is_source, is_target; a pivot is both."""
    a = edges.select(F.col("source").alias("node"), "weight", "max_risk", F.lit(1).alias("s"), F.lit(0).alias("t"))
    b = edges.select(F.col("target").alias("node"), "weight", "max_risk", F.lit(0).alias("s"), F.lit(1).alias("t"))
    out = a.union(b).groupBy("node").agg(F.sum("weight").alias("weight"), F.max("max_risk").alias("max_risk"), (F.max("s") == 1).alias("is_source"), (F.max("t") == 1).alias("is_target"))
    return out.withColumn("is_pivot", F.col("is_source") & F.col("is_target"))


def layered_edges(found: DataFrame) -> DataFrame:
    """layer, source, target, weight, max_risk: source to category to rule to technique."""
    rows = found.where("source_ip is not null")
    layers = F.array(
        F.struct(F.lit("source-category").alias("layer"), F.col("source_ip").alias("source"), F.col("category").alias("target")),
        F.struct(F.lit("category-rule").alias("layer"), F.col("category").alias("source"), F.col("rule_id").alias("target")),
    )
    ends = F.transform("mitre_ids", lambda t: F.struct(F.lit("rule-technique").alias("layer"), F.col("rule_id").alias("source"), t.alias("target")))
    out = rows.select("risk_score", F.explode(F.concat(layers, ends)).alias("e")).select("e.*", "risk_score")
    return out.groupBy("layer", "source", "target").agg(F.count("*").alias("weight"), F.max("risk_score").alias("max_risk"))


def reduced(nodes: DataFrame, edges: DataFrame, top: int) -> tuple[DataFrame, DataFrame]:
    """The top nodes by risk and weight, and the edges between them: none dangles."""
    kept = nodes.orderBy(F.desc("max_risk"), F.desc("weight"), "node").limit(top)
    names = kept.select("node")
    return kept, edges.join(names.withColumnRenamed("node", "source"), "source", "left_semi").join(names.withColumnRenamed("node", "target"), "target", "left_semi")


def tactic_coverage(found: DataFrame) -> DataFrame:
    return found.select(F.explode("tactic_ids").alias("tactic_id")).groupBy("tactic_id").agg(F.count("*").alias("n"))


def technique_counts(found: DataFrame, top: int = 20) -> DataFrame:
    n = found.select(F.explode("mitre_ids").alias("technique"), "risk_score").groupBy("technique").agg(F.count("*").alias("n"), F.max("risk_score").alias("max_risk"))
    return n.orderBy(F.desc("n"), "technique").limit(top)


def technique_coverage(found: DataFrame, rules: DataFrame) -> DataFrame:
    """technique, rules, fired, state: covered, or silent where no finding has it."""
    a = rules.select(F.explode("mitre_ids").alias("technique")).groupBy("technique").agg(F.count("*").alias("rules"))
    b = found.select(F.explode("mitre_ids").alias("technique")).groupBy("technique").agg(F.count("*").alias("fired"))
    out = a.join(b, "technique", "full_outer").select("technique", F.coalesce("rules", F.lit(0)).alias("rules"), F.coalesce("fired", F.lit(0)).alias("fired"))
    return out.withColumn("state", F.when(F.col("fired") > 0, "covered").otherwise("silent"))


def source_chains(found: DataFrame, width: int = 8, top: int = 20) -> DataFrame:
    """source_ip, finding_count, max_risk and its categories, rules and techniques in order of risk, at most width of each; the top sources by risk and number."""
    one = lambda k, v: F.struct(F.lit(k).alias("k"), v.alias("v"))
    names = F.concat(F.array(one("c", F.col("category")), one("r", F.col("rule_id"))), F.transform("mitre_ids", lambda t: one("t", t)))
    rows = found.where("source_ip is not null")
    per = rows.select("source_ip", "risk_score", F.explode(names).alias("n")).groupBy("source_ip", "n.k", "n.v").agg(F.max("risk_score").alias("risk"))
    ranked = per.withColumn("r", F.row_number().over(Window.partitionBy("source_ip", "k").orderBy(F.desc("risk"), "v"))).where(F.col("r") <= width)
    of = lambda k: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("k") == k, F.struct("r", "v")))), lambda x: x["v"]), ",")
    lists = ranked.groupBy("source_ip").agg(of("c").alias("categories"), of("r").alias("rules"), of("t").alias("techniques"))
    out = rows.groupBy("source_ip").agg(F.count("*").alias("finding_count"), F.max("risk_score").alias("max_risk")).join(lists, "source_ip")
    return out.orderBy(F.desc("max_risk"), F.desc("finding_count"), "source_ip").limit(top)


def entity_totals(risks: DataFrame, high: float = 70.0) -> DataFrame:
    """One row about entity_risk: entities, those of high risk, the highest score, and how many there are of each band."""
    band = lambda b: F.count_if(F.col("risk_band") == b).alias(b.lower())
    return risks.agg(F.count("*").alias("entities"), F.count_if(F.col("risk_score") >= high).alias("high_risk"), F.max("risk_score").alias("max_score"), *[band(b).alias(f"band_{b.lower()}") for b in ("CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO")])


def derived_chains(found: DataFrame, top: int = 20) -> DataFrame:
    """chain_name, source, categories, rules, techniques, finding_count, max_risk_score: what each source did, in order of time.

    The first 8 categories, 12 rules and 12 techniques (of each finding at most 4) by when they were first seen; the top
    sources by risk, number and name. What is kept for a source is one row for each distinct name. Where no source makes a chain, the ten findings of the
    highest risk make one, named after the case. Findings are gone through once, and again only in that case: first for each source and name, then for
    each source.
    """
    source = F.coalesce(F.nullif("source_ip", F.lit("")), F.nullif("hostname", F.lit("")), F.lit("unknown-source"))
    rows = found.select(source.alias("source"), F.coalesce("category", F.lit("uncategorized")).alias("category"), F.coalesce("rule_id", F.lit("rule")).alias("rule"), "mitre_ids", "risk_score", F.struct("us", "line_number", "rule_id").alias("at"))
    # each finding stands once among the rules, so those count it
    name = lambda k, v, i: F.struct(F.lit(k).alias("k"), v.alias("v"), i.alias("i"))
    names = F.concat(F.array(name("c", F.col("category"), F.lit(0)), name("r", F.col("rule"), F.lit(0))), F.transform(F.slice(F.coalesce("mitre_ids", F.array().cast("array<string>")), 1, 4), lambda t, i: name("t", t, i)))
    seen = rows.select("source", "at", "risk_score", F.explode(names).alias("n")).groupBy("source", "n.k", "n.v").agg(F.min(F.struct("at", "n.i")).alias("first"), F.count("*").alias("n"), F.max("risk_score").alias("risk"))
    of = lambda k, most: F.slice(F.transform(F.array_sort(F.collect_list(F.when(F.col("k") == k, F.struct("first", "v")))), lambda x: x["v"]), 1, most)
    out = seen.groupBy("source").agg(F.sum(F.when(F.col("k") == "r", F.col("n"))).alias("finding_count"), F.round(F.max("risk"), 2).alias("max_risk_score"), of("c", 8).alias("categories"), of("r", 12).alias("rules"), of("t", 12).alias("techniques"))
    words = F.array_join(F.transform(F.slice("categories", 1, 5), lambda c: F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))), " -> ")
    out = out.where((F.size("categories") > 1) | (F.size("techniques") > 0) | (F.col("max_risk_score") > 0)).withColumn("chain_name", F.concat("source", F.lit(": "), words))
    out = shared.written(out, "chains")
    if out.isEmpty():
        out = _highest_risk(found).select(*out.columns)
    return out.orderBy(F.desc("max_risk_score"), F.desc("finding_count"), "chain_name").limit(top)


def _highest_risk(found: DataFrame, most: int = 10) -> DataFrame:
    """One chain of the findings of the highest risk; none of no findings."""
    order = [F.desc_nulls_last("risk_score"), F.asc("us"), F.asc("line_number"), F.asc("rule_id")]
    rows = found.orderBy(*order).limit(most).withColumn("i", F.row_number().over(Window.orderBy(*order)))
    names = rows.select("i", F.coalesce("risk_score", F.lit(0.0)).alias("risk_score"), F.array(F.coalesce("category", F.lit("uncategorized"))).alias("c"), F.array(F.coalesce("rule_id", F.lit("rule"))).alias("r"), F.slice(F.coalesce("mitre_ids", F.array().cast("array<string>")), 1, 4).alias("t"))
    of = lambda k, n: F.slice(F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("i", k))), lambda x: x[k]))), 1, n)
    out = names.agg(F.count("*").alias("finding_count"), F.round(F.max("risk_score"), 2).alias("max_risk_score"), of("c", 8).alias("categories"), of("r", 12).alias("rules"), of("t", 12).alias("techniques"))
    return out.where("finding_count > 0").withColumns({"source": F.lit("case"), "chain_name": F.lit("Highest-risk detection path")})


def impossible_travel(events: DataFrame, seconds: int = 3600) -> DataFrame:
    """The strict form of INSD-008: logins of a user that follow one from another address within the window, with that one's line, address and time.

    The rule itself asks for two logins only. See matching.last_other for how; the rows have all columns of the event, rule_id, and other_ columns.
    """
    logins = events.where("auth_result = 'success' and username <> '' and source_ip <> ''")
    found = matching.last_other(logins, "username", "source_ip", ["line_number"], ["line_number", "source_file"], seconds)
    return found.withColumn("rule_id", F.lit("INSD-008"))


def logins_after_failures(events: DataFrame, seconds: int = 3600) -> DataFrame:
    """username, pairs, least_us: pairs of a failed and a later successful login of a user within the window, and the shortest time between."""
    pick = lambda result, name: events.where(F.col("auth_result") == result).where("username <> ''").select("username", F.col("us").alias(name))
    pairs = matching.interval_join(pick("failure", "us"), pick("success", "right_us"), ["username"], seconds)
    return pairs.groupBy("username").agg(F.count("*").alias("pairs"), F.min(F.col("right_us") - F.col("us")).alias("least_us"))
