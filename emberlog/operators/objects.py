"""Findings and indicators as an exchange of objects and of relations between them, in tables of one shape.

Ids are hashes of what names an object, so runs agree and relations need no look-up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import core
from . import ioc
from .cases import OWNER, object_id
from .layers import title

# Categories whose rules name malware
MALWARE = ("malware", "lolbin", "impact")
HIGH = core.SEVERITIES.index("HIGH")
RELATED = 5  # indicators of an observation
COLUMNS = ("id", "type", "name", "labels", "detail", "confidence", "n", "first_us", "last_us")


def _points(name: str = "confidence") -> Column:
    """Confidence in ten-thousandths, which add up the same in any order."""
    return F.round(F.col(name) * 10_000).cast("long")


def _some(column, most: int) -> Column:
    """The first of the distinct values in order."""
    return F.array_join(F.slice(F.array_sort(F.collect_set(column)), 1, most), ",")


def _shaped(df: DataFrame, kind: str, key: Column, name: Column, **more) -> DataFrame:
    kinds = {"labels": "string", "detail": "string", "confidence": "int", "n": "long", "first_us": "long", "last_us": "long"}
    rest = [(more[c] if c in more else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()]
    return df.select(object_id(kind, key).alias("id"), F.lit(kind).alias("type"), name.alias("name"), *rest)


def key_of(indicators: DataFrame) -> Column:
    return F.concat_ws(":", "type", F.lower("value"))


def observed_key() -> Column:
    return F.coalesce(F.nullif("source_ip", F.lit("")), F.nullif("hostname", F.lit("")), F.lit("unknown"))


def actors(found: DataFrame) -> DataFrame:
    """Sources of findings of HIGH and above: source_ip, n, techniques, categories, risk, confidence (percent), times; of these findings only."""
    rows = found.where(core.severity_rank("severity") >= HIGH).where("source_ip <> ''")
    each = rows.groupBy("source_ip").agg(F.count("*").alias("n"), F.max("risk_score").alias("risk"), (F.floor(F.sum(_points()) / F.count("*") / 100)).alias("confidence"), F.min("us").alias("first_us"), F.max("us").alias("last_us"), _some("category", 5).alias("goals"))
    named = rows.select("source_ip", F.explode("mitre_ids").alias("t")).groupBy("source_ip").agg(_some("t", 8).alias("techniques"))
    return each.join(named, "source_ip", "left")


def malware(found: DataFrame) -> DataFrame:
    """The first finding of each rule in a category of malware, with kind."""
    first = found.where(F.col("category").isin(*MALWARE)).groupBy("rule_id").agg(F.min_by(F.struct("rule_name", "category", "confidence", "raw_line"), F.struct("us", "line_number")).alias("x")).select("rule_id", "x.*")
    kind = F.when(F.col("rule_id").startswith("IMP"), "ransomware").when(F.lower("raw_line").contains("lsass"), "rootkit").when(F.col("category") == "lolbin", "tool").otherwise("unknown")
    return first.withColumn("kind", kind)


def objects(found: DataFrame, indicators: DataFrame) -> DataFrame:
    """COLUMNS: identity, attack patterns, threat actors, malware, courses of action, indicators (merged ones) and observed data."""
    spark, c = found.sparkSession, F.col
    who = _shaped(spark.range(1), "identity", F.lit(OWNER), F.lit(OWNER))
    patterns = _shaped(found.select(F.explode("mitre_ids").alias("t")).distinct(), "attack-pattern", c("t"), c("t"))
    a = actors(found)
    people = _shaped(a, "threat-actor", c("source_ip"), c("source_ip"), labels=c("techniques"), detail=F.concat(F.when(c("risk") >= 7, "intermediate").otherwise("minimal"), F.lit(": "), "goals"), confidence=c("confidence"), n=c("n"), first_us=c("first_us"), last_us=c("last_us"))
    m = malware(found)
    tools = _shaped(m, "malware", c("rule_id"), c("rule_name"), labels=F.concat_ws(",", "rule_id", "category"), detail=c("kind"), confidence=F.floor(_points() / 100))
    actions = _shaped(found.select("category").where("category is not null").distinct(), "course-of-action", c("category"), F.concat(F.lit("Mitigate: "), title(c("category"))), labels=c("category"))
    said = core.lookup({k: ",".join(v) for k, v in ioc.INDICATOR_TYPES.items()}, "type")
    labels = F.concat_ws(";", said, F.array_join(F.slice("tags", 1, 10), ","))
    marks = _shaped(indicators, "indicator", key_of(indicators), F.concat(c("type"), F.lit(": "), F.substring("value", 1, 80)), labels=labels, detail=ioc.stix_pattern("type", "value"), confidence=F.floor(_points() / 100), n=c("n"))
    seen = found.withColumn("_key", observed_key()).groupBy("_key").agg(F.count("*").alias("n"), F.min("us").alias("first_us"), F.max("us").alias("last_us"), _some("severity", 5).alias("severities"), _some("rule_id", 10).alias("rules"))
    data = _shaped(seen, "observed-data", c("_key"), c("_key"), labels=c("rules"), detail=c("severities"), n=c("n"), first_us=c("first_us"), last_us=c("last_us"))
    out = who
    for one in (patterns, people, tools, actions, marks, data):
        out = out.unionByName(one)
    return out


def relations(found: DataFrame, indicators: DataFrame) -> DataFrame:
    """source, relation, target: actors use patterns, indicators indicate actors (by address) and malware (by rule), patterns are mitigated by actions, and observations are related to at most RELATED indicators of their address, the surest first."""
    link = lambda df, a, relation, b: df.select(a.alias("source"), F.lit(relation).alias("relation"), b.alias("target")).distinct()
    who = actors(found).select("source_ip")
    techniques = found.join(who, "source_ip", "left_semi").select("source_ip", F.explode("mitre_ids").alias("t"))
    uses = link(techniques, object_id("threat-actor", "source_ip"), "uses", object_id("attack-pattern", "t"))
    mark = object_id("indicator", key_of(indicators))
    by_address = link(indicators.where("type = 'ipv4'").drop("source_ip").join(who, F.col("value") == F.col("source_ip")), mark, "indicates", object_id("threat-actor", "source_ip"))
    by_rule = link(indicators.join(malware(found).select("rule_id"), F.col("source_rule") == F.col("rule_id")), mark, "indicates", object_id("malware", "rule_id"))
    ways = found.where("category is not null").select(F.explode("mitre_ids").alias("t"), "category")
    mitigated = link(ways, object_id("attack-pattern", "t"), "mitigated-by", object_id("course-of-action", "category"))
    rank = F.row_number().over(Window.partitionBy("source_ip").orderBy(F.desc("confidence"), "type", "value"))
    near = indicators.where("source_ip <> ''").withColumn("_r", rank).where(F.col("_r") <= RELATED)
    keys = found.select(observed_key().alias("_key")).distinct()
    related = link(near.join(keys, F.col("source_ip") == F.col("_key")), object_id("observed-data", "_key"), "related-to", mark)
    return uses.unionByName(by_address).unionByName(by_rule).unionByName(mitigated).unionByName(related)


def bodies(rows: DataFrame) -> DataFrame:
    """Objects as JSON, one a row; nulls are left out."""
    return rows.select(F.to_json(F.struct(*COLUMNS)).alias("value"))
