"""The layered attack graph: source, category, rule and technique, with the edges of chains, reduced to what matters most."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import core

# What a kind of node and a relation add to a score
KIND_BONUS = {"source": 4.0, "category": 2.2, "rule": 2.8, "technique": 2.5}
RELATION_BONUS = {"chain": 3.0, "chain_start": 3.0, "chain_rule": 2.6, "chain_technique": 2.6, "maps_to": 2.2, "matched": 1.8, "triggered": 1.6}
PREFIX = {"source": "src:", "category": "cat:", "rule": "rule:", "technique": "tech:"}
NODES, EDGES = 900, 2200  # kept
NAMES = 8  # rules and techniques of a chain that become edges
TECHNIQUES = 4  # of a finding
HIGH = core.SEVERITIES.index("HIGH")


def _id(kind: str, name: Column) -> Column:
    return F.concat(F.lit(PREFIX[kind]), name)


def _node(kind: str, name: Column, label: Column | None = None) -> Column:
    return F.struct(_id(kind, name).alias("node"), (name if label is None else label).alias("label"), F.lit(kind).alias("kind"))


def _edge(source: Column, target: Column, relation: str) -> Column:
    return F.struct(source.alias("source"), target.alias("target"), F.lit(relation).alias("relation"))


def title(category: Column) -> Column:
    return F.initcap(F.replace(category, F.lit("_"), F.lit(" ")))


def _each(names: Column, most: int) -> Column:
    return F.slice(F.coalesce(names, F.array().cast("array<string>")), 1, most)


def parts(found: DataFrame, chains: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All nodes (node, label, kind, weight, risk, rank) and edges (source, target, relation, weight, risk, rank) of findings and of chains (source, categories, rules, techniques, max_risk_score)."""
    source = F.coalesce(F.nullif("source_ip", F.lit("")), F.nullif("hostname", F.lit("")), F.lit("unknown-source"))
    rows = found.select(source.alias("s"), F.coalesce("category", F.lit("uncategorized")).alias("c"), F.coalesce("rule_id", F.lit("rule")).alias("r"), _each(F.col("mitre_ids"), TECHNIQUES).alias("t"), F.col("risk_score").alias("risk"), F.coalesce(core.severity_rank("severity"), F.lit(0)).alias("rank"))
    s, c, r = F.col("s"), F.col("c"), F.col("r")
    own = F.concat(F.array(_node("source", s), _node("category", c, title(c)), _node("rule", r)), F.transform("t", lambda t: _node("technique", t)))
    ties = F.concat(F.array(_edge(_id("source", s), _id("category", c), "triggered"), _edge(_id("category", c), _id("rule", r), "matched")), F.transform("t", lambda t: _edge(_id("rule", r), _id("technique", t), "maps_to")))
    chain = chains.where(F.size("categories") > 0).select("source", "categories", _each(F.col("rules"), NAMES).alias("r"), _each(F.col("techniques"), NAMES).alias("t"), F.col("max_risk_score").alias("risk"), F.lit(HIGH).alias("rank"))
    cats, n = F.col("categories"), F.size("categories")
    last = _id("category", F.element_at("categories", -1))
    more = F.concat(F.array(_node("source", F.col("source"))), F.transform("r", lambda x: _node("rule", x)), F.transform("t", lambda x: _node("technique", x)))
    links = F.concat(
        F.zip_with(F.slice(cats, 1, n - 1), F.slice(cats, 2, n), lambda a, b: F.when(b.isNotNull(), _edge(_id("category", a), _id("category", b), "chain"))),
        F.array(_edge(_id("source", F.col("source")), _id("category", cats[0]), "chain_start")),
        F.transform("r", lambda x: _edge(last, _id("rule", x), "chain_rule")),
        F.when(F.size("r") > 0, F.transform("t", lambda x: _edge(_id("rule", F.element_at("r", -1)), _id("technique", x), "chain_technique"))).otherwise(F.array()),
    )
    total = [F.count("*").alias("weight"), F.max("risk").alias("risk"), F.max("rank").alias("rank")]
    nodes = rows.select("risk", "rank", F.explode(own).alias("x")).unionByName(chain.select("risk", "rank", F.explode(more).alias("x"))).groupBy("x.node", "x.label", "x.kind").agg(*total)
    edges = rows.select("risk", "rank", F.explode(ties).alias("x")).unionByName(chain.select("risk", "rank", F.explode(F.array_compact(links)).alias("x"))).groupBy("x.source", "x.target", "x.relation").agg(*total)
    return nodes, edges


def layered_graph(found: DataFrame, chains: DataFrame, node_limit: int = NODES, edge_limit: int = EDGES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and one row about the reduction.

    The nodes of the highest score, ties by name, and of the edges between them (none dangles) those of the highest score; weight_norm is an edge's
    weight over the greatest of the kept. The row says how many there were, stayed and went.
    """
    nodes, edges = parts(found, chains)
    kept = nodes.withColumn("score", F.col("rank") * 6.0 + F.col("risk") * 2.8 + F.col("weight") * 0.7 + core.lookup(KIND_BONUS, "kind", 1.0)).orderBy(F.desc("score"), "node").limit(node_limit)
    names = F.broadcast(kept.select("node"))  # node_limit at most
    between = edges.join(names.withColumnRenamed("node", "source"), "source", "left_semi").join(names.withColumnRenamed("node", "target"), "target", "left_semi")
    scored = between.withColumn("score", F.col("rank") * 5.0 + F.col("risk") * 2.2 + F.col("weight") * 0.8 + core.lookup(RELATION_BONUS, "relation", 1.0))
    ties = scored.orderBy(F.desc("score"), "source", "target", "relation").limit(edge_limit)
    most = F.broadcast(ties.agg(F.max("weight").alias("most")))  # one row
    ties = ties.crossJoin(most).withColumn("weight_norm", F.round(F.least(F.lit(1.0), F.col("weight") / F.col("most")), 3)).drop("most")
    count = lambda df, name: df.agg(F.count("*").alias(name))
    about = nodes.agg(F.count("*").alias("nodes_raw"), F.max("risk").alias("max_risk"))
    for one in (count(edges, "edges_raw"), count(kept, "nodes_kept"), count(ties, "edges_kept"), count(chains, "chain_count")):
        about = about.crossJoin(F.broadcast(one))  # one row each
    gone = [(F.col(f"{x}_raw") - F.col(f"{x}_kept")).alias(f"{x}_dropped") for x in ("nodes", "edges")]
    about = about.select("*", *gone).withColumn("reduced", (F.col("nodes_dropped") > 0) | (F.col("edges_dropped") > 0))
    return kept, ties, about
