"""Case tables, statistics and report data: aggregates and joins over findings and what analysts add."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import core
from . import correlate, search, shared


def case_stats(found: DataFrame, chains: DataFrame, evidence: DataFrame, session: str | None = None, since_us: int | None = None, until_us: int | None = None, top: int = 10) -> DataFrame:
    """dimension, value, n, max_risk, avg_risk, first_us, last_us of a case: the total, severities, categories, and the top addresses, hosts and rules; sessions, evidence and chains are counted.

    One pass over the findings: each counts once for every dimension.
    """
    rows = found if session is None else found.where(F.col("session_id") == session)
    rows = rows if since_us is None else rows.where(F.col("us") >= since_us)
    rows = rows if until_us is None else rows.where(F.col("us") <= until_us)
    return search.dimensions(rows, [("total", None), ("severity", None), ("category", None), ("source_ip", top), ("hostname", top), ("rule_id", top)]).unionByName(
        _count(found.select("session_id").distinct(), "sessions").unionByName(_count(evidence, "evidence")).unionByName(_count(chains, "attack_chains")), allowMissingColumns=True
    )


def _count(table: DataFrame, name: str) -> DataFrame:
    return table.agg(F.count("*").alias("n")).select(F.lit(name).alias("dimension"), F.lit("all").alias("value"), "n")


def dashboard(found: DataFrame, top: int = 12) -> DataFrame:
    """section, name, n, max_risk: severities, categories, and the top techniques, sources, hosts and rules."""
    each = F.array(*[F.struct(F.lit(s).alias("section"), F.col(c).alias("name")) for s, c in (("severity", "severity"), ("category", "category"), ("source", "source_ip"), ("host", "hostname"), ("rule", "rule_id"))])
    techniques = F.transform("mitre_ids", lambda t: F.struct(F.lit("technique").alias("section"), t.alias("name")))
    rows = found.select("risk_score", F.explode(F.concat(each, techniques)).alias("d")).where("d.name is not null")
    n = rows.groupBy("d.section", "d.name").agg(F.count("*").alias("n"), F.max("risk_score").alias("max_risk"))
    rank = F.row_number().over(Window.partitionBy("section").orderBy(F.desc("n"), "name"))
    return n.withColumn("_r", rank).where(F.col("section").isin("severity", "category") | (F.col("_r") <= top)).drop("_r")


def tagged(found: DataFrame, tags: DataFrame) -> DataFrame:
    """Findings with analyst_tags, the distinct tags that analysts gave them (id, tags, created_us), by when each was first given."""
    each = tags.select("id", "created_us", F.posexplode("tags").alias("at", "tag")).select("id", F.trim("tag").alias("tag"), F.struct("created_us", "at").alias("first")).where("tag <> ''")
    first = each.groupBy("id", "tag").agg(F.min("first").alias("first"))
    own = first.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "tag"))), lambda x: x["tag"]).alias("analyst_tags"))
    return found.join(own, "id", "left").withColumn("analyst_tags", F.coalesce("analyst_tags", F.array().cast("array<string>")))


def hardening(found: DataFrame, advice: DataFrame) -> DataFrame:
    """category, position, step: the advice (category, position, step) for every category that has findings."""
    return advice.join(found.select("category").distinct(), "category", "left_semi")


def session_summaries(sessions: DataFrame, found: DataFrame) -> DataFrame:
    """Every session (session_id, ...) with the number of its findings, of grave ones, and its greatest risk; 0 without any."""
    n = found.groupBy("session_id").agg(F.count("*").alias("findings"), F.count(F.when(core.severity_rank("severity") >= 3, 1)).alias("grave"), F.max("risk_score").alias("max_risk"))
    out = sessions.join(n, "session_id", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("findings", "grave")}).withColumn("max_risk", F.coalesce("max_risk", F.lit(0.0)))


def report_data(found: DataFrame, actions: DataFrame, top: int = 5) -> DataFrame:
    """The top findings by risk with their state and where each comes from. Only they meet the actions."""
    first = search.by_risk(found, top)
    own = actions.join(F.broadcast(first.select("id").distinct()), "id", "left_semi")
    rows = search.by_risk(search.triage(first, own), top)
    lines = F.size(F.coalesce("supporting_lines", F.array().cast("array<string>"))) if "supporting_lines" in found.columns else F.lit(0)
    return rows.select("id", "rule_id", "rule_name", "severity", "confidence", "risk_score", F.col("state").alias("triage_state"), "source_file", "line_number", "raw_line", lines.alias("supporting_line_count"))


def report_numbers(found: DataFrame) -> DataFrame:
    """One row: findings, critical, high, max_risk, avg_risk, categories and techniques in order."""
    names = lambda c: F.array_sort(F.collect_set(c))
    techniques = F.array_sort(F.array_distinct(F.flatten(F.collect_set("mitre_ids"))))
    return found.agg(
        F.count("*").alias("findings"), F.count(F.when(F.col("severity") == "CRITICAL", 1)).alias("critical"), F.count(F.when(F.col("severity") == "HIGH", 1)).alias("high"),
        F.max("risk_score").alias("max_risk"), F.round(core.exact_mean("risk_score", 2), 6).alias("avg_risk"), F.array_join(names("category"), ",").alias("categories"), F.array_join(techniques, ",").alias("techniques"),
    )


def save_report(found: DataFrame, actions: DataFrame, path: str) -> None:
    """The report's parts as JSON tables."""
    report_numbers(found).write.mode("overwrite").json(f"{path}/summary")
    report_data(found, actions).write.mode("overwrite").json(f"{path}/top_findings")
    correlate.derived_chains(found).write.mode("overwrite").json(f"{path}/attack_chains")


def save_graph(found: DataFrame, path: str) -> None:
    """Nodes and edges of the attack graph as tables."""
    edges = correlate.graph_edges(found)
    edges.write.mode("overwrite").parquet(f"{path}/edges")
    correlate.graph_nodes(edges).write.mode("overwrite").parquet(f"{path}/nodes")


#: tables that a case only ever appends to, and their columns
CASE_TABLES = {
    "sessions": "session_id string, source_file string, sha256 string, created_us long", "evidence": "session_id string, path string, sha256 string, size long, added_us long",
    "notes": "session_id string, analyst string, note string, created_us long", "journal": "session_id string, analyst string, action string, detail string, created_us long",
    "views": "name string, query string, created_us long", "bookmarks": "session_id string, id string, label string, created_us long",
    "attack_chains": "session_id string, chain_name string, source_ip string, categories string, max_risk_score double", "actions": "id string, action string, analyst string, created_us long",
    "risk_snapshots": "taken_us long, kind string, value string, risk_score double, risk_band string, finding_count long",
}


#: tables in folders by session; actions go with the findings that they name
BY_SESSION = tuple(name for name, columns in CASE_TABLES.items() if "session_id" in columns)
BUCKETS = 32  # folders of the actions


def append(spark, table: str, rows, root: str) -> None:
    """Adds rows (a DataFrame or tuples) to a case table under root; unknown columns are an error."""
    schema = CASE_TABLES[table]
    df = rows if isinstance(rows, DataFrame) else spark.createDataFrame(rows, schema)
    wanted = spark.createDataFrame([], schema).schema
    df = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in wanted])
    _writer(table, df).mode("append").parquet(f"{root}/{table}")


def _writer(table: str, df: DataFrame):
    if table == "actions":
        return df.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(BUCKETS)).cast("int")).write.partitionBy("bucket")
    return df.write.partitionBy("session_id") if table in BY_SESSION else df.write


def read(spark, table: str, root: str) -> DataFrame:
    """A case table; empty where nothing was added yet."""
    from pyspark.errors import AnalysisException

    more = ", bucket int" if table == "actions" else ""
    try:
        return spark.read.schema(CASE_TABLES[table] + more).parquet(f"{root}/{table}").drop("bucket")
    except AnalysisException:
        return spark.createDataFrame([], CASE_TABLES[table])


def delete_session(spark, session: str, root: str) -> dict[str, int]:
    """Takes a session out of every case table and out of the findings under root; rows deleted by table.

    Tables are in folders by session: the session's folder goes, and no other file is touched. Actions name findings: those of the session's are
    taken out of the folders they are in, which are written anew (dynamic partition overwrite); all others stay.
    """
    findings = f"{root}/findings"
    out = {"actions": _delete_actions(spark, session, root)}
    for table in BY_SESSION:
        out[table] = _drop_folder(spark, read(spark, table, root), session)
    if _exists(spark, findings):
        out["findings"] = _drop_folder(spark, spark.read.parquet(findings), session)
    return out


def _drop_folder(spark, table: DataFrame, session: str) -> int:
    rows = table.where(F.col("session_id").cast("string") == session)
    n = rows.count()
    for (file,) in rows.select("_metadata.file_path").distinct().collect() if n else []:
        _path(spark, file)[1].delete(_path(spark, file)[0], False)
    return n


def _delete_actions(spark, session: str, root: str) -> int:
    if not (_exists(spark, f"{root}/findings") and _exists(spark, f"{root}/actions")):
        return 0
    ids = spark.read.parquet(f"{root}/findings").where(F.col("session_id").cast("string") == session).select("id").distinct()
    actions = spark.read.schema(f"{CASE_TABLES['actions']}, bucket int").parquet(f"{root}/actions")
    gone = shared.written(actions.join(ids, "id", "left_semi"), "deleted-actions")
    n = gone.count()
    buckets = [r[0] for r in gone.select("bucket").distinct().collect()]
    if n:
        rest = shared.written(actions.where(F.col("bucket").isin(buckets)).join(ids, "id", "left_anti"), "kept-actions")
        empty = set(buckets) - {r[0] for r in rest.select("bucket").distinct().collect()}
        rest.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{root}/actions")
        for bucket in empty:
            at, fs = _path(spark, f"{root}/actions/bucket={bucket}")
            fs.delete(at, True)
    return n


def _path(spark, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(path) if "://" in path or path.startswith("file:") else path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def _exists(spark, path: str) -> bool:
    at, fs = _path(spark, path)
    return fs.exists(at)


def risk_snapshot(found: DataFrame, taken_us: int) -> DataFrame:
    """Entity risks as rows of risk_snapshots."""
    return correlate.entity_risk(found).select(F.lit(taken_us).cast("long").alias("taken_us"), "kind", "value", "risk_score", "risk_band", "finding_count")
