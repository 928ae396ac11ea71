"""The registered queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import core
from .operators import cases, correlate, detect, ioc, layers, objects, report, retrieval, search, shared, text
from .plans.adapter import events
from .rules.catalog import RULES
from .rules.model import C, Rule
from .sources import formats, probing
from .streaming import jobs


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of all pattern rules."""
    return detect.findings(detect.regex_hits(events(spark, sf_dir)))


def _rule(**k) -> Rule:
    return Rule("X-1", "x", "HIGH", "auth", 0.8, (), (), k.pop("type"), **k)


DAY = 86400
THRESHOLD = _rule(type="threshold", where={"auth_result": "failure"}, key="source_ip", count=4, seconds=2 * DAY)
DISTINCT = _rule(type="threshold", key="username", count=4, seconds=DAY, distinct="dest_port")
SEQUENCE = _rule(type="sequence", key="username", seconds=5 * DAY, steps=({"match_field": "auth_result", "value": "failure", "min_count": 2}, {"match_field": "auth_result", "value": "success"}))
#: two failures within two days and a scanner's name within four, in any order
COMPOSITE = C("X-2", "username", 4 * DAY, [_rule(type="threshold", where={"auth_result": "failure"}, key="username", count=2, seconds=2 * DAY), _rule(type="regex", match_field="http_user_agent", pattern="^sqlmap")])
SESSION = "2024-01-10"
CASE = ("IR-2024-001", "2024-02-01T00:00:00Z")


def _features(s, d):
    return correlate.behaviour(found(s, d))


def _composite(s, d):
    return detect.composite_fires(events(s, d), COMPOSITE).select("key", "line_number", "event_count")


def _deduplicated(s, d):
    return detect.deduplicate(found(s, d), 6 * 3600).select("rule_id", "source", "line_number", "n_merged")


def _graph_reduced(s, d):
    edges = correlate.graph_edges(found(s, d))
    return correlate.reduced(correlate.graph_nodes(edges), edges, 30)[1].select("source", "target", "weight", "max_risk")


def _layers(s, d, i):
    f = shared.written(found(s, d), "findings")  # read several times
    return layers.layered_graph(f, correlate.derived_chains(f), 60, 150)[i]


def _index(s, d):
    f = shared.written(found(s, d), "findings")
    return retrieval.two_runs(f.where("severity = 'CRITICAL'"), f)


def _triage(s, d):
    f = found(s, d)
    at = lambda n, action, when: f.where(F.col("line_number") % n == 0).select("id", F.lit(action).alias("action"), F.lit(when).alias("created_us"))
    return search.triage(f, at(3, "open", 1).union(at(7, "closed", 2))).select("rule_id", "line_number", "state")


def _rule_tests(s, d):
    names = lambda *x: s.createDataFrame([(i,) for i in x], "rule_id string")
    return search.rule_tests(found(s, d), names("WEB-001", "IMP-001", "SC-002"), names("WEB-002", "LAT-006"))


#: rule tests: name, rules that must fire, rules that must not, least number of findings
CORPUS_TESTS = [("h1", ["IMP-001", "SC-002"], ["LAT-006"], 10), ("h3", ["WEB-001", "WEB-009"], ["WEB-002", "IMP-002"], 1), ("h9", [], ["NET-001"], 100_000), ("none", ["WEB-001"], [], 0)]


def _corpus_tests(s, d):
    """Each host's findings are a corpus of its own."""
    rules = [(name, r, kind) for name, must, must_not, _ in CORPUS_TESTS for kind, rs in (("expected", must), ("forbidden", must_not)) for r in rs]
    tests, least = s.createDataFrame(rules, "test string, rule_id string, kind string"), s.createDataFrame([(t[0], t[3]) for t in CORPUS_TESTS], "test string, least long")
    return search.corpus_tests(found(s, d).withColumn("test", F.col("hostname")), tests, least)


def _indicators(s, d):
    """Findings and their merged indicators, both written once, as they are read several times."""
    f = shared.written(found(s, d), "findings")
    return f, shared.written(ioc.merged(ioc.of_findings(f)), "indicators")


def _ip_classes(s, d):
    e = events(s, d)
    ips = e.select(F.col("source_ip").alias("ip")).union(e.select("dest_ip"))
    return ips.groupBy("ip").agg(F.count("*").alias("n")).select("ip", core.ip_class("ip").alias("class"), "n")


def _http_severities(s, d):
    return events(s, d).groupBy(core.http_severity("http_status").alias("severity"), core.minute_of("timestamp").alias("minute")).agg(F.count("*").alias("n"))


def _iocs(s, d):
    return ioc.extract(_docs(s, d), "text", F.lit(1.0), "doc_id")


def _merged(s, d):
    """Indicators of the documents, with the language as tag and the source in place of a rule."""
    rows = _docs(s, d).select("text", F.array(F.coalesce("lang", F.lit("-"))).alias("tags"), F.coalesce("source", F.lit("-")).alias("source_rule"))
    return ioc.merged(ioc.extract(rows, "text", F.lit(1.0), "tags", "source_rule"))


def _ioc_reputation(s, d):
    i = _merged(s, d)
    last = F.element_at(F.split("value", r"\."), 4).cast("int")
    rep = i.where("type = 'ipv4'").select(F.col("value").alias("ip"), (last % 101).cast("double").alias("score"), F.when(last % 3 == 0, "de").otherwise("").alias("country"))
    return ioc.reputation_of(i, rep).select("type", "value", F.round("confidence", 6).alias("confidence"), F.array_join("tags", ",").alias("tags"))


def _ioc_feeds(s, d):
    i = shared.written(_merged(s, d), "indicators")  # read several times
    n = F.length("value")
    engines = i.where(n % 2 == 0).select("value", (n % 7).alias("detected"), F.lit(10).alias("total"), (-n * 3).alias("reputation"))
    pulses = i.where(n % 3 == 0).select("value", (n % 20).alias("pulses"))
    return ioc.with_feeds(i, engines.distinct(), pulses.distinct(), i.where("type = 'url'"), i.where("type = 'hash_sha1'")).select("type", "value", "threat_score", "verdict")


def _tags(s, d):
    f = found(s, d)
    tags = f.where("line_number % 5 = 0").select("id", F.array(F.lit("checked"), "category").alias("tags"), F.lit(2).alias("created_us"))
    return report.tagged(f, tags.union(tags.where("line_number % 10 = 0").select("id", F.array(F.lit("late"), F.lit("checked")), F.lit(3)))).select("rule_id", "line_number", F.array_join("analyst_tags", ",").alias("tags"))


ADVICE = [("web_attack", 1, "check what requests may hold"), ("web_attack", 2, "close directory lists"), ("auth", 1, "lock accounts after failures"), ("impact", 1, "keep copies apart")]


def _raw_formats(s, d):
    """Events as raw lines of four formats in a file each, told apart by content, parsed together, and counted."""
    e = events(s, d)
    second = F.date_format("timestamp", "MMM d HH:mm:ss")
    kind = F.col("line_number") % 4
    line = (
        F.when(kind == 0, F.concat("source_ip", F.lit(" - - ["), F.date_format("timestamp", "dd/MMM/yyyy:HH:mm:ss"), F.lit(' +0000] "GET '), "http_uri", F.lit(' HTTP/1.1" 200 5 "-" "x"')))
        .when(kind == 1, F.concat(second, F.lit(" "), "hostname", F.lit(" sshd[7]: Failed password for "), "username", F.lit(" from "), "source_ip", F.lit(" port 22 ssh2")))
        .when(kind == 2, F.to_json(F.struct(F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), F.col("source_ip").alias("ip"))))
        .otherwise(F.concat(second, F.lit(" gw kernel: IN=eth0 OUT= SRC="), "source_ip", F.lit(" DST="), "dest_ip", F.lit(" PROTO=TCP SPT=5 DPT=22")))
    )
    lines = e.select(F.concat(F.lit("file"), kind).alias("source_file"), "line_number", line.alias("raw_line"))
    kinds = shared.written(probing.file_format(lines), "formats")
    parsed = formats.normalise_mixed(lines.join(shared.small(kinds), "source_file"), ["apache_combined", "auth_log", "json_generic", "iptables"])
    return parsed.groupBy("source_file", "log_format").agg(F.count("*").alias("lines"), F.countDistinct("source_ip").alias("ips"))


def _zeek_headers(s, d):
    """Events as connection logs whose files name their columns in different orders, parsed by the names."""
    e = events(s, d).withColumn("source_file", F.concat(F.lit("conn"), F.col("line_number") % 2))
    values = {"ts": F.format_string("%d.%06d", F.floor(F.col("us") / 1000000).cast("long"), F.col("us") % 1000000), "id.orig_h": F.col("source_ip"), "id.resp_h": F.col("dest_ip"), "id.resp_p": F.col("dest_port").cast("string"), "proto": F.lit("tcp")}
    orders = [list(values), ["proto", "id.resp_p", "ts", "id.resp_h", "id.orig_h"]]
    line = F.when(F.col("line_number") % 2 == 0, F.concat_ws("\t", *[values[c] for c in orders[0]])).otherwise(F.concat_ws("\t", *[values[c] for c in orders[1]]))
    heads = s.createDataFrame([(f"conn{i}", -1, "#fields\t" + "\t".join(o)) for i, o in enumerate(orders)], "source_file string, line_number long, raw_line string")
    lines = e.select("source_file", F.col("line_number").cast("long"), line.alias("raw_line")).union(heads)
    return probing.parse_with_header(lines, "zeek_conn").select("line_number", "source_ip", "dest_ip", "dest_port", "protocol", F.unix_timestamp("timestamp").alias("second"))


def _files(s, d):
    """Events as lines of six files: two connection logs with headers in different orders, a flow log and a web server's log with headers, a web log and a JSON log without."""
    e = events(s, d)
    kind = F.col("line_number") % 6
    second = F.floor(F.col("us") / 1000000).cast("string")
    port, day, time = F.col("dest_port").cast("string"), F.date_format("timestamp", "yyyy-MM-dd"), F.date_format("timestamp", "HH:mm:ss")
    conn = {"ts": second, "id.orig_h": F.col("source_ip"), "id.resp_h": F.col("dest_ip"), "id.resp_p": port, "proto": F.lit("tcp")}
    flow = {"version": F.lit("2"), "start": second, "dstport": port, "srcaddr": F.col("source_ip"), "action": F.lit("ACCEPT"), "dstaddr": F.col("dest_ip"), "protocol": F.lit("6")}
    web = {"date": day, "time": time, "c-ip": F.col("source_ip"), "cs-method": F.col("http_method"), "cs-uri-stem": F.lit("/a"), "s-ip": F.col("dest_ip"), "s-port": port, "sc-status": F.col("http_status").cast("string")}
    heads = {0: ("zeek_conn", "#fields\t", "\t", list(conn), conn), 1: ("zeek_conn", "#fields\t", "\t", list(conn)[::-1], conn), 2: ("aws_vpc_flow", "", " ", list(flow), flow), 3: ("iis_w3c", "#Fields: ", " ", list(web)[::-1], web)}
    line = F.when(kind == 4, F.concat("source_ip", F.lit(" - - ["), F.date_format("timestamp", "dd/MMM/yyyy:HH:mm:ss"), F.lit(' +0000] "GET /a HTTP/1.1" '), F.col("http_status").cast("string"), F.lit(' 5 "-" "x"')))
    line = line.when(kind == 5, F.to_json(F.struct(F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), F.col("source_ip").alias("ip"), F.col("http_status").alias("status"))))
    names = F.when(kind == 4, "apache_combined").when(kind == 5, "json_lines")
    for k, (name, _, separator, order, values) in heads.items():
        line, names = line.when(kind == k, F.concat_ws(separator, *[values[c] for c in order])), names.when(kind == k, name)
    lines = e.select(F.concat(F.lit("file"), kind).alias("source_file"), "line_number", names.alias("log_format"), line.alias("raw_line"))
    first = s.createDataFrame([(f"file{k}", -1, name, mark + separator.join(order)) for k, (name, mark, separator, order, _) in heads.items()], "source_file string, line_number long, log_format string, raw_line string")
    parsed = probing.normalise_files(lines.withColumn("line_number", F.col("line_number").cast("long")).union(first.select(*lines.columns)), ["zeek_conn", "aws_vpc_flow", "iis_w3c", "apache_combined", "json_lines"])
    return parsed.select("line_number", "log_format", "source_ip", "dest_ip", "dest_port", "http_status", F.unix_timestamp("timestamp").alias("second"))


def _condition(s, d):
    selections = {"web_login": {"http_uri_decoded|contains": "login"}, "web_etc": {"http_uri_decoded|contains": "etc?passwd"}, "tool": {"http_user_agent": "sql*"}, "quiet": {"http_status": 200}}
    return events(s, d).where(cases.condition("1 of web* and (tool or not quiet)", selections) & cases.from_source("webserver")).select("line_number")


def _evidence(s, d):
    return detect.with_lines(events(s, d), detect.threshold_fires(events(s, d), THRESHOLD)).select("key", "line_number", F.array_join("supporting_lines", "|").alias("lines"))


def _top_findings(s, d):
    f = found(s, d).select("id", "rule_id", "rule_name", "severity", "confidence", "risk_score", "us", "source_file", "line_number", "raw_line")
    f = shared.written(f, "findings")  # read twice
    return report.report_data(f, f.where("line_number % 2 = 0").select("id", F.lit("open").alias("action"), F.lit(1).alias("created_us"))).select("rule_id", "line_number", "triage_state", "risk_score", "raw_line")


def _case_numbers(s, d):
    f = found(s, d).select("session_id", "risk_score", "source_ip", "hostname", "username", "tactic_names", "category")
    return cases.case_numbers(shared.written(f, "findings"))  # read twice


def _case_stats(s, d):
    f = shared.written(found(s, d).select("session_id", "severity", "category", "source_ip", "hostname", "rule_id", "risk_score", "us"), "findings")  # read several times
    return report.case_stats(f, correlate.kill_chains(f), _docs(s, d))


def _reputation(s, d):
    rep = events(s, d).select(F.col("source_ip").alias("ip"), (F.element_at(F.split("source_ip", r"\."), 4).cast("int") % 101).cast("double").alias("score")).distinct()
    return ioc.with_reputation(found(s, d), rep).select("rule_id", "line_number", "reputation", "known_bad", F.array_join("rule_tags", ",").alias("tags"), F.round("confidence", 6).alias("confidence"))


def _geo(s, d):
    lo = F.lit(757137408) + F.col("n_nationkey") * 10240
    nets = s.read.parquet(f"{d}/nation.parquet").select(lo.cast("long").alias("lo"), (lo + 10239).cast("long").alias("hi"), F.col("n_name").alias("country"))
    return ioc.with_geo(events(s, d), nets).select("line_number", "source_ip", "country", F.array_join("geo_tags", ",").alias("tags"))


def _cosine(s, d):
    v = s.read.parquet(f"{d}/embeddings.parquet")
    q = v.where("vec_id = 7").select("embedding").first()[0]
    return text.cosine_top(v, q, where=F.col("label").isNotNull())


def _docs(s, d):
    return s.read.parquet(f"{d}/documents.parquet")


def _integrity(s, d):
    """Documents as evidence: the text's hash as recorded, against that of a copy where some changed and some are gone."""
    docs = _docs(s, d).select(F.col("doc_id").cast("string").alias("path"), "source", "text")
    then = docs.select("path", F.col("source").alias("session_id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"))
    n = F.col("path").cast("long")
    now = docs.where(n % 50 != 3).select("path", F.sha2(F.concat(F.coalesce("text", F.lit("")), F.when(n % 40 == 7, "x").otherwise("")), 256).alias("sha256"))
    return cases.trust(cases.integrity(then, now))


STEPS = [("web_attack", "contain", "block the source"), ("web_attack", "recover", "patch"), ("auth_attack", "contain", "lock the account"), ("malware", "contain", "take it off the net"), ("default", "triage", "look at it")]


def _playbook(s, d):
    steps = s.createDataFrame(STEPS, "category string, phase string, step string")
    return cases.playbook_steps(found(s, d), steps).groupBy("category", "phase", "step").agg(F.count("*").alias("n"))


def _decoys(s, d):
    e = events(s, d)
    return cases.decoy_counts(e, e.where("dest_port = 1007").select(F.col("source_ip").alias("value")).distinct().withColumn("token_id", F.concat(F.lit("t"), "value"))).select("token_id", "n")


def _decoys_any(s, d):
    """Decoys of 1 to 40 characters, one cut from each user's first line and each document's source, looked for in all lines."""
    e = events(s, d)
    n = F.col("user_id").cast("int")
    first = e.select(F.substring("username", 2, 9).alias("user_id"), "line_number", "raw_line").groupBy("user_id").agg(F.min_by("raw_line", "line_number").alias("line"))
    cut = first.select(F.concat(F.lit("u"), "user_id").alias("token_id"), F.substring("line", 1 + n % 60, 1 + n % 40).alias("value"))
    more = _docs(s, d).groupBy("source").agg(F.min("lang").alias("value")).select(F.concat(F.lit("d"), F.coalesce("source", F.lit("-"))).alias("token_id"), "value")
    return cases.decoy_counts(e, cut.union(more))


def _travel(s, d):
    """Hosts stand for users: a user of this table has one address."""
    rows = correlate.impossible_travel(events(s, d).withColumn("username", F.col("hostname")))
    return rows.select("username", "line_number", "source_ip", "other_line_number", "other_source_ip", (F.col("us") - F.col("other_us")).alias("apart_us"))


def _years(s, d):
    return cases.with_years(events(s, d).select("source_file", "line_number", F.when(F.col("line_number") % 100 < 50, 12).otherwise(1).alias("month")), 2020).groupBy("year").agg(F.count("*").alias("n"))


QUERIES = {
    "digest": lambda s, d: cases.digest(found(s, d)),
    "technique_rows": lambda s, d: cases.technique_rows(found(s, d)),
    "rule_hints": lambda s, d: cases.hints(found(s, d)).select("rule_id", "category", *(F.array_join(c, ",").alias(c) for c in ("addresses", "paths", "quoted", "event_ids", "users", "processes"))),
    "evidence_trust": _integrity,
    "playbook_steps": _playbook,
    "decoy_hits": _decoys,
    "decoys_any_length": _decoys_any,
    "impossible_travel": _travel,
    "logins_after_failures": lambda s, d: correlate.logins_after_failures(events(s, d), 12 * 3600),
    "year_rollover": _years,
    "observed": lambda s, d: cases.observed(found(s, d)),
    "case_numbers": _case_numbers,
    "session_history": lambda s, d: cases.sessions(found(s, d), "2024-01-30"),
    "context_block": lambda s, d: cases.context(found(s, d)),
    "stix_objects": lambda s, d: objects.objects(*_indicators(s, d)),
    "object_relations": lambda s, d: objects.relations(*_indicators(s, d)),
    "stix_relationships": lambda s, d: cases.stix_relationships(found(s, d)),
    "export_zeek": lambda s, d: cases.layout(_indicators(s, d)[1], "zeek", *CASE).toDF("indicator", "indicator_type", "source", "description", "url", "do_notice"),
    "export_misp": lambda s, d: cases.layout(_indicators(s, d)[1], "misp", *CASE),
    "export_csv": lambda s, d: cases.layout(_indicators(s, d)[1], "csv", *CASE),
    "entity_totals": lambda s, d: correlate.entity_totals(correlate.entity_risk(found(s, d))),
    "blocklist": lambda s, d: ioc.blocklist(_merged(s, d), "ipv4"),
    "selection": lambda s, d: events(s, d).where(cases.selection({"http_uri_decoded|contains": ["login", "etc?passwd"], "Agent": "sql*"}, {"Agent": "http_user_agent"})).select("line_number"),
    "hash_vectors": lambda s, d: _docs(s, d).select("doc_id", F.transform(text.hash_vector(F.coalesce("text", F.lit(""))), lambda x: F.round(x, 6)).alias("vector")),
    "event_rows": lambda s, d: events(s, d).select("line_number", "username", "source_ip", "auth_result", "http_status", "http_uri_decoded", "http_bytes", "session_id"),
    "detect_patterns": lambda s, d: detect.regex_hits(events(s, d)).select("rule_id", "line_number"),
    "detect_all_rules": lambda s, d: detect.detect(events(s, d)).select("rule_id", "line_number", "severity", "confidence", "risk_score"),
    "findings": lambda s, d: found(s, d).select("id", "rule_id", "line_number", "severity", "confidence", "risk_score"),
    "threshold_fires": lambda s, d: detect.threshold_fires(events(s, d), THRESHOLD).select("key", "line_number", "first_us", "event_count"),
    "distinct_threshold_fires": lambda s, d: detect.threshold_fires(events(s, d), DISTINCT).select("key", "line_number"),
    "sequence_fires": lambda s, d: detect.sequence_fires(events(s, d), SEQUENCE).select("key", "line_number"),
    "composite_fires": _composite,
    "deduplicated": _deduplicated,
    "first_per_minute": lambda s, d: detect.first_per_minute(found(s, d)).select("rule_id", "source_ip", "line_number"),
    "kill_chains": lambda s, d: correlate.kill_chains(found(s, d)).withColumn("categories", F.array_join("categories", ",")),
    "entity_risk": lambda s, d: correlate.entity_risk(found(s, d)),
    "entity_top_rules": lambda s, d: correlate.entity_top(found(s, d), "rule_id"),
    "behaviour": lambda s, d: _features(s, d).select("session_id", "entity", *(F.round(f, 6).alias(f) for f in correlate.FEATURES)),
    "behaviour_baseline": lambda s, d: correlate.baseline(_features(s, d).where(F.col("session_id") != SESSION)).select("entity", "feature", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "sessions"),
    "anomaly": lambda s, d: correlate.anomaly(_features(s, d), SESSION).withColumn("flags", F.array_join("flags", ",")),
    "graph_edges": lambda s, d: correlate.graph_edges(found(s, d)).withColumn("techniques", F.array_join("techniques", ",")),
    "graph_nodes": lambda s, d: correlate.graph_nodes(correlate.graph_edges(found(s, d))),
    "graph_reduced": _graph_reduced,
    "layered_nodes": lambda s, d: _layers(s, d, 0).drop("score"),
    "layered_edges": lambda s, d: _layers(s, d, 1).drop("score"),
    "layered_reduction": lambda s, d: _layers(s, d, 2),
    "index_upkeep": _index,
    "graph_layers": lambda s, d: correlate.layered_edges(found(s, d)),
    "tactic_coverage": lambda s, d: correlate.tactic_coverage(found(s, d)),
    "technique_counts": lambda s, d: correlate.technique_counts(found(s, d)),
    "technique_coverage": lambda s, d: correlate.technique_coverage(found(s, d), detect.rules_table(s, [r for r in RULES if r.type == "regex"])),
    "source_chains": lambda s, d: correlate.source_chains(found(s, d)),
    "hunt": lambda s, d: search.by_risk(search.hunt(found(s, d), category="web_attack", min_risk=4, min_severity="HIGH", technique="T1190", text="login")).select("rule_id", "line_number", "risk_score"),
    "findings_page": lambda s, d: search.page(found(s, d), 2, 50).select("rule_id", "line_number", "has_more"),
    "timeline": lambda s, d: search.timeline(found(s, d), ("HIGH", "CRITICAL"), 200).select("rule_id", "line_number", "us"),
    "timeline_newest": lambda s, d: search.timeline(found(s, d), limit=300, newest=True).select("rule_id", "line_number", "us"),
    "detection_summary": lambda s, d: search.detection_summary(detect.detect(events(s, d)), RULES),
    "findings_summary": lambda s, d: search.summary(found(s, d)),
    "threat_levels": lambda s, d: search.threat_levels(found(s, d)),
    "triage": _triage,
    "rule_tests": _rule_tests,
    "corpus_tests": _corpus_tests,
    "ip_classes": _ip_classes,
    "http_severities": _http_severities,
    "parse_apache": formats.apache_round_trip,
    "parse_syslog": formats.syslog_round_trip,
    "parse_key_values": formats.key_value_round_trip,
    "parse_json": formats.json_round_trip,
    "parse_stats": lambda s, d: events(s, d).groupBy("log_format").agg(F.count("*").alias("lines"), F.countDistinct("source_ip").alias("ips"), F.min("us").alias("first_us"), F.max("us").alias("last_us")),
    "ioc_extract": _iocs,
    "ioc_merge": lambda s, d: _merged(s, d).withColumn("tags", F.array_join("tags", ",")),
    "ioc_summary": lambda s, d: ioc.summary(_merged(s, d)),
    "ioc_reputation": _ioc_reputation,
    "ioc_feeds": _ioc_feeds,
    "finding_tags": _tags,
    "hardening": lambda s, d: report.hardening(found(s, d), s.createDataFrame(ADVICE, "category string, position int, step string")),
    "session_summaries": lambda s, d: report.session_summaries(events(s, d).select("session_id").distinct(), found(s, d)),
    "report_numbers": lambda s, d: report.report_numbers(found(s, d)),
    "report_top": _top_findings,
    "case_stats": _case_stats,
    "dashboard": lambda s, d: report.dashboard(found(s, d)),
    "derived_chains": lambda s, d: (lambda c: c.select("source", "chain_name", "finding_count", "max_risk_score", *(F.array_join(x, ",").alias(x) for x in ("categories", "rules", "techniques"))))(correlate.derived_chains(found(s, d))),
    "raw_formats": _raw_formats,
    "zeek_headers": _zeek_headers,
    "mixed_files": _files,
    "condition": _condition,
    "threshold_evidence": _evidence,
    "ioc_of_findings": lambda s, d: ioc.merged(ioc.of_findings(found(s, d))).withColumn("tags", F.array_join("tags", ",")),
    "enrich_reputation": _reputation,
    "enrich_geo": _geo,
    "rate_windows": jobs.rate_query,
    "tf_idf": lambda s, d: text.tf_idf(_docs(s, d)).withColumn("weight", F.round("weight", 6)),
    "keyword_search": lambda s, d: text.keyword_search(_docs(s, d), ["license", "password", "token"]),
    "cosine_top": _cosine,
    "document_ids": lambda s, d: _docs(s, d).select("doc_id", text.document_id("source", "lang", F.col("doc_id").cast("string")).alias("id")),
}
