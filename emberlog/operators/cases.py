"""Case work: evidence, ledgers, playbooks, decoys, object tables, exports, digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import core
from . import detect, ioc, matching, shared

#: who findings and exports are told by
OWNER = "emberlog"

# --- evidence ----------------------------------------------------------------------


def file_facts(spark, path: str) -> DataFrame:
    """path, size, extension, lines_guess (200 bytes a line), sha256, sha1, md5, is_binary (over 30 % control bytes in the first KiB)."""
    f = spark.read.format("binaryFile").load(path)
    head = F.hex(F.substring("content", 1, 1024))
    control = F.size(F.regexp_extract_all(head, F.lit("(?:..)*?(0[0-8BCEF]|1[0-9A-F])"), 1))
    return f.select("path", F.col("length").alias("size"), F.nullif(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1), F.lit("")).alias("extension"), F.floor(F.col("length") / 200).alias("lines_guess"), F.sha2("content", 256).alias("sha256"), F.sha1("content").alias("sha1"), F.md5("content").alias("md5"), (control > 0.3 * F.least(F.col("length"), F.lit(1024))).alias("is_binary"))


def integrity(evidence: DataFrame, current: DataFrame) -> DataFrame:
    """path and state of each piece of evidence (path, sha256) against the hashes now: verified, changed or missing."""
    now = current.select("path", F.col("sha256").alias("_now"))
    state = F.when(F.col("_now").isNull(), "missing").when(F.col("_now") == F.col("sha256"), "verified").otherwise("changed")
    return evidence.join(now, "path", "left").withColumn("state", state).drop("_now")


def trust(states: DataFrame, key: str = "session_id") -> DataFrame:
    """key, counts and status: compromised with a change, warning with something missing, trusted else."""
    n = lambda s: F.count(F.when(F.col("state") == s, 1)).alias(s)
    out = states.groupBy(key).agg(n("verified"), n("changed"), n("missing"))
    return out.withColumn("status", F.when(F.col("changed") > 0, "compromised").when(F.col("missing") > 0, "warning").when(F.col("verified") > 0, "trusted").otherwise("no_evidence"))


def new_entries(ledger: DataFrame, more: DataFrame, key: str = "sha256") -> DataFrame:
    """The ledger with the entries of another whose hash it has not yet."""
    return ledger.unionByName(more.join(ledger.select(key), key, "left_anti").select(*ledger.columns))


# --- playbooks ---------------------------------------------------------------------

# Categories whose playbook is another's
ALIASES = {
    "api_security": "web_attack", "bot_activity": "web_attack", "recon": "default", "discovery": "default", "defense_evasion": "persistence", "impact": "malware", "insider_threat": "auth_attack",
    "cloud_container_attack": "default", "supply_chain": "malware", "living_off_land": "privilege_escalation", "network_protocol": "lateral_movement",
}


def playbook_steps(found: DataFrame, steps: DataFrame) -> DataFrame:
    """The steps (category, phase, step) of each finding's category, by its other name where it has one; of the default where there are none."""
    known = shared.small(steps.select(F.col("category").alias("_c"), "phase", "step"))
    have = shared.small(steps.select(F.col("category").alias("_k")).distinct())
    name = core.lookup(ALIASES, "category")
    rows = found.select("id", "category", F.coalesce(name, F.col("category")).alias("_n")).join(have, F.col("_n") == F.col("_k"), "left")
    return rows.withColumn("_use", F.coalesce("_k", F.lit("default"))).join(known, F.col("_use") == F.col("_c")).select("id", "category", "phase", "step")


# --- decoys ------------------------------------------------------------------------


def decoy_hits(events: DataFrame, decoys: DataFrame) -> DataFrame:
    """Events whose line holds a decoy's value, whatever its case and whatever stands beside it: one row for each event and token.

    decoys: token_id, value; empty and null values are never found. See matching.containing for how.
    """
    own = decoys.select("token_id", F.lower("value").alias("value")).distinct()
    hit = matching.containing(events.select("line_number", "source_file", "source_ip", "us", "raw_line"), own, "raw_line", ["source_file", "line_number"])
    hit = hit.join(own, "value").select("token_id", "line_number", "source_file", "source_ip", "us").distinct()
    return hit.select("*", F.lit("CANARY-001").alias("rule_id"), F.lit("HIGH").alias("severity"), F.lit("insider_threat").alias("category"), F.lit(9.0).alias("risk_score"), F.lit("T1005").alias("technique"))


def decoy_counts(events: DataFrame, decoys: DataFrame) -> DataFrame:
    """token_id, n, first_line of decoy_hits: the number of distinct lines that hold a token's value, and the first of them.

    Counted by value, not by token, so tokens of one value cost no more than one. Tokens of several values are looked for as decoy_hits does, as a
    line may hold more than one of those; so are all tokens where line numbers are given twice, or values are too many to be broadcast.
    """
    own = shared.written(decoys.select("token_id", F.lower("value").alias("value")).where("value <> ''").distinct(), "decoys")
    several = own.groupBy("token_id").agg(F.count("*").alias("k")).where("k > 1").select("token_id")
    one = own.join(several, "token_id", "left_anti")
    lines = shared.spread(events)
    twice = not events.groupBy("line_number").count().where("count > 1").isEmpty()
    by_value = None if twice else matching.lines_of_values(lines, one, "raw_line", "line_number")
    rest = own if by_value is None else own.join(several, "token_id", "left_semi")
    slow = decoy_hits(lines, rest).groupBy("token_id").agg(F.countDistinct("line_number").alias("n"), F.min("line_number").alias("first_line"))
    if by_value is None:
        return slow
    fast = one.join(by_value, "value").select("token_id", "n", F.col("first").cast(slow.schema["first_line"].dataType).alias("first_line"))
    return fast if rest.isEmpty() else fast.unionByName(slow)


# --- observed data, actors, objects ------------------------------------------------


def observed(found: DataFrame, rules: int = 10) -> DataFrame:
    """source_ip, first_us, last_us, n, high (findings of HIGH or above), rules: its first names in order, mean_confidence."""
    names = F.array_join(F.slice(F.array_sort(F.collect_set("rule_id")), 1, rules), ",")
    return found.where("source_ip is not null").groupBy("source_ip").agg(
        F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.count("*").alias("n"), F.count(F.when(core.severity_rank("severity") >= 3, 1)).alias("high"), names.alias("rules"), F.round(core.exact_mean("confidence", 4), 6).alias("mean_confidence"),
    )


def object_id(kind: str, *parts):
    """An id that is a hash of what names the object."""
    h = F.sha2(F.concat_ws(":", F.lit(kind), *parts), 256)
    return F.concat(F.lit(f"{kind}--"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-"), F.substring(h, 13, 4), F.lit("-"), F.substring(h, 17, 4), F.lit("-"), F.substring(h, 21, 12))


def stix_objects(found: DataFrame) -> DataFrame:
    """id, type, name, body (JSON): attack patterns, actors (sources of HIGH findings and above), indicators, observed data."""
    body = lambda *c: F.to_json(F.struct(*c))
    patterns = found.select(F.explode("mitre_ids").alias("t")).distinct().select(object_id("attack-pattern", "t").alias("id"), F.lit("attack-pattern").alias("type"), F.col("t").alias("name"), body(F.col("t").alias("external_id")).alias("body"))
    seen = observed(found)
    actors = seen.where("high > 0").select(object_id("threat-actor", "source_ip").alias("id"), F.lit("threat-actor").alias("type"), F.col("source_ip").alias("name"), body("n", "high", "mean_confidence").alias("body"))
    data = seen.select(object_id("observed-data", "source_ip").alias("id"), F.lit("observed-data").alias("type"), F.col("source_ip").alias("name"), body("first_us", "last_us", "n").alias("body"))
    i = ioc.merged(ioc.of_findings(found))
    marks = i.select(object_id("indicator", "type", "value").alias("id"), F.lit("indicator").alias("type"), F.col("value").alias("name"), body(ioc.stix_pattern("type", "value").alias("pattern"), (F.col("confidence") * 100).cast("int").alias("confidence")).alias("body"))
    return patterns.unionByName(actors).unionByName(data).unionByName(marks)


def stix_relationships(found: DataFrame) -> DataFrame:
    """source, relation, target: actors use attack patterns."""
    high = found.where(core.severity_rank("severity") >= 3).where("source_ip is not null").select("source_ip", F.explode("mitre_ids").alias("t")).distinct()
    return high.select(object_id("threat-actor", "source_ip").alias("source"), F.lit("uses").alias("relation"), object_id("attack-pattern", "t").alias("target"))


# --- exports, digests --------------------------------------------------------------

# Names of kinds, and categories, in two of the layouts
ZEEK_TYPES = {
    "ipv4": "Intel::ADDR", "domain": "Intel::DOMAIN", "hostname": "Intel::DOMAIN", "url": "Intel::URL", "email": "Intel::EMAIL", "hash_md5": "Intel::FILE_HASH", "hash_sha1": "Intel::FILE_HASH", "hash_sha256": "Intel::FILE_HASH",
    "file_path": "Intel::FILE_NAME", "user_agent": "Intel::SOFTWARE", "process": "Intel::SOFTWARE",
}
MISP_TYPES = {"ipv4": "ip-src", "domain": "domain", "url": "url", "hash_md5": "md5", "hash_sha1": "sha1", "hash_sha256": "sha256", "file_path": "filename", "email": "email-src", "hostname": "hostname", "user_agent": "user-agent", "process": "filename"}
MISP_CATEGORIES = {
    "ipv4": "Network activity", "domain": "Network activity", "url": "Network activity", "hash_md5": "Payload delivery", "hash_sha1": "Payload delivery", "hash_sha256": "Payload delivery",
    "file_path": "Artifacts dropped", "email": "Social network", "hostname": "Network activity", "user_agent": "Network activity", "process": "Artifacts dropped",
}


def layout(indicators: DataFrame, kind: str, case: str = "", exported: str = "") -> DataFrame:
    """Merged indicators in the columns of an export: csv, tsv, zeek or misp. Kinds that a layout has no name for are left out of it.

    Rule, address and time are empty where the indicators have none; case and exported name the case and the time of the export, ISO 8601.
    """
    have = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in indicators.columns else F.lit("")
    time = F.date_format(F.timestamp_micros("us"), "yyyy-MM-dd'T'HH:mm:ss'Z'") if "us" in indicators.columns else F.lit(None).cast("string")
    value, rule, percent = F.regexp_replace("value", r"[\n\r\t]", " "), have("source_rule"), F.format_string("%.0f%%", F.col("confidence") * 100)
    if kind in ("csv", "tsv"):
        out = indicators.select("type", value.alias("value"), F.format_string("%.3f", "confidence").alias("confidence"), rule.alias("source_rule"), have("source_ip").alias("source_ip"), F.coalesce(time, F.lit("")).alias("timestamp"), F.array_join("tags", "|").alias("tags"))
        return out.withColumns({"case_ref": F.lit(case), "exported_at": F.lit(exported)}) if kind == "csv" else out
    if kind == "zeek":
        told = F.concat(F.lit(f"{OWNER} case {case} | rule:"), rule, F.lit(" | conf:"), percent)
        name = core.lookup(ZEEK_TYPES, "type")
        return indicators.where(name.isNotNull()).select(value.alias("indicator"), name.alias("indicator_type"), F.lit(f"{OWNER}/{case}").alias("meta.source"), told.alias("meta.desc"), F.lit("-").alias("meta.url"), F.lit("T").alias("meta.do_notice"))
    if kind != "misp":
        raise ValueError(f"no layout {kind!r}")
    name = core.lookup(MISP_TYPES, "type")
    told = F.concat(F.lit(f"{OWNER} | Case:{case} | Rule:"), rule, F.lit(" | Conf:"), percent)
    uuid = F.substring(object_id("x", "type", F.lower("value")), 4, 36)
    return indicators.where(name.isNotNull()).select(
        uuid.alias("uuid"), F.lit("").alias("event_id"), core.lookup(MISP_CATEGORIES, "type", "External analysis").alias("category"), name.alias("type"), value.alias("value"), told.alias("comment"),
        F.lit("1").alias("to_ids"), F.lit("0").alias("distribution"), F.coalesce(time, F.lit(exported)).alias("timestamp"),
    )


def export(indicators: DataFrame, path: str, case: str = "", exported: str = "") -> None:
    """One directory for each layout, and JSON lines with the case."""
    for kind, options in (("csv", {"quoteAll": True}), ("tsv", {"sep": "\t", "quote": ""}), ("zeek", {"sep": "\t", "quote": ""}), ("misp", {"quoteAll": True})):
        layout(indicators, kind, case, exported).write.mode("overwrite").options(header=True, **options).csv(f"{path}/{kind}")
    indicators.withColumns({"case_ref": F.lit(case), "exported_at": F.lit(exported)}).write.mode("overwrite").json(f"{path}/jsonl")


def case_numbers(found: DataFrame, most: int = 20, names: int = 10) -> DataFrame:
    """session_id, findings, max_risk, and its distinct addresses, hosts and users in order, at most most of each, and tactics and categories, at most names of each.

    Distinct values are ranked, and only those that stay are collected.
    """
    limits = {"source_ip": most, "hostname": most, "username": most, "tactic": names, "category": names}
    one = lambda k: F.struct(F.lit(k).alias("kind"), F.col(k).alias("name"))
    told = F.concat(F.array(*[one(k) for k in limits if k != "tactic"]), F.transform("tactic_names", lambda t: F.struct(F.lit("tactic").alias("kind"), t.alias("name"))))
    each = found.select("session_id", F.explode(told).alias("x")).select("session_id", "x.*").where("name is not null").distinct()
    ranked = each.withColumn("r", F.row_number().over(Window.partitionBy("session_id", "kind").orderBy("name"))).where(F.col("r") <= core.lookup(limits, "kind"))
    lists = ranked.groupBy("session_id").agg(*[F.array_join(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.col("name")))), ",").alias(k) for k in limits])
    return found.groupBy("session_id").agg(F.count("*").alias("findings"), F.max("risk_score").alias("max_risk")).join(lists, "session_id", "left")


def context(found: DataFrame, k: int = 10, width: int = 4000) -> DataFrame:
    """One row: the k findings of most risk as numbered lines, cut to width."""
    w = Window.orderBy(F.desc("risk_score"), F.desc("us"), "line_number", "rule_id")
    top = found.orderBy(F.desc("risk_score"), F.desc("us"), "line_number", "rule_id").limit(k).withColumn("i", F.row_number().over(w))
    line = F.format_string("[%d] %s %s %s risk %.2f", F.col("i"), F.col("rule_id"), F.col("severity"), F.coalesce("source_ip", F.lit("-")), F.col("risk_score"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", line.alias("line")))), lambda x: x["line"]), "\n")
    return top.agg(F.substring(text, 1, width).alias("context"))


def digest(found: DataFrame, width: int = 8000, lines: int = 200) -> DataFrame:
    """One row: the gravest findings as lines, cut to width. Only as many findings are taken as can fill it."""
    keys = [F.desc(core.severity_rank("severity")), F.desc("risk_score"), F.asc("line_number"), F.asc("rule_id")]
    top = found.orderBy(*keys).limit(lines).withColumn("i", F.row_number().over(Window.orderBy(*keys)))
    line = F.format_string("[%s] %s (%s) | IP:%s | Host:%s | Risk:%.1f | MITRE:%s | %s", "severity", "rule_id", "rule_name", F.coalesce("source_ip", F.lit("")), F.coalesce("hostname", F.lit("")), "risk_score", F.array_join("mitre_ids", ", "), F.substring("raw_line", 1, 200))
    return top.agg(F.substring(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", line.alias("line")))), lambda x: x["line"]), "\n"), 1, width).alias("digest"))


def technique_rows(found: DataFrame, k: int = 5, top: int = 30) -> DataFrame:
    """technique, n, max_risk, top_severity, and its k most frequent rules and sources."""
    rows = found.select(F.explode("mitre_ids").alias("technique"), "risk_score", "severity", "rule_id", "source_ip")
    out = rows.groupBy("technique").agg(F.count("*").alias("n"), F.max("risk_score").alias("max_risk"), F.element_at(F.array(*map(F.lit, core.SEVERITIES)), F.max(core.severity_rank("severity")) + 1).alias("top_severity"))
    out = out.orderBy(F.desc("n"), "technique").limit(top)
    for c in ("rule_id", "source_ip"):
        n = rows.where(F.col(c).isNotNull()).groupBy("technique", c).agg(F.count("*").alias("n"))
        rank = F.row_number().over(Window.partitionBy("technique").orderBy(F.desc("n"), c))
        best = n.select("technique", c, rank.alias("r")).where(F.col("r") <= k).groupBy("technique").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", c))), lambda x: x[c]), ",").alias(f"top_{c}"))
        out = out.join(best, "technique", "left")
    return out


def ledger_summary(entries: DataFrame) -> DataFrame:
    """Totals of a ledger (sha256, size, analyst, session_id, added_us)."""
    return entries.agg(F.count("*").alias("entries"), F.sum("size").alias("bytes"), F.countDistinct("analyst").alias("analysts"), F.countDistinct("session_id").alias("sessions"), F.min("added_us").alias("oldest"), F.max("added_us").alias("newest"))


def hints(found: DataFrame) -> DataFrame:
    """rule_id and what the first trigger line of each rule shows: addresses, request paths, quoted texts, event numbers, users, processes."""
    # The patterns
    every = lambda p, k=1: F.regexp_extract_all("raw_line", F.lit(p), k)
    first = found.groupBy("rule_id", "category").agg(F.min_by("raw_line", "line_number").alias("raw_line"))
    return first.select(
        "rule_id", "category", core.ipv4s_in("raw_line").alias("addresses"), every(r"(?:GET|POST|PUT|DELETE|HEAD)\s+(\S+)").alias("paths"), every(r'"([^"]{3,80})"').alias("quoted"),
        every(r"(?i)EventID[=:\s]+(\d+)").alias("event_ids"), every(r"(?i)(?:user|username|account)[=:\s]+(\S+)").alias("users"), every(r"(?i)(?:process|image|commandline)[=:\s]+([^\s,;]+)").alias("processes"),
    )


def signed(entries: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Ledger entries with entry_hmac, the HMAC-SHA256 of their columns as JSON; a null column is left out of it."""
    return entries.withColumn("entry_hmac", _hmac(key, F.to_json(F.struct(*sorted(columns)))))


def _hmac(key: str, text) -> Column:
    import hashlib

    raw = key.encode()
    raw = (hashlib.sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
    pad = lambda x: F.lit(bytearray(b ^ x for b in raw))
    inner = F.unhex(F.sha2(F.concat(pad(0x36), text.cast("binary")), 256))
    return F.sha2(F.concat(pad(0x5C), inner), 256)


def verified(entries: DataFrame, current: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """entry_id, hmac_ok, file_ok, verified and error of each ledger entry: its signature, and its file's hash against that now (path, sha256)."""
    now = current.select(F.col("path").alias("file_path"), F.col("sha256").alias("_now"))
    ok = F.coalesce(_hmac(key, F.to_json(F.struct(*sorted(columns)))) == F.col("entry_hmac"), F.lit(False))
    file_ok = F.coalesce(F.col("_now") == F.col("sha256"), F.lit(False))
    out = entries.withColumn("hmac_ok", ok).join(now, "file_path", "left").withColumn("file_ok", file_ok)
    error = F.when(F.col("_now").isNull(), "missing").when(~F.col("hmac_ok"), "tampered").when(~F.col("file_ok"), "modified")
    return out.select("entry_id", "hmac_ok", "file_ok", (F.col("hmac_ok") & F.col("file_ok")).alias("verified"), error.alias("error"))


# --- time --------------------------------------------------------------------------


def with_years(lines: DataFrame, first_year: int, key: str = "source_file") -> DataFrame:
    """Lines with month numbers as they stand in files without years: each step back from December to January adds a year."""
    w = Window.partitionBy(key).orderBy("line_number")
    step = F.coalesce((F.lag("month").over(w) == 12) & (F.col("month") == 1), F.lit(False)).cast("int")
    return lines.withColumn("_s", step).withColumn("year", first_year + F.sum("_s").over(w)).drop("_s")


def sessions(found: DataFrame, today: str) -> DataFrame:
    """session_id, n, top_severity and day label: today, yesterday, this week or earlier."""
    days = F.datediff(F.lit(today).cast("date"), F.col("session_id").cast("date"))
    top = F.element_at(F.array(*map(F.lit, core.SEVERITIES)), F.max(core.severity_rank("severity")) + 1)
    out = found.groupBy("session_id").agg(F.count("*").alias("n"), top.alias("top_severity"))
    return out.withColumn("label", F.when(days == 0, "today").when(days == 1, "yesterday").when(days < 7, "this week").otherwise("earlier"))


# --- selections by field -----------------------------------------------------------


def selection(fields: dict, mapping: dict | None = None):
    """A column from a selection: all fields must meet one of their literals, * and ? are wildcards; |contains, |startswith, |endswith as modifiers."""
    out = F.lit(True)
    for name, values in fields.items():
        field, _, modifier = name.partition("|")
        one = F.lit(False)
        for v in values if isinstance(values, list) else [values]:
            p = "".join(".*" if ch == "*" else "." if ch == "?" else "\\" + ch if not ch.isalnum() and ch.isascii() else ch for ch in str(v))
            p = {"contains": f".*{p}.*", "startswith": f"{p}.*", "endswith": f".*{p}"}.get(modifier, p)
            one = one | F.coalesce(F.col((mapping or {}).get(field, field)).cast("string").rlike(f"(?is)^{p}$"), F.lit(False))
        out = out & one
    return out


def condition(text: str, selections: dict[str, dict], mapping: dict | None = None):
    """A column from a condition over named selections: names, and, or, not, parentheses, 1 of them, all of them, 1 of name*, all of name*."""
    import re as _re

    names = {k: selection(v, mapping) if isinstance(v, dict) else _any([selection(x, mapping) for x in v]) for k, v in selections.items()}
    words = _re.findall(r"\(|\)|(?:1|all) of [\w*]+|[\w*]+", text)
    at = 0

    def term():
        nonlocal at
        w = words[at]
        at += 1
        if w == "not":
            return ~term()
        if w == "(":
            out = either()
            at += 1
            return out
        if " of " in w:
            how, pattern = w.split(" of ")
            own = [c for k, c in names.items() if pattern == "them" or _re.fullmatch(pattern.replace("*", ".*"), k)]
            return _any(own) if how == "1" else _every(own)
        return names[w]

    def both():
        nonlocal at
        out = term()
        while at < len(words) and words[at] == "and":
            at += 1
            out = out & term()
        return out

    def either():
        nonlocal at
        out = both()
        while at < len(words) and words[at] == "or":
            at += 1
            out = out | both()
        return out

    return either()


def _any(columns):
    out = F.lit(False)
    for c in columns:
        out = out | c
    return out


def _every(columns):
    out = F.lit(True)
    for c in columns:
        out = out & c
    return out


#: formats of a product or service that rules name as their source
LOG_SOURCES = {
    "windows": ["windows_evtx", "windows_sysmon", "powershell_script"], "linux": ["syslog", "auth_log", "auditd", "journald"], "webserver": ["apache_combined", "nginx_access", "iis_w3c"],
    "aws": ["aws_cloudtrail"], "azure": ["azure_activity", "azure_signin"], "gcp": ["gcp_audit"], "zeek": ["zeek_conn", "zeek_dns", "zeek_http", "zeek_ssl"],
}


def from_source(product: str | None):
    """Whether an event's format is one of a product's; any for none or for one that isn't known."""
    known = LOG_SOURCES.get((product or "").lower())
    return F.col("log_format").isin(known) if known else F.lit(True)
