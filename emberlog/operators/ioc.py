"""Indicators from text and findings: extraction, merging, filtering, enrichment, layouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import core
from . import shared

# Kind, pattern, and what it multiplies the finding's confidence by. Patterns are read by RE2 and by Java alike;
# digits are ASCII's, as (?i) makes letters of either case equal.
KINDS = [
    ("hash_sha256", r"\b[a-fA-F0-9]{64}\b", 1.0),
    ("hash_sha1", r"\b[a-fA-F0-9]{40}\b", 1.0),
    ("hash_md5", r"\b[a-fA-F0-9]{32}\b", 0.8),
    ("file_path", r'[A-Za-z]:\\(?:[^\\/:*?"<>|\r\n]+\\)*[^\\/:*?"<>|\r\n]*', 0.7),
    ("file_path", r"(?:^|[^A-Za-z0-9_])(/(?:etc|var|tmp|home|usr|bin|sbin|proc|dev)(?:/[^\s'\"<>|;,]{1,100})+)", 0.7),
    ("email", r"\b[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}\b", 0.8),
    ("ipv4", r"\b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\b", 0.75),
    ("domain", r"(?i)\b(?:[a-z0-9](?:[a-z0-9\-]{0,61}[a-z0-9])?\.)+(?:com|net|org|io|gov|edu|mil|co|uk|de|fr|ru|cn|info|biz|xyz|onion|bit|tk|ml|ga|cf|pw|top|club|site|online|live|tech)\b", 0.7),
]
# What a text must hold for a pattern to be found in it, cheaper to look for; and the places in KINDS that it goes for
HINTS = [
    ("[a-fA-F0-9]{32}", (0, 1, 2)), (r":\\", (3,)), ("/(?:etc|var|tmp|home|usr|bin|sbin|proc|dev)/", (4,)), ("@", (5,)), (r"[0-9]\.[0-9]", (6,)),
    (r"(?i)\.(?:com|net|org|io|gov|edu|mil|co|uk|de|fr|ru|cn|info|biz|xyz|onion|bit|tk|ml|ga|cf|pw|top|club|site|online|live|tech)\b", (7,)),
]
# Addresses in a request, scanners' names, names of processes worth keeping
URL = r"(?i)https?://[^\s'\"<>]{4,200}"
SCANNERS = r"(?i)(sqlmap|nikto|nessus|masscan|nmap|zgrab|nuclei|dirbuster|gobuster|feroxbuster|ffuf|hydra|medusa|burpsuite|metasploit|acunetix|w3af|arachni|appscan)"
PROCESSES = r"(?i)(mimikatz|meterpreter|cobalt.*strike|beacon|powersploit|empire|sliver|havoc|metasploit|nc\.exe|ncat\.exe|netcat|xmrig|psexec|wmiexec|dcomexec|atexec|smbexec)"
# What an indicator of each kind says
INDICATOR_TYPES = {
    "ipv4": ["malicious-activity"], "domain": ["malicious-activity", "compromised"], "url": ["malicious-activity"], "hash_md5": ["malicious-activity"], "hash_sha1": ["malicious-activity"], "hash_sha256": ["malicious-activity"],
    "file_path": ["malicious-activity"], "email": ["attribution"], "hostname": ["compromised"], "process": ["malicious-activity"], "user_agent": ["malicious-activity", "attribution"],
}
LOWER = ("hash_sha256", "hash_sha1", "hash_md5", "email", "domain")


def _values(x: Column, pattern: str) -> Column:
    return F.array_distinct(F.regexp_extract_all(x, F.lit(pattern), 1 if "(/(?:etc" in pattern else 0))


def _kept(i) -> Column:
    """Not a reserved address, not a domain of four characters or fewer."""
    return ((i["type"] != "ipv4") | ~core.is_not_routable(i["value"])) & ((i["type"] != "domain") | (F.length(i["value"]) > 4))


def extract(rows: DataFrame, text: str, confidence: Column, *carried: str) -> DataFrame:
    """type, value, confidence and carried columns: a row for each distinct value of each kind in a text.

    A shorter hash is none where a longer one begins with it, which word bounds already rule out; hashes, mail addresses and
    domains are in lower case.
    """
    x = F.coalesce(F.col(text), F.lit(""))

    def one(kind, pattern, weight):
        values = _values(x, pattern)
        values = F.array_distinct(F.transform(values, F.lower)) if kind in LOWER else values
        return F.transform(values, lambda v: F.struct(F.lit(kind).alias("type"), v.alias("value"), (confidence * weight).alias("confidence")))

    none = F.array().cast("array<struct<type:string,value:string,confidence:double>>")
    found = F.filter(F.concat(*[F.when(x.rlike(hint), F.concat(*[one(*KINDS[i]) for i in places])).otherwise(none) for hint, places in HINTS]), _kept)
    return rows.select(*carried, F.explode(found).alias("i")).select("i.*", *carried)


def merged(indicators: DataFrame) -> DataFrame:
    """One row for each type and value whatever its case: the highest confidence, the value as its row has it (ties by value), number of rows, union of tags, and that row's rule, source and time where there are such columns."""
    have = [c for c in ("source_rule", "source_ip", "us") if c in indicators.columns]
    tags = F.array_sort(F.array_distinct(F.flatten(F.collect_set("tags")))) if "tags" in indicators.columns else F.array().cast("array<string>")
    best = F.min_by(F.struct("value", *have), F.struct((-F.col("confidence")).alias("c"), "value", *have))
    out = indicators.groupBy("type", F.lower("value").alias("_key")).agg(best.alias("_b"), F.max("confidence").alias("confidence"), F.count("*").alias("n"), tags.alias("tags"))
    return out.select("type", "_b.value", "confidence", "n", "tags", *(f"_b.{c}" for c in have))


def filtered(indicators: DataFrame, types=None, min_confidence: float = 0.0, rule: str | None = None, tag: str | None = None, drop_private: bool = False) -> DataFrame:
    """The indicators that meet every condition given: kinds, confidence, part of the rule's id, part of a tag, no private addresses."""
    out = indicators.where(F.col("confidence") >= min_confidence)
    out = out.where(F.col("type").isin(*types)) if types else out
    out = out.where(F.lower("source_rule").contains(rule.lower())) if rule else out
    out = out.where((F.col("type") != "ipv4") | ~core.is_not_routable("value")) if drop_private else out
    return out.where(F.exists("tags", lambda t: F.lower(t).contains(tag.lower()))) if tag else out


def of_findings(found: DataFrame) -> DataFrame:
    """type, value, confidence, source_rule, source_ip, us, tags: indicators of findings, tagged by category, techniques and event number.

    Addresses, host, suspicious process, scanner; addresses and domains in the request; and what the trigger line, matched text,
    message and supporting lines hold.
    """
    have = lambda c: F.col(c).cast("string") if c in found.columns else F.lit(None).cast("string")
    event = F.when(have("event_id").isNotNull(), F.array(F.concat(F.lit("EventID:"), have("event_id")))).otherwise(F.array().cast("array<string>"))
    lines = F.array_join("supporting_lines", " ") if "supporting_lines" in found.columns else F.lit(None).cast("string")
    conf = F.col("confidence")
    rows = found.select(
        F.col("rule_id").alias("source_rule"), "source_ip", "us", F.concat(F.array("category"), "mitre_ids", event).alias("tags"), conf.alias("_c"), F.concat_ws(" ", "raw_line", have("matched_text"), have("message"), lines).alias("_text"),
        have("dest_ip").alias("_dest"), have("hostname").alias("_host"), have("process_name").alias("_process"), have("http_user_agent").alias("_agent"), F.coalesce(have("http_uri_decoded"), F.lit("")).alias("_uri"),
    )
    one = lambda t, v, c, ok: F.when(ok, F.struct(F.lit(t).alias("type"), F.col(v).alias("value"), c.alias("confidence")))
    c = F.col("_c")
    named = F.array_compact(F.array(
        one("ipv4", "source_ip", c, F.col("source_ip").isNotNull() & ~core.is_not_routable("source_ip")),
        one("ipv4", "_dest", F.when(F.col("_dest") == F.col("source_ip"), c).otherwise(c * 0.9), F.col("_dest").isNotNull() & ~core.is_not_routable("_dest")),
        one("hostname", "_host", c * 0.85, (F.col("_host") != "") & ~core.is_ipv4("_host")),
        one("process", "_process", F.least(c + 0.05, F.lit(1.0)), F.col("_process").rlike(PROCESSES)),
        one("user_agent", "_agent", F.least(c + 0.1, F.lit(1.0)), F.col("_agent").rlike(SCANNERS)),
    ))
    urls = F.transform(_values(F.col("_uri"), URL), lambda v: F.struct(F.lit("url").alias("type"), F.substring(v, 1, 500).alias("value"), c.alias("confidence")))
    domains = F.transform(F.array_distinct(F.transform(_values(F.col("_uri"), KINDS[-1][1]), F.lower)), lambda v: F.struct(F.lit("domain").alias("type"), v.alias("value"), (c * 0.8).alias("confidence")))
    carried = ["source_rule", "source_ip", "us", "tags"]
    fields = rows.select(F.explode(F.concat(named, urls, F.filter(domains, _kept))).alias("i"), *carried).select("i.*", *carried)
    out = fields.unionByName(extract(rows, "_text", c, *carried))
    return out.withColumn("confidence", F.round("confidence", 3))


def reputation_of(indicators: DataFrame, reputation: DataFrame, least: float = 25.0) -> DataFrame:
    """Addresses among the indicators meet an offline table (ip, score 0-100, country): confidence grows by up to 0.2 and tags say so from the least score on; the country is a tag."""
    r = reputation.select(F.col("ip").alias("_ip"), F.col("score").alias("_score"), F.col("country").alias("_country"))
    out = indicators.join(r, (F.col("type") == "ipv4") & (F.col("value") == F.col("_ip")), "left")
    bad = F.coalesce(F.col("_score") >= least, F.lit(False))
    none = F.array().cast("array<string>")
    tags = F.concat("tags", F.when(bad, F.array(F.lit("known_bad_ip"), F.concat(F.lit("abuse_score:"), F.col("_score").cast("int").cast("string")))).otherwise(none), F.when(F.coalesce("_country", F.lit("")) != "", F.array(F.concat(F.lit("country:"), "_country"))).otherwise(none))
    out = out.withColumn("confidence", F.when(bad, F.least(F.col("confidence") + F.col("_score") / 100 * 0.2, F.lit(1.0))).otherwise(F.col("confidence"))).withColumn("tags", F.array_distinct(tags))
    return out.drop("_ip", "_score", "_country")


def with_feeds(indicators: DataFrame, engines: DataFrame, pulses: DataFrame, urls: DataFrame, samples: DataFrame) -> DataFrame:
    """Indicators with threat_score and verdict from offline feeds: engines (value, detected, total, reputation), pulses (value, pulses), hosts of bad addresses and hashes of samples (value)."""
    one = lambda t, name: t.select(F.lower("value").alias("_key")).distinct().withColumn(name, F.lit(True))
    out = indicators.withColumn("_key", F.lower("value"))
    for t in (engines.withColumn("_key", F.lower("value")).drop("value"), pulses.withColumn("_key", F.lower("value")).drop("value"), one(urls, "_url"), one(samples, "_sample")):
        out = out.join(t, "_key", "left")
    score = threat_score("detected", "total", "reputation", "pulses", "_url", "_sample")
    verdict = F.when(F.col("threat_score") < 4, "clean").when(F.col("threat_score") < 7, "suspicious").otherwise("malicious")
    return out.withColumn("threat_score", score).withColumn("verdict", verdict).drop("_key", "_url", "_sample", "detected", "total", "reputation", "pulses")


def summary(indicators: DataFrame, top: int = 5) -> DataFrame:
    """kind, name, n, mean_confidence: all (total), each type, and the rules with most indicators."""
    rows = indicators.select("confidence", F.explode(F.array(F.struct(F.lit("total").alias("kind"), F.lit("all").alias("name")), F.struct(F.lit("type").alias("kind"), F.col("type").alias("name")), F.struct(F.lit("rule").alias("kind"), F.col("source_rule").alias("name")))).alias("k"))
    out = rows.where("k.name is not null").groupBy("k.kind", "k.name").agg(F.count("*").alias("n"), F.round(core.exact_mean("confidence", 6), 3).alias("mean_confidence"))
    rank = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("n"), "name"))
    return out.withColumn("_r", rank).where((F.col("kind") != "rule") | (F.col("_r") <= top)).drop("_r")


def with_reputation(rows: DataFrame, reputation: DataFrame, ip: str = "source_ip", least: float = 25.0) -> DataFrame:
    """Left join to an offline table (ip, score 0-100): from the least score on confidence grows by up to 0.15, known_bad is set, and rule_tags, with what it held, has known_malicious_ip."""
    r = reputation.select(F.col("ip").alias("_ip"), F.col("score").alias("reputation"))
    out = rows.join(r, rows[ip] == F.col("_ip"), "left").drop("_ip")
    bad = F.coalesce(F.col("reputation") >= least, F.lit(False))
    more = F.when(bad, F.least(F.col("reputation") / 100 * 0.15, F.lit(0.15))).otherwise(0.0)
    none = F.array().cast("array<string>")
    tags = F.array_union(F.coalesce("rule_tags", none) if "rule_tags" in rows.columns else none, F.when(bad, F.array(F.lit("known_malicious_ip"))).otherwise(none))
    return out.withColumn("known_bad", bad).withColumn("rule_tags", tags).withColumn("confidence", F.least(F.lit(1.0), F.col("confidence") + more))


def with_geo(rows: DataFrame, networks: DataFrame, ip: str = "source_ip") -> DataFrame:
    """Left range join to networks (lo, hi, and columns such as country, city, asn, tor), by an equal join on the /16 that address and network share; private addresses stay null.

    geo_tags: country:, and tor_exit for exit nodes. Networks must not overlap; one wider than a /16 is taken once for each /16 in it. They are counted, and
    broadcast where few.
    """
    told = [c for c in networks.columns if c not in ("lo", "hi")]
    n = networks.select("lo", "hi", *told, F.explode(F.sequence(F.shiftright("lo", 16), F.shiftright("hi", 16))).alias("_b"))
    number = F.when(~core.is_internal(ip), core.ip_number(ip))
    out = rows.select("*", number.alias("_n"), F.shiftright(number, 16).alias("_k"))
    out = out.join(shared.small(n), (F.col("_k") == F.col("_b")) & F.col("_n").between(F.col("lo"), F.col("hi")), "left").drop("_n", "_k", "_b", "lo", "hi")
    tor = core.is_tor_exit(ip) | (F.coalesce(F.col("tor"), F.lit(False)) if "tor" in told else F.lit(False))
    return out.withColumn("geo_tags", F.array_compact(F.array(F.when(F.coalesce("country", F.lit("")) != "", F.concat(F.lit("country:"), "country")), F.when(tor, "tor_exit"))))


def threat_score(detected, total, reputation, pulses, in_urlhaus, in_bazaar) -> Column:
    """0 to 10 from feeds: the greatest of what each says."""
    c = core.c
    pulse = F.when(c(pulses) > 5, F.least(c(pulses) / 2, F.lit(8.0))).when(c(pulses) > 0, 4.0)
    return F.round(F.coalesce(F.greatest(
        F.when(c(total) > 0, c(detected) / c(total) * 10), F.when(c(reputation) < -50, 7.0), pulse,
        F.when(c(in_urlhaus), 7.0), F.when(c(in_bazaar), 8.0), F.lit(0.0)), F.lit(0.0)), 4)


def stix_pattern(kind, value) -> Column:
    v = F.regexp_replace(F.regexp_replace(core.c(value), r"\\", r"\\\\"), "'", r"\\'")
    name = core.lookup({"ipv4": "ipv4-addr:value", "domain": "domain-name:value", "url": "url:value", "email": "email-addr:value", "hash_md5": "file:hashes.MD5", "hash_sha1": "file:hashes.'SHA-1'", "hash_sha256": "file:hashes.'SHA-256'", "hostname": "domain-name:value", "file_path": "file:name", "process": "process:name", "user_agent": "network-traffic:extensions.'http-request-ext'.request_header.'User-Agent'"}, kind, "x-unknown:value")
    return F.concat(F.lit("["), name, F.lit(" = '"), v, F.lit("']"))


def blocklist(indicators: DataFrame, kind: str, least: float = 0.75) -> DataFrame:
    return indicators.where((F.col("type") == kind) & (F.col("confidence") >= least)).select("value").distinct().orderBy("value")


def ranked(indicators: DataFrame) -> DataFrame:
    w = Window.partitionBy("type").orderBy(F.desc("confidence"), F.desc("n"), "value")
    return indicators.select("*", F.row_number().over(w).alias("rank"))
