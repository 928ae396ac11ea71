"""Which format a file or a line has, and parsing by the columns that a file's own header names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import core
from ..operators import shared
from . import formats

# Formats by the first bytes of a file, in hexadecimal
MAGIC = [("456C6646696C65", "windows_evtx")]
# Formats by extension
EXTENSIONS = {"evtx": "windows_evtx", "jsonl": "json_lines", "ndjson": "json_lines", "json": "json_generic", "csv": "csv_generic", "pcap": "unknown", "pcapng": "unknown"}
# Formats by what a file's name holds, the first that fits
NAME_HINTS = [
    (r"auth\.log", "auth_log"), (r"syslog", "syslog"), (r"kern\.log", "kern_log"), (r"dmesg", "dmesg"), (r"audit\.log", "auditd"), (r"access\.log", "apache_combined"), (r"error\.log", "apache_error"),
    (r"nginx.*access", "nginx_access"), (r"nginx.*error", "nginx_error"), (r"iis.*\.log", "iis_w3c"), (r"u_ex\d{6}", "iis_w3c"), (r"haproxy", "haproxy"), (r"squid|access\.log", "squid"), (r"conn\.log", "zeek_conn"),
    (r"dns\.log", "zeek_dns"), (r"http\.log", "zeek_http"), (r"ssl\.log", "zeek_ssl"), (r"suricata.*eve", "suricata_eve"), (r"suricata.*fast", "snort_fast"), (r"snort", "snort_fast"), (r"cloudtrail", "aws_cloudtrail"),
    (r"vpc.*flow|flow.*logs", "aws_vpc_flow"), (r"mysql.*error", "mysql_error"), (r"mysql.*slow", "mysql_slow"), (r"postgresql|postgres", "postgresql"), (r"mongodb|mongod", "mongodb"), (r"postfix|mail\.log", "postfix"),
    (r"named.*query|bind", "bind_query"), (r"falco", "falco"), (r"k8s.*audit|kube.*audit", "kubernetes_audit"), (r"journal", "journald"), (r"windows.*firewall|wfas", "windows_firewall"), (r"powershell.*script", "powershell_script"),
    (r"cbs\.log|cbs_", "windows_cbs"), (r"windowsupdate", "windows_update"), (r"setupact|setup\.log", "windows_setup"), (r"android|logcat", "android_logcat"), (r"nova\.log|nova-", "nova"), (r"keystone", "keystone"),
    (r"neutron", "neutron"), (r"openstack|cinder|swift|glance|heat", "openstack"), (r"hadoop|namenode|datanode|yarn|mapred", "hadoop"), (r"elasticsearch|elastic", "elasticsearch"), (r"spark", "spark"), (r"kafka", "kafka"),
    (r"zookeeper", "zookeeper"), (r"healthapp|health_app|step_lsc", "health_app"), (r"spring.*boot", "spring_boot"), (r"django", "django"), (r"fail2ban", "fail2ban"), (r"crowdstrike|falcon", "crowdstrike"), (r"openvpn", "openvpn"),
    (r"vmware|esxi|vcenter", "vmware_esx"), (r"macos.*install|system\.log", "macos_install"),
]
# What a line of each format holds, and how much a line that does counts for it
PROBES = [
    ("windows_evtx", r"<Event\s+xmlns=", 2.0), ("suricata_eve", r'"event_type"\s*:\s*"(?:alert|dns|http|tls|flow)"', 2.0), ("aws_cloudtrail", r'"eventSource"\s*:\s*"[^"]+\.amazonaws\.com"', 2.0),
    ("aws_vpc_flow", r"^(?:\d+\s+){3}[\d\.]+\s+[\d\.]+\s+\d+\s+\d+\s+\d+\s+\d+\s+\d+\s+\d+\s+\d+\s+(?:ACCEPT|REJECT|NODATA)\b", 2.0), ("zeek_conn", r"^#(?:fields|types)\tts\tuid\tid\.orig_h", 2.0),
    ("zeek_dns", r"^#(?:fields|types)\tts\tuid.*query\tqclass", 2.0), ("zeek_http", r"^#(?:fields|types)\tts\tuid.*method\thost\turi", 2.0), ("zeek_ssl", r"^#(?:fields|types)\tts\tuid.*version\tcipher", 2.0),
    ("cef", r"CEF:\d+\|", 2.0), ("leef", r"LEEF:\d+\|", 2.0), ("gelf", r'"version"\s*:\s*"1\.\d+".*"short_message"', 2.0), ("snort_fast", r"\[\*\*\]\s+\[\d+:\d+:\d+\]", 2.0), ("cisco_asa", r"%ASA-\d-\d{6}:", 2.0),
    ("paloalto", r"TRAFFIC|THREAT|URL|WILDFIRE|SYSTEM,\d+,\d+,", 1.5), ("fortinet", r"devname=\S+.*logid=\S+|type=\S+.*subtype=\S+.*level=\S+", 1.5), ("auditd", r"audit\(\d+\.\d+:\d+\):", 2.0),
    ("journald", r'"__REALTIME_TIMESTAMP"\s*:\s*"\d+"', 2.0), ("kubernetes_audit", r'"apiVersion"\s*:\s*"audit\.k8s\.io/', 2.0), ("docker_json", r'"log"\s*:.*"stream"\s*:\s*"(?:stdout|stderr)"', 2.0),
    ("falco", r'"output"\s*:.*"priority"\s*:\s*"(?:Emergency|Alert|Critical|Error|Warning|Notice)"', 1.5), ("iis_w3c", r"^#Fields:.*c-ip|^#Software: Microsoft IIS", 2.0),
    ("windows_firewall", r"^#Fields: date time action protocol src-ip dst-ip", 2.0), ("postgresql", r"\[\d+\]\s+\w+@\w+\s+(?:LOG|ERROR|FATAL|PANIC|WARNING):", 1.5),
    ("mysql_error", r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d+Z\s+\d+\s+\[(?:Note|Warning|Error|System)\]", 1.5), ("mongodb", r'"msg"\s*:.*"attr"\s*:|NETWORK\s+\[conn\d+\]', 1.5),
    ("postfix", r"postfix/(?:smtp|smtpd|qmgr|cleanup)\[\d+\]", 1.5), ("bind_query", r"client\s+@\S+\s+\d+\.\d+\.\d+\.\d+#\d+\s+query:", 1.5), ("syslog_rfc5424", r"^<\d+>\d+\s+\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}", 1.5),
    ("iptables", r"(?:IN=\S*|OUT=\S*)\s+.*SRC=\d+\.\d+\.\d+\.\d+\s+DST=\d+", 1.5), ("haproxy", r"\d+\.\d+\.\d+\.\d+:\d+\s+\[\d{2}/\w{3}/\d{4}:\d{2}:\d{2}:\d{2}\.\d+\].*\d+/\d+/\d+/\d+/\d+\s+\d{3}", 1.5),
    ("squid", r"^\d+\.\d{3}\s+\d+\s+\d+\.\d+\.\d+\.\d+\s+(?:TCP|UDP)_", 1.5), ("apache_combined", r"^\d{1,3}(?:\.\d{1,3}){3}\s+\S+\s+\S+\s+\[\d{2}/\w{3}/\d{4}:", 1.5),
    ("apache_error", r"^\[(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)\s+\w+\s+\d+\s+\d{2}:\d{2}:\d{2}", 1.0), ("nginx_error", r"^\d{4}/\d{2}/\d{2}\s+\d{2}:\d{2}:\d{2}\s+\[(?:emerg|alert|crit|error|warn|notice|info|debug)\]", 1.5),
    ("auth_log", r"(?:sshd|sudo|pam_unix|su|login)\[\d+\]:", 1.0), ("syslog", r"^(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}\s+\S+\s+\S+:", 1.0), ("json_generic", r"^\s*\{", 0.8),
    ("android_logcat", r"^\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}", 2.0), ("windows_cbs", r"^\d{4}-\d{2}-\d{2}.*,\s+(?:Info|Warning|Error)\s+(?:CBS|CSI)\s", 2.0), ("openstack", r"(?:nova|keystone|neutron|cinder|swift)\.\w+\s+\[-\]", 2.0),
    ("hadoop", r"org\.apache\.hadoop", 2.0), ("log4j", r"\d{4}-\d{2}-\d{2}.*(?:DEBUG|INFO|WARN|ERROR|FATAL).*org\.apache", 1.5), ("health_app", r"^\d{4}(?:-\d{2}-|\d{2})\d{2}.*\|\w+\|\w+\|\d+\|", 2.0),
    ("spring_boot", r"\d+\s+---\s+\[.*\].*\s+:\s+", 2.0), ("fail2ban", r"fail2ban\.\w+.*\[(?:Ban|Found|Unban)", 2.0), ("aws_cloudtrail", r'"eventName"\s*:\s*"\w+".*"eventSource"', 1.0),
    ("azure_activity", r'"operationName"\s*:.*"resourceProvider"\s*:\s*"Microsoft\.', 1.0), ("gcp_audit", r'"logName"\s*:.*"projects/.*cloudaudit.googleapis', 1.0),
]
LINES, LEAST = 15, 0.8


def line_format(x) -> Column:
    """The format of the first probe that a line meets, else ai_parsed."""
    return F.coalesce(*[F.when(core.c(x).rlike(p), f) for f, p, _ in PROBES], F.lit("ai_parsed"))


def name_format(path) -> Column:
    """The format that a file's extension or name tells; null where neither does."""
    name = F.lower(F.element_at(F.split(core.c(path), "/"), -1))
    extension = core.lookup(EXTENSIONS, F.regexp_extract(name, r"\.([^.]+)$", 1))
    return F.coalesce(extension, *[F.when(name.rlike(p), f) for p, f in NAME_HINTS])


def content_format(lines: DataFrame) -> DataFrame:
    """source_file, log_format, score: by the first LINES lines of a file that are not blank.

    Each line adds the weights of the probes that it meets; the greatest sum counts, of equal ones that met first. Below
    LEAST the format is unknown. Apache's gives way to auth_log where that has any points. A file whose first line begins
    with a bracket and meets nothing is json_generic.
    """
    w = Window.partitionBy("source_file").orderBy("line_number")
    first = lines.where(F.trim("raw_line") != "").select("source_file", "raw_line", F.row_number().over(w).alias("rn")).where(F.col("rn") <= LINES)
    met = F.array_compact(F.array(*[F.when(F.col("raw_line").rlike(p), F.struct(F.lit(f).alias("f"), F.lit(weight).alias("w"), F.lit(i).alias("i"))) for i, (f, p, weight) in enumerate(PROBES)]))
    each = first.select("source_file", "rn", F.explode(met).alias("m")).groupBy("source_file", F.col("m.f").alias("f")).agg(F.sum("m.w").alias("s"), F.min(F.struct("rn", "m.i")).alias("at"))
    best = each.groupBy("source_file").agg(F.max_by("f", F.struct("s", (-F.col("at.rn")).alias("a"), (-F.col("at.i")).alias("b"))).alias("f"), F.max("s").alias("score"), F.max(F.col("f") == "auth_log").alias("auth"))
    head = first.groupBy("source_file").agg(F.min_by("raw_line", "rn").alias("head"))
    named = F.when(F.col("score") < LEAST, "unknown").when((F.col("f") == "apache_combined") & F.col("auth"), "auth_log").otherwise(F.col("f"))
    bracket = F.when(F.ltrim("head").startswith("["), "json_generic").otherwise("unknown")
    return head.join(best, "source_file", "left").select("source_file", F.coalesce(named, bracket).alias("log_format"), F.coalesce("score", F.lit(0.0)).alias("score"))


def file_format(lines: DataFrame, magic: DataFrame | None = None) -> DataFrame:
    """source_file and log_format: by magic (source_file, head: the first bytes) where given, extension, name, then content; ai_parsed where nothing tells."""
    content = content_format(lines)
    if magic is None:
        by_bytes = F.lit(None).cast("string")
    else:
        known = F.coalesce(*[F.when(F.hex("head").startswith(sig), f) for sig, f in MAGIC])
        content = content.join(magic.select("source_file", known.alias("_magic")), "source_file", "left")
        by_bytes = F.col("_magic")
    told = F.when(F.col("log_format") != "unknown", F.col("log_format"))
    return content.select("source_file", F.coalesce(by_bytes, name_format("source_file"), told, F.lit("ai_parsed")).alias("log_format"))


#: of formats whose files name their columns: the header's beginning, what parts columns, and other names for them
HEADERS = {
    **{f: ("#fields\t", "\t", {}) for f in ("zeek_conn", "zeek_dns", "zeek_http", "zeek_ssl")},
    "iis_w3c": ("#Fields: ", " +", {}),
    "windows_firewall": ("#Fields: ", " +", {"src-ip": "source_ip", "dst-ip": "dest_ip", "src-port": "source_port", "dst-port": "dest_port"}),
    "aws_vpc_flow": ("version ", " +", {"account-id": "account", "srcaddr": "source_ip", "dstaddr": "dest_ip", "srcport": "source_port", "dstport": "dest_port", "protocol": "proto"}),
}


def parse_with_header(lines: DataFrame, log_format: str, raw: str = "raw_line") -> DataFrame:
    """As formats.parse, by the names of each file's header; by position in files without one.

    Header and comment lines are no rows. Of several headers in a file the last counts.
    """
    mark, separator, names = HEADERS[log_format]
    text = F.col(raw) if mark.startswith("version") else F.substring(raw, len(mark) + 1, 1 << 20)
    heads = lines.where(F.col(raw).startswith(mark)).groupBy("source_file").agg(F.max_by(F.split(F.trim(text), separator), "line_number").alias("_names"))
    rows = lines.where(~F.col(raw).startswith("#") & ~F.col(raw).startswith(mark)).join(heads, "source_file", "left")
    renamed = F.transform("_names", lambda n: F.coalesce(core.lookup(names, n), n)) if names else F.col("_names")
    pairs = F.filter(F.arrays_zip(renamed.alias("k"), F.split(F.col(raw), separator).alias("v")), lambda p: p["k"].isNotNull() & p["v"].isNotNull())
    rows = rows.withColumn("_fields", F.map_from_entries(pairs))
    named, placed = formats.FORMATS[log_format](formats.Named(F.col("_fields"))), formats.FORMATS[log_format](F.col(raw))
    made = {k: F.when(F.col("_names").isNotNull(), named[k]).otherwise(placed[k]).alias(k) for k in placed}
    return rows.select(*[c for c in lines.columns if c not in made], *made.values())


def default_names(log_format: str) -> list[str]:
    """The columns of a format in the order that they have in files without a header."""
    seen: list[str] = []

    class Asked:
        def __getitem__(self, name):
            seen.append(name)
            return F.lit(None).cast("string")

    formats.FORMATS[log_format](formats.Named(Asked()))
    return list(dict.fromkeys(seen))


def normalise_files(lines: DataFrame, kinds: list[str], raw: str = "raw_line") -> DataFrame:
    """Lines of many files, with a log_format each, as full event rows in one pass: by the names of its file's header where a file has one and its format knows headers, else by position.

    Header and comment lines of those formats are no rows. Headers are one row a file; they are counted, and broadcast where few.
    """
    own = [f for f in kinds if f in HEADERS]
    text, marked, comment = F.lit(None).cast("array<string>"), F.lit(False), F.lit(False)
    for f in own:
        mark, separator, names = HEADERS[f]
        here = (F.col("log_format") == f) & F.col(raw).startswith(mark)
        told = F.split(F.trim(F.col(raw) if mark.startswith("version") else F.substring(raw, len(mark) + 1, 1 << 20)), separator)
        told = F.transform(told, lambda n: F.coalesce(core.lookup(names, n), n)) if names else told  # noqa: B023
        text, marked = F.when(here, told).otherwise(text), marked | here
        comment = comment | ((F.col("log_format") == f) & F.col(raw).startswith("#"))
    heads = shared.written(lines.where(marked).groupBy("source_file").agg(F.max_by(text, "line_number").alias("_names")), "headers")
    rows = lines.where(~marked & ~comment).join(shared.small(heads), "source_file", "left")
    split, names = F.lit(None).cast("array<string>"), F.lit(None).cast("array<string>")
    for f in own:
        split = F.when(F.col("log_format") == f, F.split(raw, HEADERS[f][1])).otherwise(split)
        names = F.when(F.col("log_format") == f, F.array(*map(F.lit, default_names(f)))).otherwise(names)
    pairs = F.filter(F.arrays_zip(F.coalesce("_names", names).alias("k"), split.alias("v")), lambda p: p["k"].isNotNull() & p["v"].isNotNull())
    rows = rows.withColumn("_fields", F.map_from_entries(pairs))
    made = {f: formats.FORMATS[f](formats.Named(F.col("_fields")) if f in own else F.col(raw)) for f in kinds}
    columns = []
    for c in formats.EVENT_COLUMNS:
        kind = formats.EVENT_TYPES.get(c, "string")
        value = F.lit(None).cast(kind)
        for f in kinds:
            if made[f].get(c) is not None:
                value = F.when(F.col("log_format") == f, made[f][c].cast(kind)).otherwise(value)
        columns.append(value.alias(c))
    return rows.select(*[c for c in lines.columns if c not in formats.EVENT_COLUMNS], *columns)


def rejects(lines: DataFrame, parsed: DataFrame, max_bytes: int = 1 << 20) -> DataFrame:
    """source_file, line_number, reason of lines that give no event: too long, or without a time once parsed."""
    long = lines.where(F.octet_length("raw_line") > max_bytes).select("source_file", "line_number", F.lit("too_long").alias("reason"))
    return long.unionByName(parsed.where("timestamp is null").select("source_file", "line_number", F.lit("unparsed").alias("reason")).join(long.select("source_file", "line_number"), ["source_file", "line_number"], "left_anti"))


def statistics(parsed: DataFrame) -> DataFrame:
    """log_format, lines, ok, errors (without a time), addresses, first and last time and the span in seconds."""
    out = parsed.groupBy("log_format").agg(
        F.count("*").alias("lines"), F.count("timestamp").alias("ok"), (F.count("*") - F.count("timestamp")).alias("errors"), F.countDistinct("source_ip").alias("ips"),
        F.unix_timestamp(F.min("timestamp")).alias("first"), F.unix_timestamp(F.max("timestamp")).alias("last"),
    )
    return out.withColumn("span", F.col("last") - F.col("first"))
