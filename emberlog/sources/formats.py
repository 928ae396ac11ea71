"""Formats: raw lines to event columns, as column expressions only. A line that does not match keeps null fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import core
from ..plans.adapter import events


def part(x, pattern: str, k: int) -> Column:
    return F.nullif(F.regexp_extract(core.c(x), pattern, k), F.lit(""))


APACHE = r'^(\S+) \S+ (\S+) \[([^\]]+)\] "(\S+) (\S+)(?: ([^"]*))?" (\d{3}) (\S+)(?: "([^"]*)" "([^"]*)")?'


def apache(x) -> dict[str, Column]:
    g = lambda k: core.dash_null(part(x, APACHE, k))
    status = g(7).cast("int")
    return {
        "source_ip": g(1), "username": g(2), "timestamp": core.apache_time(g(3)), "http_method": g(4), "http_uri": g(5), "http_uri_decoded": core.url_decoded(g(5)),
        "http_version": g(6), "http_status": status, "http_bytes": g(8).try_cast("long"), "http_referrer": g(9), "http_user_agent": g(10), "severity": F.when(status.isNotNull(), core.http_severity(status)),
    }


SYSLOG = r"^([A-Z][a-z]{2}\s+\d{1,2} \d{2}:\d{2}:\d{2}) (\S+) ([\w./-]+)(?:\[(\d+)\])?: (.*)$"
FAILED = r"Failed (?:password|publickey) for (?:invalid user )?(\S+) from (\S+) port (\d+)"
ACCEPTED = r"Accepted (?:password|publickey) for (\S+) from (\S+) port (\d+)"
INVALID = r"Invalid user (\S*) from (\S+)"
SUDO = r"sudo(?:\[\d+\])?:\s+(\S+) :"


def syslog(x, year: int = 2024) -> dict[str, Column]:
    x = core.c(x)
    failed, accepted = x.rlike(FAILED), x.rlike(ACCEPTED)
    first = lambda k: F.coalesce(part(x, FAILED, k), part(x, ACCEPTED, k), part(x, INVALID, k) if k < 3 else F.lit(None))
    return {
        "timestamp": core.syslog_time(part(x, SYSLOG, 1), year), "hostname": part(x, SYSLOG, 2), "process_name": part(x, SYSLOG, 3), "process_id": part(x, SYSLOG, 4).cast("long"), "message": part(x, SYSLOG, 5),
        "username": F.coalesce(first(1), part(x, SUDO, 1)), "source_ip": first(2), "source_port": first(3).cast("int"),
        "auth_result": F.when(failed | x.rlike(INVALID), "failure").when(accepted, "success"), "severity": F.when(failed, "WARNING").otherwise("INFO"),
    }


# Names that JSON logs use for one field, in order
ALIASES = {
    "timestamp": ["timestamp", "time", "@timestamp", "ts", "datetime", "date"], "source_ip": ["ip", "source_ip", "src_ip", "client_ip", "remote_addr", "clientip"],
    "username": ["user", "username", "user_name"], "http_method": ["method", "http_method"], "http_uri": ["uri", "url", "path", "request_uri"],
    "http_status": ["status", "status_code", "http_status"], "http_user_agent": ["user_agent", "userAgent", "agent"], "message": ["message", "msg", "log"], "severity": ["level", "severity"], "hostname": ["host", "hostname"],
}


def json_line(x) -> dict[str, Column]:
    get = lambda name: F.coalesce(*[F.get_json_object(core.c(x), f"$['{k}']") for k in ALIASES[name]])
    out = {k: get(k) for k in ALIASES}
    out["timestamp"] = F.coalesce(core.iso_time(out["timestamp"]), core.epoch_time(out["timestamp"].try_cast("double")))
    out["http_status"] = out["http_status"].try_cast("int")
    out["http_uri_decoded"] = core.url_decoded(out["http_uri"])
    level = F.upper(out["severity"])
    out["severity"] = F.when(level == "WARN", "WARNING").otherwise(F.coalesce(level, F.lit("INFO")))
    return out


def cloudtrail(x) -> dict[str, Column]:
    get = lambda p: F.get_json_object(core.c(x), p)
    bad = get("$.errorCode").isNotNull()
    return {
        "timestamp": core.iso_time(get("$.eventTime")), "event_id": get("$.eventName"), "http_method": get("$.eventName"), "cloud_service": get("$.eventSource"), "source_ip": get("$.sourceIPAddress"),
        "http_user_agent": get("$.userAgent"), "username": F.coalesce(get("$.userIdentity.userName"), get("$.userIdentity.arn")), "cloud_region": get("$.awsRegion"),
        "auth_result": F.when(bad, "failure").otherwise("success"), "severity": F.when(bad, "WARNING").otherwise("INFO"), "message": F.coalesce(get("$.errorMessage"), get("$.eventName")),
    }


def key_value(x) -> dict[str, Column]:
    """Packet filters and firewalls that write k=v: addresses, ports, protocol, action."""
    m = core.key_values(x)
    get = lambda *ks: F.coalesce(*[core.dash_null(F.element_at(m, k)) for k in ks])
    deny = core.c(x).rlike(r"(?i)\b(DROP|REJECT|DENY|BLOCK)\b")
    return {
        "source_ip": get("SRC", "srcip", "src"), "dest_ip": get("DST", "dstip", "dst"), "source_port": get("SPT", "srcport").try_cast("int"), "dest_port": get("DPT", "dstport").try_cast("int"),
        "protocol": get("PROTO", "proto"), "username": get("user", "acct"), "action": F.coalesce(get("action"), F.when(deny, "block").otherwise("allow")), "severity": F.when(deny, "WARNING").otherwise("INFO"),
    }


class Named:
    """A map of columns by name, in place of a line."""

    def __init__(self, fields: Column):
        self.fields = fields


def header_split(x, separator: str, names: list[str]) -> dict[str, Column]:
    """Columns by name, or by position in a line: tab- or space-separated logs; '-' is nothing."""
    if isinstance(x, Named):
        return {n: core.dash_null(x.fields[n]) for n in names}
    p = F.split(core.c(x), separator)
    return {n: core.dash_null(F.get(p, F.lit(i))) for i, n in enumerate(names)}


CONN = "ts uid id.orig_h id.orig_p id.resp_h id.resp_p proto service duration orig_bytes resp_bytes conn_state".split()


def zeek_conn(x) -> dict[str, Column]:
    h = header_split(x, "\t", CONN)
    return {
        "timestamp": core.epoch_time(h["ts"]), "source_ip": h["id.orig_h"], "source_port": h["id.orig_p"].try_cast("int"), "dest_ip": h["id.resp_h"], "dest_port": h["id.resp_p"].try_cast("int"), "protocol": h["proto"],
        "action": F.when(h["conn_state"].isin("SF", "S1", "S2", "S3", "RSTO", "RSTR"), "allow").otherwise("block"), "severity": F.when(h["orig_bytes"].try_cast("long") > 1_000_000, "WARNING").otherwise("INFO"),
    }


FORMATS = {"apache_combined": apache, "nginx_access": apache, "syslog": syslog, "auth_log": syslog, "json_lines": json_line, "aws_cloudtrail": cloudtrail, "iptables": key_value, "fortinet": key_value, "zeek_conn": zeek_conn}


def register_format(name: str, columns) -> None:
    """A format of one's own: columns takes the line and gives event columns by name."""
    FORMATS[name] = columns


def parse(lines: DataFrame, log_format: str, raw: str = "raw_line") -> DataFrame:
    made = FORMATS[log_format](F.col(raw))
    return lines.select(*[c for c in lines.columns if c not in made], *[v.alias(k) for k, v in made.items()])


def read_lines(spark, path: str, max_bytes: int = 1 << 20) -> DataFrame:
    """source_file, raw_line, too_long of text files, gzip included; blank lines are skipped."""
    t = spark.read.text(path).select(F.col("_metadata.file_path").alias("source_file"), F.regexp_replace("value", r"\r$", "").alias("raw_line"))
    return t.where(F.trim("raw_line") != "").withColumn("too_long", F.octet_length("raw_line") > max_bytes)


def by_header(lines: DataFrame, mark: str, separator: str) -> DataFrame:
    """source_file, line_number and fields, a map by name, of files whose header line (mark, then names) says the order of columns.

    A file has one header; the last counts if there are several. Lines that begin with # are no rows.
    """
    named = lines.where(F.col("raw_line").startswith(mark)).groupBy("source_file").agg(F.max_by("raw_line", "line_number").alias("_h"))
    rows = lines.where(~F.col("raw_line").startswith("#")).join(named, "source_file")
    names, values = F.slice(F.split("_h", separator), 2, 1000), F.split("raw_line", separator)
    pairs = F.filter(F.arrays_zip(names.alias("k"), values.alias("v")), lambda p: p["k"].isNotNull() & p["v"].isNotNull() & (p["v"] != "-"))
    return rows.select("source_file", "line_number", F.map_from_entries(pairs).alias("fields"))


def read_any_encoding(spark, path: str) -> DataFrame:
    """source_file, line_number, raw_line of small files in UTF-16 with a mark, UTF-8, or else Latin-1."""
    f = spark.read.format("binaryFile").load(path)
    utf16 = F.hex(F.substring("content", 1, 2)).isin("FFFE", "FEFF")
    utf8 = F.try_validate_utf8(F.col("content").cast("string"))
    text = F.when(utf16, F.decode("content", "UTF-16")).otherwise(F.coalesce(utf8, F.decode("content", "ISO-8859-1")))
    rows = f.select(F.col("path").alias("source_file"), F.posexplode(F.split(text, r"\r?\n")).alias("line_number", "raw_line"))
    return rows.withColumn("line_number", F.col("line_number") + 1).where(F.trim("raw_line") != "")


def read_json_records(spark, path: str) -> DataFrame:
    """source_file, line_number, raw_line of whole JSON files: the records in a known wrapper or array, or the one object."""
    t = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source_file"), "value")
    wrapped = [F.get_json_object("value", f"$.{k}") for k in ("Records", "records", "event", "events", "Events", "value", "items", "logs", "Logs")]
    array = F.coalesce(*[F.when(w.startswith("["), w) for w in wrapped], F.when(F.trim("value").startswith("["), F.trim("value")), F.concat(F.lit("["), "value", F.lit("]")))
    parsed = F.from_json(array, "array<string>")
    return t.select("source_file", F.posexplode(parsed).alias("line_number", "raw_line")).withColumn("line_number", F.col("line_number") + 1)


# --- more formats ------------------------------------------------------------------


def _fields(x, pattern: str, names: str) -> dict[str, Column]:
    """The groups of one pattern, by name; _ skips a group, - and the empty text are null."""
    return {n: core.dash_null(part(x, pattern, i)) for i, n in enumerate(names.split(), 1) if n != "_"}


def _ints(d: dict, *names: str) -> dict:
    return d | {n: d[n].try_cast("long" if n in ("process_id", "parent_pid", "http_bytes", "file_size") else "int") for n in names if n in d}


def _words(x, table: list[tuple[str, str]], default: str = "INFO") -> Column:
    """The first severity whose words a line holds."""
    return F.coalesce(*[F.when(core.c(x).rlike(f"(?i){w}"), s) for w, s in table], F.lit(default))


LEVELS = [(r"\b(emerg|panic|alert|crit|critical|fatal)", "CRITICAL"), (r"\b(err|error|severe|fail(ed|ure)?)\b", "ERROR"), (r"\bwarn(ing)?\b", "WARNING")]


def level_of(name) -> Column:
    u = F.upper(core.c(name))
    return F.when(u.isin("EMERG", "EMERGENCY", "ALERT", "CRIT", "CRITICAL", "FATAL", "PANIC"), "CRITICAL").when(u.isin("ERR", "ERROR", "SEVERE"), "ERROR").when(u.isin("WARN", "WARNING", "W"), "WARNING").otherwise("INFO")


APACHE_ERROR = r"^\[([^\]]+)\] \[(?:[\w-]+:)?(\w+)\](?: \[pid (\d+)[^\]]*\])?(?: \[client ([^\]]+):(\d+)\])? ?(.*)$"


def apache_error(x) -> dict[str, Column]:
    d = _ints(_fields(x, APACHE_ERROR, "time level process_id source_ip source_port message"), "process_id", "source_port")
    t = F.try_to_timestamp(F.regexp_replace(F.regexp_replace(d.pop("time"), r"^\w{3} ", ""), r"\.\d+ ", " "), F.lit("MMM d HH:mm:ss yyyy"))
    return d | {"timestamp": t, "severity": level_of(d.pop("level"))}


NGINX_ERROR = r"^(\d{4}/\d{2}/\d{2} \d{2}:\d{2}:\d{2}) \[(\w+)\] (\d+)#\d+: (.*)$"


def nginx_error(x) -> dict[str, Column]:
    d = _ints(_fields(x, NGINX_ERROR, "time level process_id message"), "process_id")
    return d | {"timestamp": core.iso_time(d.pop("time")), "severity": level_of(d.pop("level")), "source_ip": part(x, r"client: ([\d.a-fA-F:]+)", 1)}


SQUID = r"^(\d+\.\d+)\s+(\d+) (\S+) ([A-Z_]+)/(\d{3}) (\d+) (\S+) (\S+) (\S+)"


def squid(x) -> dict[str, Column]:
    d = _ints(_fields(x, SQUID, "time _ source_ip action http_status http_bytes http_method http_uri username"), "http_status", "http_bytes")
    return d | {"timestamp": core.epoch_time(d.pop("time")), "http_uri_decoded": core.url_decoded(d["http_uri"]), "severity": core.http_severity(d["http_status"])}


HAPROXY = r'haproxy\[(\d+)\]: ([\d.a-fA-F:]+):(\d+) \[([^\]]+)\] (\S+) (\S+) \S+ (\d{3}) (\d+).*"(\S+) (\S+)'


def haproxy(x) -> dict[str, Column]:
    d = _ints(_fields(x, HAPROXY, "process_id source_ip source_port time frontend backend http_status http_bytes http_method http_uri"), "process_id", "source_port", "http_status", "http_bytes")
    t = F.try_to_timestamp(F.regexp_replace(d.pop("time"), r"\.\d+$", ""), F.lit("dd/MMM/yyyy:HH:mm:ss"))
    extra = F.create_map(F.lit("frontend"), d.pop("frontend"), F.lit("backend"), d.pop("backend"))
    return d | {"timestamp": t, "http_uri_decoded": core.url_decoded(d["http_uri"]), "severity": core.http_severity(d["http_status"]), "extra": extra}


RFC5424 = r"^<(\d+)>\d+ (\S+) (\S+) (\S+) (\S+) (\S+) (-|(?:\[.*?\])+) ?(.*)$"


def syslog_5424(x) -> dict[str, Column]:
    d = _ints(_fields(x, RFC5424, "pri time hostname process_name process_id event_id data message"), "process_id")
    rank = d.pop("pri").try_cast("int") % 8
    return d | {"timestamp": core.iso_time(d.pop("time")), "severity": F.when(rank <= 2, "CRITICAL").when(rank == 3, "ERROR").when(rank == 4, "WARNING").otherwise("INFO"), "extra": core.key_values(d.pop("data"))}


def auditd(x) -> dict[str, Column]:
    m = core.key_values(x)
    get = lambda k: core.dash_null(F.element_at(m, k))
    kind = get("type")
    auth = kind.isin("USER_AUTH", "USER_LOGIN", "USER_ACCT")
    good = core.c(x).rlike(r"res=(success|1|yes)|success=yes")
    return {
        "timestamp": core.epoch_time(part(x, r"audit\((\d+\.\d+):\d+\)", 1)), "event_id": kind, "username": F.coalesce(get("acct"), get("auid")), "process_name": F.coalesce(get("comm"), get("exe")), "process_id": get("pid").try_cast("long"),
        "parent_pid": get("ppid").try_cast("long"), "source_ip": F.when(get("addr") != "?", get("addr")), "auth_result": F.when(auth & good, "success").when(auth, "failure"), "severity": F.when(good, "INFO").otherwise("WARNING"), "extra": m,
    }


def journald(x) -> dict[str, Column]:
    get = lambda k: F.get_json_object(core.c(x), f"$['{k}']")
    p = get("PRIORITY").try_cast("int")
    return {
        "timestamp": F.timestamp_micros(get("__REALTIME_TIMESTAMP").try_cast("long")), "hostname": get("_HOSTNAME"), "process_name": F.coalesce(get("SYSLOG_IDENTIFIER"), get("_COMM")), "process_id": get("_PID").try_cast("long"),
        "message": get("MESSAGE"), "severity": F.when(p <= 2, "CRITICAL").when(p == 3, "ERROR").when(p == 4, "WARNING").otherwise("INFO"),
    }


KERNEL = r"^(?:([A-Z][a-z]{2}\s+\d{1,2} [\d:]{8}) (\S+) kernel: )?\[\s*(\d+\.\d+)\] (.*)$"


def kernel(x, year: int = 2024) -> dict[str, Column]:
    return {"timestamp": core.syslog_time(part(x, KERNEL, 1), year), "hostname": part(x, KERNEL, 2), "process_name": F.lit("kernel"), "message": part(x, KERNEL, 4), "severity": _words(x, LEVELS)}


EVENT_XML = "System struct<EventID:string,Computer:string,TimeCreated:struct<_SystemTime:string>>, EventData struct<Data:array<struct<_Name:string,_VALUE:string>>>"
# Event numbers with their meaning
LOGON_OK, LOGON_BAD, STARTED = "4624", ("4625", "4648", "4776"), "4688"


def windows_event(x) -> dict[str, Column]:
    e = F.from_xml(core.c(x), EVENT_XML, {"rowTag": "Event"})
    data = F.map_from_entries(F.filter(F.transform(e["EventData"]["Data"], lambda d: F.struct(d["_Name"], d["_VALUE"])), lambda d: d["_Name"].isNotNull()))
    get = lambda *ks: F.coalesce(*[core.dash_null(F.element_at(data, k)) for k in ks])
    n = e["System"]["EventID"]
    hashes = core.key_values(F.regexp_replace(get("Hashes"), ",", " "))
    return {
        "timestamp": core.iso_time(e["System"]["TimeCreated"]["_SystemTime"]), "event_id": n, "hostname": e["System"]["Computer"], "username": get("TargetUserName", "SubjectUserName", "User"), "source_ip": get("IpAddress", "SourceIp"),
        "dest_ip": get("DestinationIp"), "dest_port": get("DestinationPort").try_cast("int"), "process_name": get("NewProcessName", "ProcessName", "Image"), "command_line": get("CommandLine", "ScriptBlockText"),
        "auth_result": F.when(n == LOGON_OK, "success").when(n.isin(*LOGON_BAD), "failure"), "severity": F.when(n == "1102", "CRITICAL").when(n.isin(*LOGON_BAD), "WARNING").otherwise("INFO"),
        "file_hash_md5": F.element_at(hashes, "MD5"), "file_hash_sha1": F.element_at(hashes, "SHA1"), "file_hash_sha256": F.element_at(hashes, "SHA256"), "extra": data,
    }


WIN_FIREWALL = "date time action protocol source_ip dest_ip source_port dest_port size".split()


def windows_firewall(x) -> dict[str, Column]:
    h = header_split(x, " ", WIN_FIREWALL)
    t = core.iso_time(F.concat_ws(" ", h.pop("date"), h.pop("time")))
    h.pop("size")
    return _ints(h, "source_port", "dest_port") | {"timestamp": t, "action": F.lower(h["action"]), "severity": F.when(h["action"] == "DROP", "WARNING").otherwise("INFO")}


def _zeek(x, names: str) -> dict[str, Column]:
    return header_split(x, "\t", names.split())


def zeek_dns(x) -> dict[str, Column]:
    h = _zeek(x, "ts uid id.orig_h id.orig_p id.resp_h id.resp_p proto trans_id rtt query qclass qclass_name qtype qtype_name rcode rcode_name AA TC RD RA Z answers")
    odd = (h["rcode_name"] == "NXDOMAIN") | (h["qtype_name"].isin("TXT", "NULL", "ANY") & (F.length(h["query"]) > 50))
    return {"timestamp": core.epoch_time(h["ts"]), "source_ip": h["id.orig_h"], "dest_ip": h["id.resp_h"], "protocol": h["proto"], "dns_query": h["query"], "dns_type": h["qtype_name"], "dns_rcode": h["rcode_name"], "dns_answer": h["answers"], "severity": F.when(odd, "WARNING").otherwise("INFO")}


def zeek_http(x) -> dict[str, Column]:
    h = _zeek(x, "ts uid id.orig_h id.orig_p id.resp_h id.resp_p trans_depth method host uri referrer version user_agent origin request_body_len response_body_len status_code")
    status = h["status_code"].try_cast("int")
    return {"timestamp": core.epoch_time(h["ts"]), "source_ip": h["id.orig_h"], "dest_ip": h["id.resp_h"], "http_method": h["method"], "hostname": h["host"], "http_uri": h["uri"], "http_uri_decoded": core.url_decoded(h["uri"]), "http_user_agent": h["user_agent"], "http_status": status, "severity": core.http_severity(status)}


def zeek_ssl(x) -> dict[str, Column]:
    h = _zeek(x, "ts uid id.orig_h id.orig_p id.resp_h id.resp_p version cipher curve server_name resumed last_alert")
    return {"timestamp": core.epoch_time(h["ts"]), "source_ip": h["id.orig_h"], "dest_ip": h["id.resp_h"], "tls_version": h["version"], "tls_cipher": h["cipher"], "tls_server_name": h["server_name"], "severity": F.when(h["last_alert"].isNotNull(), "WARNING").otherwise("INFO")}


def _json(x, **paths: str) -> dict[str, Column]:
    """Columns by JSON path; several paths parted by | are tried in order."""
    return {k: F.coalesce(*[F.get_json_object(core.c(x), p) for p in v.split("|")]) for k, v in paths.items()}


def zeek_json(x) -> dict[str, Column]:
    d = _json(x, ts="$.ts", source_ip="$['id.orig_h']", source_port="$['id.orig_p']", dest_ip="$['id.resp_h']", dest_port="$['id.resp_p']", protocol="$.proto", dns_query="$.query", http_method="$.method", http_uri="$.uri")
    return _ints(d, "source_port", "dest_port") | {"timestamp": core.epoch_time(d.pop("ts")), "severity": F.lit("INFO")}


def suricata(x) -> dict[str, Column]:
    d = _json(x, time="$.timestamp", event_id="$.event_type", source_ip="$.src_ip", source_port="$.src_port", dest_ip="$.dest_ip", dest_port="$.dest_port", protocol="$.proto", rule_name="$.alert.signature", action="$.alert.action", level="$.alert.severity",
              dns_query="$.dns.rrname", dns_type="$.dns.rrtype", http_method="$.http.http_method", http_uri="$.http.url", http_user_agent="$.http.http_user_agent", http_status="$.http.status", hostname="$.http.hostname", tls_server_name="$.tls.sni", tls_version="$.tls.version")
    n = d.pop("level").try_cast("int")
    return _ints(d, "source_port", "dest_port", "http_status") | {"timestamp": core.iso_time(d.pop("time")), "http_uri_decoded": core.url_decoded(d["http_uri"]), "message": d["rule_name"], "severity": F.when(n == 1, "HIGH").when(n == 2, "MEDIUM").when(n == 3, "LOW").otherwise("INFO")}


SNORT = r"^(\d\d/\d\d-[\d:]{8})\.\d+\s+\[\*\*\] \[([\d:]+)\] (.*?) \[\*\*\].*?(?:\[Priority: (\d)\])?\s*\{(\w+)\} ([\d.]+):?(\d*) -> ([\d.]+):?(\d*)"


def snort(x, year: int = 2024) -> dict[str, Column]:
    d = _ints(_fields(x, SNORT, "time event_id rule_name level protocol source_ip source_port dest_ip dest_port"), "source_port", "dest_port")
    n = d.pop("level").try_cast("int")
    return d | {"timestamp": F.try_to_timestamp(F.concat(F.lit(f"{year}/"), d.pop("time")), F.lit("yyyy/MM/dd-HH:mm:ss")), "message": d["rule_name"], "severity": F.when(n == 1, "HIGH").when(n == 2, "MEDIUM").otherwise("LOW")}


ASA = r"%ASA-(\d)-(\d+): (.*)$"


def cisco_asa(x) -> dict[str, Column]:
    n = part(x, ASA, 1).try_cast("int")
    pair = r"(?:for|src|from) (?:\w+:)?([\d.]+)/(\d+).*? (?:to|dst) (?:\w+:)?([\d.]+)/(\d+)"
    deny = core.c(x).rlike(r"(?i)\bden(y|ied)\b")
    return _ints(_fields(x, pair, "source_ip source_port dest_ip dest_port"), "source_port", "dest_port") | {
        "event_id": part(x, ASA, 2), "message": part(x, ASA, 3), "protocol": F.lower(part(x, r"(?i)\b(tcp|udp|icmp)\b", 1)), "action": F.when(deny, "deny").when(core.c(x).rlike(r"(?i)permit|built"), "allow"),
        "severity": F.when(n <= 2, "CRITICAL").when(n == 3, "ERROR").when(n == 4, "WARNING").otherwise("INFO"),
    }


def cef(x) -> dict[str, Column]:
    h = F.split(core.c(x), r"(?<!\\)\|")
    m = core.key_values(F.get(h, F.lit(7)), r"(\w+)=((?:(?! \w+=).)*)")
    get = lambda *ks: F.coalesce(*[core.dash_null(F.element_at(m, k)) for k in ks])
    n = F.get(h, F.lit(6)).try_cast("int")
    return {
        "timestamp": core.epoch_time(get("rt").try_cast("double")), "event_id": F.get(h, F.lit(4)), "message": F.get(h, F.lit(5)), "source_ip": get("src"), "dest_ip": get("dst"), "source_port": get("spt").try_cast("int"), "dest_port": get("dpt").try_cast("int"),
        "protocol": get("proto"), "username": get("suser", "duser"), "hostname": get("dhost", "shost"), "action": get("act"), "severity": F.when(n >= 9, "CRITICAL").when(n >= 7, "HIGH").when(n >= 4, "MEDIUM").otherwise("LOW"), "extra": m,
    }


def leef(x) -> dict[str, Column]:
    h = F.split(core.c(x), r"\|")
    m = core.key_values(F.get(h, F.lit(5)), "([^\\t=]+)=([^\\t]*)")
    get = lambda *ks: F.coalesce(*[core.dash_null(F.element_at(m, k)) for k in ks])
    n = get("sev").try_cast("int")
    return {"timestamp": core.iso_time(get("devTime")), "event_id": F.get(h, F.lit(4)), "source_ip": get("src"), "dest_ip": get("dst"), "source_port": get("srcPort").try_cast("int"), "dest_port": get("dstPort").try_cast("int"), "protocol": get("proto"), "username": get("usrName"), "severity": F.when(n >= 8, "HIGH").when(n >= 5, "MEDIUM").otherwise("LOW"), "extra": m}


VPC = "version account interface source_ip dest_ip source_port dest_port proto packets bytes start end action status".split()


def vpc_flow(x) -> dict[str, Column]:
    h = header_split(x, r"\s+", VPC)
    return {
        "timestamp": core.epoch_time(h["start"].try_cast("double")), "cloud_account": h["account"], "cloud_provider": F.lit("aws"), "source_ip": h["source_ip"], "dest_ip": h["dest_ip"], "source_port": h["source_port"].try_cast("int"), "dest_port": h["dest_port"].try_cast("int"),
        "protocol": core.lookup({"6": "tcp", "17": "udp", "1": "icmp"}, h["proto"]), "action": F.lower(h["action"]), "severity": F.when(h["action"] == "REJECT", "WARNING").otherwise("INFO"),
    }


def azure(x) -> dict[str, Column]:
    d = _json(x, time="$.time|$.eventTimestamp|$.createdDateTime", event_id="$.operationName|$.appDisplayName", username="$.caller|$.userPrincipalName|$.identity", source_ip="$.callerIpAddress|$.ipAddress", code="$.resultType|$.status.errorCode", cloud_resource="$.resourceId")
    code = d.pop("code")
    bad = code.isNotNull() & ~code.isin("0", "Success", "Succeeded", "Start")
    return d | {"timestamp": core.iso_time(d.pop("time")), "cloud_provider": F.lit("azure"), "auth_result": F.when(bad, "failure").otherwise("success"), "severity": F.when(bad, "WARNING").otherwise("INFO")}


def gcp_audit(x) -> dict[str, Column]:
    d = _json(x, time="$.timestamp", event_id="$.protoPayload.methodName", username="$.protoPayload.authenticationInfo.principalEmail", source_ip="$.protoPayload.requestMetadata.callerIp", http_user_agent="$.protoPayload.requestMetadata.callerSuppliedUserAgent", cloud_service="$.protoPayload.serviceName", cloud_resource="$.protoPayload.resourceName", granted="$.protoPayload.authorizationInfo[0].granted", code="$.protoPayload.status.code")
    code, granted = d.pop("code").try_cast("int"), d.pop("granted")
    return d | {"timestamp": core.iso_time(d.pop("time")), "cloud_provider": F.lit("gcp"), "action": F.when(granted == "true", "allow").when(granted == "false", "deny"), "severity": F.when(F.coalesce(code, F.lit(0)) > 0, "WARNING").otherwise("INFO")}


def mysql(x) -> dict[str, Column]:
    bad = core.c(x).rlike("Access denied")
    return {"timestamp": core.iso_time(part(x, r"^(\d{4}-\d\d-\d\d[T ][\d:]{8}(?:\.\d+)?Z?)", 1)), "username": part(x, r"'([^']*)'@'", 1), "hostname": part(x, r"'@'([^']*)'", 1), "message": core.c(x), "auth_result": F.when(bad, "failure"), "severity": F.when(bad, "WARNING").otherwise(_words(x, LEVELS))}


PG = r"^(\d{4}-\d\d-\d\d [\d:]{8}(?:\.\d+)?)(?: [A-Z]+)? \[(\d+)\](?: (\S+)@(\S+))? (\w+):\s+(.*)$"


def postgresql(x) -> dict[str, Column]:
    d = _ints(_fields(x, PG, "time process_id username database level message"), "process_id")
    d.pop("database")
    bad = core.c(x).rlike("(?i)authentication failed")
    return d | {"timestamp": core.iso_time(d.pop("time")), "source_ip": part(x, r"host=([\d.]+)", 1), "auth_result": F.when(bad, "failure").when(core.c(x).rlike("connection authorized"), "success"), "severity": level_of(d.pop("level"))}


MONGO_TEXT = r"^(\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\S+)\s+(\w)\s+\S+\s+\[([^\]]+)\]\s+(.*)"


def mongodb(x) -> dict[str, Column]:
    """JSON, or the older text layout."""
    d = _json(x, time="$.t['$date']", level="$.s", process_name="$.c", event_id="$.id", message="$.msg", remote="$.attr.remote", username="$.attr.user|$.attr.principalName", context="$.ctx")
    is_json = F.get_json_object(core.c(x), "$").isNotNull()
    old = lambda k: F.when(~is_json, part(x, MONGO_TEXT, k))
    context = d.pop("context")
    process = F.when(context.contains("-"), F.element_at(F.split(context, "-"), -1)).try_cast("long")
    level = F.coalesce(d.pop("level"), old(2), F.when(is_json, "I"))
    return d | {"timestamp": core.iso_time(F.coalesce(d.pop("time"), old(1))), "source_ip": part(d.pop("remote"), r"^([\d.]+)", 1), "process_id": process, "message": F.coalesce(d["message"], old(4)), "severity": F.when(level.isNotNull(), core.lookup({"F": "CRITICAL", "E": "ERROR", "W": "WARNING"}, level, "INFO"))}


def container(x) -> dict[str, Column]:
    d = _json(x, time="$.time", message="$.log|$.message")
    inner = F.coalesce(F.get_json_object(d["message"], "$.level"), F.get_json_object(d["message"], "$.severity"))
    return d | {"timestamp": core.iso_time(d.pop("time")), "severity": F.when(inner.isNotNull(), level_of(inner)).otherwise(_words(d["message"], LEVELS))}


def kubernetes_audit(x) -> dict[str, Column]:
    d = _json(x, time="$.requestReceivedTimestamp|$.stageTimestamp", event_id="$.verb", username="$.user.username", source_ip="$.sourceIPs[0]", http_uri="$.requestURI", http_status="$.responseStatus.code", http_user_agent="$.userAgent", cloud_resource="$.objectRef.resource")
    d = _ints(d, "http_status")
    return d | {"timestamp": core.iso_time(d.pop("time")), "http_uri_decoded": core.url_decoded(d["http_uri"]), "action": F.when(d["http_status"] < 400, "allow").otherwise("deny"), "severity": core.http_severity(d["http_status"])}


FALCO_TEXT = r"^(\S+):\s+(\w+)\s+(.*)"
# Priorities and what they are
FALCO_LEVELS = {"EMERGENCY": "CRITICAL", "ALERT": "CRITICAL", "CRITICAL": "CRITICAL", "ERROR": "ERROR", "NOTICE": "INFO", "INFORMATIONAL": "INFO"}


def falco(x) -> dict[str, Column]:
    """JSON, or the text layout, which has no date."""
    of = lambda name: f"$.output_fields['{name}']"
    d = _json(x, time="$.time", rule_name="$.rule", message="$.output", level="$.priority", hostname=f"{of('container.id')}|{of('k8s.pod.name')}|$.hostname", process_name=of("proc.name"), process_id=of("proc.pid"), username=of("user.name"), command_line=of("proc.cmdline"), file_path=of("fd.name"))
    is_json = F.get_json_object(core.c(x), "$").isNotNull()
    level = F.coalesce(d.pop("level"), F.when(~is_json, part(x, FALCO_TEXT, 2)), F.when(is_json, "WARNING"))
    d = _ints(d, "process_id")
    return d | {"timestamp": core.iso_time(d.pop("time")), "message": F.coalesce(d["message"], F.when(~is_json, part(x, FALCO_TEXT, 3))), "severity": F.when(level.isNotNull(), core.lookup(FALCO_LEVELS, F.upper(level), "WARNING"))}


def postfix(x, year: int = 2024) -> dict[str, Column]:
    status = part(x, r"status=(\w+)", 1)
    bad = core.c(x).rlike("(?i)authentication failed|reject")
    return {"timestamp": core.syslog_time(part(x, SYSLOG, 1), year), "hostname": part(x, SYSLOG, 2), "process_name": part(x, SYSLOG, 3), "process_id": part(x, SYSLOG, 4).try_cast("long"), "message": part(x, SYSLOG, 5), "source_ip": part(x, r"\[([\d.]+)\]", 1), "username": F.coalesce(part(x, r"from=<([^>]*)>", 1), part(x, r"sasl_username=(\S+)", 1)), "action": status, "auth_result": F.when(core.c(x).rlike("(?i)authentication failed"), "failure"), "severity": F.when(bad | status.isin("bounced", "deferred"), "WARNING").otherwise("INFO")}


BIND = r"(\d{2}-[A-Z][a-z]{2}-\d{4} [\d:]{8})\.?\d*.*client (?:@\S+ )?([\d.a-fA-F:]+)#(\d+).*query: (\S+) IN (\S+)"


def bind_query(x) -> dict[str, Column]:
    d = _ints(_fields(x, BIND, "time source_ip source_port dns_query dns_type"), "source_port")
    odd = (F.length(d["dns_query"]) > 50) | d["dns_query"].rlike("[a-zA-Z0-9]{20,}")
    return d | {"timestamp": F.try_to_timestamp(d.pop("time"), F.lit("dd-MMM-yyyy HH:mm:ss")), "severity": F.when(odd, "WARNING").otherwise("INFO")}


def gelf(x) -> dict[str, Column]:
    d = _json(x, time="$.timestamp", hostname="$.host", message="$.short_message|$.full_message", level="$.level", source_ip="$._source_ip|$._client_ip", username="$._user|$._username")
    n = d.pop("level").try_cast("int")
    own = F.map_filter(F.from_json(core.c(x), "map<string,string>"), lambda k, v: k.startswith("_"))
    return d | {"timestamp": core.epoch_time(d.pop("time").try_cast("double")), "severity": F.when(n <= 2, "CRITICAL").when(n == 3, "ERROR").when(n == 4, "WARNING").otherwise("INFO"), "extra": own}


def unknown(x) -> dict[str, Column]:
    """What can be seen in any line: addresses, a date, a port, a level, a method, a status, a user."""
    ips = core.ipv4s_in(x)
    return {
        "timestamp": core.iso_time(part(x, r"(\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d(?:\.\d+)?(?:Z|[+-]\d\d:?\d\d)?)", 1)), "source_ip": F.get(ips, F.lit(0)), "dest_ip": F.get(ips, F.lit(1)), "source_port": part(x, r"(?i)\bport[ =:]+(\d{1,5})\b", 1).try_cast("int"),
        "http_method": part(x, r"\b(GET|POST|PUT|DELETE|HEAD|PATCH|OPTIONS)\b", 1), "http_status": part(x, r"\b([1-5]\d\d)\b", 1).try_cast("int"), "username": part(x, r"(?i)\buser(?:name)?[ =:]+['\"]?([\w.@-]+)", 1),
        "message": core.c(x), "severity": _words(x, LEVELS), "ai_confidence": F.lit(0.4),
    }


LOGCAT = r"^(\d\d-\d\d [\d:]{8})\.\d+\s+(\d+)\s+\d+ ([VDIWEF]) ([^:]+?)\s*: (.*)$"


def logcat(x, year: int = 2024) -> dict[str, Column]:
    d = _ints(_fields(x, LOGCAT, "time process_id level process_name message"), "process_id")
    return d | {"timestamp": F.try_to_timestamp(F.concat(F.lit(f"{year}-"), d.pop("time")), F.lit("yyyy-MM-dd HH:mm:ss")), "severity": core.lookup({"F": "CRITICAL", "E": "ERROR", "W": "WARNING"}, d.pop("level"), "INFO")}


JAVA = r"^\[?(\d{2,4}[-/]\d\d[-/]\d\d[ T][\d:]{8})(?:[,.]\d+)?\]?\s+(?:\[[^\]]*\]\s+)?(TRACE|DEBUG|INFO|WARN|WARNING|ERROR|FATAL)\s+(?:\[[^\]]*\]\s*)*([\w.$-]*):?\s*(.*)$"


def java_log(x) -> dict[str, Column]:
    d = _fields(x, JAVA, "time level process_name message")
    t = d.pop("time")
    return d | {"timestamp": F.coalesce(core.iso_time(t), F.try_to_timestamp(t, F.lit("yy/MM/dd HH:mm:ss"))), "source_ip": F.get(core.ipv4s_in(x), F.lit(0)), "severity": level_of(d.pop("level"))}


CBS = r"^(\d{4}-\d\d-\d\d [\d:]{8}), (\w+)\s+(\w+)\s+(.*)$"


def windows_cbs(x) -> dict[str, Column]:
    d = _fields(x, CBS, "time level process_name message")
    bad = d["message"].rlike("(?i)fail|error|corrupt")
    return d | {"timestamp": core.iso_time(d.pop("time")), "severity": F.when(level_of(d["level"]) != "INFO", level_of(d.pop("level"))).when(bad, "WARNING").otherwise("INFO")}


OPENSTACK = r"(\d{4}-\d\d-\d\d [\d:]{8})(?:\.\d+)? (\d+) (\w+) ([\w.]+) (?:\[([^\]]*)\] )?(.*)$"


def openstack(x) -> dict[str, Column]:
    d = _ints(_fields(x, OPENSTACK, "time process_id level process_name request message"), "process_id")
    return d | {"timestamp": core.iso_time(d.pop("time")), "event_id": part(d.pop("request"), r"(req-[\w-]+)", 1), "source_ip": F.get(core.ipv4s_in(x), F.lit(0)), "cloud_provider": F.lit("openstack"), "severity": level_of(d.pop("level"))}


def health_app(x) -> dict[str, Column]:
    p = F.split(core.c(x), r"\|")
    return {"timestamp": F.try_to_timestamp(F.regexp_replace(F.get(p, F.lit(0)), r":\d+$", ""), F.lit("yyyyMMdd-H:m:s")), "process_name": F.get(p, F.lit(1)), "process_id": F.get(p, F.lit(2)).try_cast("long"), "message": F.get(p, F.lit(3)), "severity": _words(F.get(p, F.lit(3)), LEVELS)}


PYTHON_LOG = r"^(?:\[)?(\d{4}-\d\d-\d\d [\d:]{8})(?:[,.]\d+)?(?: [+-]\d{4})?\]?[ -]+(?:\[\d+\] )?(?:\[?([\w.]+)\]?[ -]+)?\[?(DEBUG|INFO|WARNING|ERROR|CRITICAL)\]?[ :-]+(.*)$"


def python_log(x) -> dict[str, Column]:
    d = _fields(x, PYTHON_LOG, "time process_name level message")
    return d | {"timestamp": core.iso_time(d.pop("time")), "severity": level_of(d.pop("level"))}


FAIL2BAN = r"^(\d{4}-\d\d-\d\d [\d:]{8}),\d+ fail2ban\.(\w+)\s+\[(\d+)\]: (\w+)\s+\[([^\]]+)\] (Ban|Unban|Found|Restore Ban) ([\d.a-fA-F:]+)"


def fail2ban(x) -> dict[str, Column]:
    d = _ints(_fields(x, FAIL2BAN, "time process_name process_id level rule_name action source_ip"), "process_id")
    d.pop("level")
    return d | {"timestamp": core.iso_time(d.pop("time")), "auth_result": F.when(d["action"].isin("Ban", "Found"), "failure"), "severity": F.when(d["action"].endswith("Ban") & (d["action"] != "Unban"), "WARNING").otherwise("INFO"), "message": core.c(x)}


def ossec(x) -> dict[str, Column]:
    n = part(x, r"\(?level[ :]+(\d+)", 1).try_cast("int")
    return {"event_id": part(x, r"Rule: (\d+)", 1), "rule_name": part(x, r"-> '([^']*)'", 1), "source_ip": part(x, r"(?i)src ?ip: ([\d.]+)", 1), "username": part(x, r"(?i)user: (\S+)", 1), "message": core.c(x), "severity": F.when(n >= 12, "CRITICAL").when(n >= 8, "ERROR").when(n >= 5, "WARNING").otherwise("INFO")}


def openvpn(x) -> dict[str, Column]:
    bad = core.c(x).rlike("(?i)AUTH_FAILED|TLS Error|auth failed")
    t = F.try_to_timestamp(F.regexp_replace(part(x, r"^\w{3} (\w{3}\s+\d{1,2} [\d:]{8} \d{4})", 1), r"\s+", " "), F.lit("MMM d HH:mm:ss yyyy"))
    return {"timestamp": F.coalesce(t, core.iso_time(part(x, r"^(\d{4}-\d\d-\d\d [\d:]{8})", 1))), "source_ip": part(x, r"([\d.]+):\d+ ", 1), "username": part(x, r"(?:\[|CN=)([\w.-]+)", 1), "message": core.c(x), "auth_result": F.when(bad, "failure").when(core.c(x).rlike("Peer Connection Initiated"), "success"), "severity": F.when(bad, "WARNING").otherwise("INFO")}


def crowdstrike(x) -> dict[str, Column]:
    d = _json(x, time="$.timestamp|$.event_creation_time|$.metadata.eventCreationTime", event_id="$.event_simpleName|$.event.DetectName", hostname="$.ComputerName|$.event.ComputerName", username="$.UserName|$.event.UserName", source_ip="$.aip|$.LocalAddressIP4|$.event.LocalIP", process_name="$.FileName|$.event.FileName", command_line="$.CommandLine|$.event.CommandLine", file_hash_sha256="$.SHA256HashData|$.event.SHA256String", level="$.event.SeverityName")
    t = d.pop("time")
    return d | {"timestamp": F.coalesce(core.iso_time(t), core.epoch_time(t.try_cast("double"))), "severity": F.upper(F.coalesce(d.pop("level"), F.lit("INFO")))}


ESX = r"^(\d{4}-\d\d-\d\dT[\d:]{8}(?:\.\d+)?Z?) (?:(\S+) )?(\w+)(?:\[(\w+)\])?: (.*)$"


def vmware_esx(x) -> dict[str, Column]:
    d = _fields(x, ESX, "time hostname process_name process message")
    return d | {"timestamp": core.iso_time(d.pop("time")), "process_id": d.pop("process").try_cast("long"), "username": part(x, r"(?i)user[ =]+'?([\w\\.@-]+)", 1), "severity": _words(x, LEVELS)}


# Places of fields in firewall lines, and the levels of threats
PALO = {"timestamp": 1, "kind": 3, "username": 6, "source_ip": 7, "dest_ip": 8, "rule_name": 11, "level": 16, "source_port": 24, "dest_port": 25, "protocol": 29, "action": 30, "text": 31, "http_bytes": 33}
PALO_LEVELS = {"critical": "CRITICAL", "high": "HIGH", "medium": "MEDIUM", "low": "LOW", "informational": "INFO"}
PALO_LEAST = 20  # fields of a line


def paloalto(x) -> dict[str, Column]:
    """Quoted CSV; TRAFFIC and THREAT lines have places of their own, of others the line is the message."""
    x = core.c(x)
    row = F.from_csv(x, ", ".join(f"c{i} string" for i in range(max(PALO.values()) + 1)), {"escape": '"'})
    enough = F.length(F.regexp_replace(F.regexp_replace(x, '"(?:[^"]|"")*"', ""), "[^,]", "")) + 1 >= PALO_LEAST
    kind = F.when(enough, F.coalesce(row[f"c{PALO['kind']}"], F.lit("")))
    traffic, threat = F.upper(kind) == "TRAFFIC", F.upper(kind) == "THREAT"
    get = lambda name, where: F.when(where, row[f"c{PALO[name]}"])
    action, protocol = F.lower(get("action", traffic)), F.lower(get("protocol", traffic))
    source, dest = get("source_ip", traffic | threat), get("dest_ip", traffic | threat)
    told = F.concat(F.lit("PAN-OS "), kind, F.lit(": "), F.concat_ws(" ", action, protocol, source, F.lit("->"), dest))
    level = core.lookup(PALO_LEVELS, F.lower(get("level", threat)), "WARNING")
    return {
        "timestamp": core.iso_time(get("timestamp", traffic | threat)), "source_ip": source, "dest_ip": dest, "source_port": get("source_port", traffic).try_cast("int"), "dest_port": get("dest_port", traffic).try_cast("int"),
        "protocol": protocol, "action": action, "username": get("username", traffic), "rule_name": get("rule_name", traffic), "http_bytes": get("http_bytes", traffic).try_cast("long"), "event_id": kind,
        "message": F.when(traffic, told).when(threat, F.coalesce(get("text", threat), F.lit(""))).when(kind.isNotNull(), F.trim(x)),
        "severity": F.when(traffic, F.when(action.isin("deny", "drop", "drop-icmp"), "WARNING").otherwise("INFO")).when(threat, level).when(kind.isNotNull(), "INFO"),
    }


MACOS = r"^(\d{4}-\d\d-\d\d\s+\d\d:\d\d:\d\d[+-]\d\d(?::\d\d)?)\s+(\S+)\s+(\d+)\s+(\w+)\s+(.*)"
MACOS_SYSLOG = r"^(\w{3}\s+\d{1,2}\s+\d\d:\d\d:\d\d)(?:\.\d+)?\s+(\S+)\s+([^\[]+)\[(\d+)\](?:\s+<(\w+)>)?:\s*(.*)"
# Levels and what they are
MACOS_LEVELS = {"Warning": "WARNING", "Error": "ERROR", "Critical": "CRITICAL", "Alert": "CRITICAL", "Emergency": "CRITICAL"}


def macos(x, year: int = 2024) -> dict[str, Column]:
    """Lines with a date and an offset, or as in syslog; of others the time in them and the line as message."""
    x = core.c(x)
    one, two = x.rlike(MACOS), x.rlike(MACOS_SYSLOG)
    pick = lambda a, b: F.when(one, part(x, MACOS, a) if a else F.lit(None)).when(two, part(x, MACOS_SYSLOG, b))
    first = core.iso_time(F.regexp_replace(part(x, MACOS, 1), r"([+-]\d\d)$", "$1:00"))
    any_time = core.iso_time(F.regexp_extract(x, r"\d{4}-\d\d-\d\d[\sT]\d\d:\d\d:\d\d", 0))
    return {
        "timestamp": F.when(one, first).when(two, core.syslog_time(part(x, MACOS_SYSLOG, 1), year)).otherwise(any_time), "hostname": F.when(two & ~one, part(x, MACOS_SYSLOG, 2)), "process_name": F.trim(pick(2, 3)), "process_id": pick(3, 4).try_cast("long"),
        "severity": F.when(one | two, core.lookup(MACOS_LEVELS, F.coalesce(pick(4, 5), F.lit("Default")), "INFO")), "message": F.when(one | two, F.trim(pick(5, 6))).otherwise(F.trim(x)),
    }


CRON_MESSAGE = r"CMD\s+\((.+)\)"
DPKG = r"^(\d{4}-\d\d-\d\d\s+\d\d:\d\d:\d\d)\s+(install|upgrade|remove|purge)\s+(\S+)"
BANS = r"fail2ban\.\w+\s+(?:WARNING|NOTICE)\s+\[([^\]]+)\]\s+(Ban|Unban)\s+([\d.]+)"


def linux_syslog(x, year: int = 2024) -> dict[str, Column]:
    """Syslog with commands of cron, packages, killed processes and bans."""
    x = core.c(x)
    d = syslog(x, year)
    package, ban = x.rlike(DPKG), x.rlike(BANS)
    cron = F.when(d["process_name"] == "CRON", part(d["message"], CRON_MESSAGE, 1))
    pairs = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(k).alias("k"), part(x, p, i).alias("v"))) for c, k, p, i in ((package, "dpkg_action", DPKG, 2), (package, "dpkg_package", DPKG, 3), (ban, "fail2ban_jail", BANS, 1), (ban, "fail2ban_action", BANS, 2))]))
    killed = F.coalesce(d["message"].rlike("(?i)out of memory|oom-killer|killed process"), F.lit(False))
    return d | {
        "timestamp": F.when(package, core.iso_time(part(x, DPKG, 1))).otherwise(d["timestamp"]), "message": F.when(package, F.trim(x)).otherwise(d["message"]), "command_line": cron, "source_ip": F.when(ban, part(x, BANS, 3)).otherwise(d["source_ip"]),
        "severity": F.when(ban, "WARNING").when(killed, "CRITICAL").otherwise(d["severity"]), "extra": F.map_from_entries(pairs),
    }


PUBLIC_KEY = r"Accepted publickey for (\S+) from (\S+) port (\d+)"
TOO_MANY = r"error: maximum authentication attempts exceeded for .+ from (\S+)"
TUNNEL = r"Accepted direct-tcpip channel .+ to (\S+):(\d+) .+ from (\S+)"


def openssh(x, year: int = 2024) -> dict[str, Column]:
    """Syslog of SSH with public keys, too many attempts and tunnels; what they are is in extra: auth_method, tag."""
    d = syslog(x, year)
    m = F.coalesce(d["message"], F.lit(""))
    key, many, tunnel = m.rlike(PUBLIC_KEY), m.rlike(TOO_MANY), m.rlike(TUNNEL)
    told = F.when(key, F.create_map(F.lit("auth_method"), F.lit("publickey"))).when(many, F.create_map(F.lit("tag"), F.lit("brute_force"))).when(tunnel, F.create_map(F.lit("tag"), F.lit("ssh_tunnel")))
    return d | {
        "username": F.when(key, part(m, PUBLIC_KEY, 1)).otherwise(d["username"]), "source_ip": F.when(key, part(m, PUBLIC_KEY, 2)).when(many, part(m, TOO_MANY, 1)).when(tunnel, part(m, TUNNEL, 3)).otherwise(d["source_ip"]),
        "source_port": F.when(key, part(m, PUBLIC_KEY, 3).try_cast("int")).otherwise(d["source_port"]), "dest_ip": F.when(tunnel, part(m, TUNNEL, 1)), "dest_port": F.when(tunnel, part(m, TUNNEL, 2).try_cast("int")),
        "auth_result": F.when(key, "success").when(many, "failure").otherwise(d["auth_result"]), "severity": F.when(key, "INFO").when(many, "CRITICAL").when(tunnel, "WARNING").otherwise(d["severity"]), "extra": told,
    }


W3C = "date time s-ip cs-method cs-uri-stem cs-uri-query s-port cs-username c-ip cs(User-Agent) cs(Referer) sc-status".split()


def iis(x) -> dict[str, Column]:
    h = header_split(x, r"\s+", W3C)
    uri = F.concat_ws("?", h["cs-uri-stem"], h["cs-uri-query"])
    status = h["sc-status"].try_cast("int")
    return {"timestamp": core.iso_time(F.concat_ws(" ", h["date"], h["time"])), "dest_ip": h["s-ip"], "http_method": h["cs-method"], "http_uri": uri, "http_uri_decoded": core.url_decoded(uri), "dest_port": h["s-port"].try_cast("int"), "username": h["cs-username"], "source_ip": h["c-ip"], "http_user_agent": F.regexp_replace(h["cs(User-Agent)"], r"\+", " "), "http_referrer": h["cs(Referer)"], "http_status": status, "severity": core.http_severity(status)}


for _columns, _names in (
    (apache, "aws_alb aws_s3_access iis_httpapi"), (apache_error, "apache_error"), (nginx_error, "nginx_error"), (iis, "iis_w3c"), (haproxy, "haproxy"), (squid, "squid"),
    (syslog, "cisco_ios pfsense mssql redis sendmail windows_dns windows_dns_query ios_syslog juniper f5_big_ip"), (syslog_5424, "syslog_rfc5424"), (auditd, "auditd"), (journald, "journald"), (kernel, "kern_log dmesg wireguard"),
    (windows_event, "windows_evtx windows_sysmon powershell_script"), (windows_firewall, "windows_firewall"), (zeek_dns, "zeek_dns"), (zeek_http, "zeek_http"), (zeek_ssl, "zeek_ssl"), (zeek_json, "zeek_json zeek_files"),
    (suricata, "suricata_eve"), (snort, "snort_fast"), (cisco_asa, "cisco_asa"), (cef, "cef checkpoint"), (leef, "leef"), (paloalto, "paloalto"), (vpc_flow, "aws_vpc_flow"), (azure, "azure_activity azure_signin"), (gcp_audit, "gcp_audit"),
    (mysql, "mysql_error mysql_general mysql_slow"), (postgresql, "postgresql"), (mongodb, "mongodb"), (container, "docker_json kubernetes_pod"), (kubernetes_audit, "kubernetes_audit"), (falco, "falco"), (postfix, "postfix"), (bind_query, "bind_query"),
    (json_line, "json_generic caddy traefik macos_unified aws_waf azure_nsg_flow gcp_vpc_flow exchange nodejs carbonblack"), (gelf, "gelf"), (unknown, "unknown ai_parsed csv_generic xml_generic macos_asl"), (logcat, "android_logcat"),
    (java_log, "log4j spark kafka zookeeper hadoop elasticsearch spring_boot"), (windows_cbs, "windows_cbs windows_setup windows_update"), (openstack, "openstack nova keystone neutron"), (health_app, "health_app"),
    (python_log, "python_logging django rails"), (macos, "macos_install macos_crashreporter"), (linux_syslog, "linux_syslog"), (openssh, "openssh"), (fail2ban, "fail2ban"), (ossec, "ossec"), (openvpn, "openvpn"), (crowdstrike, "crowdstrike"), (vmware_esx, "vmware_esx"),
):
    for _name in _names.split():
        FORMATS.setdefault(_name, _columns)


EVENT_TYPES = {
    "timestamp": "timestamp", "source_port": "int", "dest_port": "int", "http_status": "int", "http_bytes": "long", "process_id": "long", "parent_pid": "long", "file_size": "long", "ai_confidence": "double", "extra": "map<string,string>",
}
EVENT_COLUMNS = """timestamp source_ip dest_ip hostname protocol source_port dest_port username auth_result http_method http_uri http_uri_decoded http_referrer http_user_agent http_version http_status http_bytes
process_name event_id message command_line process_id parent_pid dns_query dns_type dns_answer dns_rcode tls_version tls_cipher tls_server_name tls_ja3 file_hash_md5 file_hash_sha1 file_hash_sha256 file_name file_path file_size
action rule_name direction cloud_provider cloud_region cloud_account cloud_service cloud_resource severity extra ai_confidence""".split()


def normalise(lines: DataFrame, log_format: str, raw: str = "raw_line") -> DataFrame:
    """Lines of one format as full event rows: every event column, null where the format has none."""
    made = FORMATS.get(log_format, unknown)(F.col(raw))
    columns = [(made.get(c) if made.get(c) is not None else F.lit(None)).cast(EVENT_TYPES.get(c, "string")).alias(c) for c in EVENT_COLUMNS]
    return lines.select(*[c for c in lines.columns if c not in EVENT_COLUMNS], *columns, *([] if "log_format" in lines.columns else [F.lit(log_format).alias("log_format")]))


def normalise_mixed(lines: DataFrame, formats: list[str], raw: str = "raw_line") -> DataFrame:
    """Lines with a log_format column, read once: each event column by the line's format, null where it has none or is another format."""
    made = {f: FORMATS[f](F.col(raw)) for f in formats}
    none = F.lit(None)
    columns = []
    for c in EVENT_COLUMNS:
        kind = EVENT_TYPES.get(c, "string")
        own = [F.when(F.col("log_format") == f, m[c].cast(kind)) for f, m in made.items() if m.get(c) is not None]
        columns.append((F.coalesce(*own) if own else none.cast(kind)).alias(c))
    return lines.select(*[c for c in lines.columns if c not in EVENT_COLUMNS], *columns)


# --- queries: events written as lines and parsed back -------------------------------


def _second(c="timestamp") -> Column:
    return F.unix_timestamp(c).alias("second")


def apache_round_trip(s, d) -> DataFrame:
    line = F.concat(F.col("source_ip"), F.lit(" - - ["), F.date_format("timestamp", "dd/MMM/yyyy:HH:mm:ss"), F.lit(' +0000] "'), "http_method", F.lit(" "), "http_uri", F.lit(' HTTP/1.1" '), F.col("http_status").cast("string"), F.lit(" 5 \"-\" \""), "http_user_agent", F.lit('"'))
    return parse(events(s, d).select("line_number", line.alias("raw_line")), "apache_combined").select("line_number", "source_ip", "http_method", "http_uri_decoded", "http_status", "http_user_agent", _second())


def syslog_round_trip(s, d) -> DataFrame:
    word = F.when(F.col("auth_result") == "failure", "Failed").otherwise("Accepted")
    line = F.concat(F.date_format("timestamp", "MMM d HH:mm:ss"), F.lit(" "), "hostname", F.lit(" sshd[77]: "), word, F.lit(" password for "), "username", F.lit(" from "), "source_ip", F.lit(" port 22 ssh2"))
    return parse(events(s, d).where("auth_result is not null").select("line_number", line.alias("raw_line")), "auth_log").select("line_number", "hostname", "username", "source_ip", "auth_result", _second())


def key_value_round_trip(s, d) -> DataFrame:
    line = F.concat(F.lit("kernel: DROP IN=eth0 SRC="), "source_ip", F.lit(" DST="), "dest_ip", F.lit(" PROTO=TCP SPT=5 DPT="), F.col("dest_port").cast("string"))
    return parse(events(s, d).where("auth_result = 'failure'").select("line_number", line.alias("raw_line")), "iptables").select("line_number", "source_ip", "dest_ip", "dest_port", "action")


def json_round_trip(s, d) -> DataFrame:
    line = F.to_json(F.struct(F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), F.col("source_ip").alias("ip"), F.col("http_status").alias("status"), F.col("http_user_agent").alias("user_agent")))
    return parse(events(s, d).select("line_number", line.alias("raw_line")), "json_lines").select("line_number", "source_ip", "http_status", "http_user_agent", _second())
