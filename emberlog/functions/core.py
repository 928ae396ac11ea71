"""Scalar functions as Column -> Column; every one stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEVERITIES = ("INFO", "LOW", "MEDIUM", "HIGH", "CRITICAL")
# Weight of each severity in risk scores
WEIGHTS = {"INFO": 1.0, "LOW": 2.0, "MEDIUM": 4.0, "HIGH": 7.0, "CRITICAL": 10.0}

IN_TEXT = r"\b(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)\b"
IPV4 = r"^(25[0-5]|2[0-4]\d|1?\d?\d)(\.(25[0-5]|2[0-4]\d|1?\d?\d)){3}$"


def c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def lookup(values: dict, key, default=None) -> Column:
    out = F.lit(default)
    for k, v in values.items():
        out = F.when(c(key) == k, F.lit(v)).otherwise(out)
    return out


# --- time --------------------------------------------------------------------------


def apache_time(x) -> Column:
    return F.try_to_timestamp(c(x), F.lit("dd/MMM/yyyy:HH:mm:ss Z"))


def syslog_time(x, year: int) -> Column:
    """A time without a year, in the given one; runs of spaces count as one."""
    return F.try_to_timestamp(F.concat(F.lit(f"{year} "), F.regexp_replace(c(x), r"\s+", " ")), F.lit("yyyy MMM d HH:mm:ss"))


def iso_time(x) -> Column:
    """Common ISO 8601 layouts; without an offset the time is UTC."""
    t = F.regexp_replace(F.trim(c(x)), "T", " ")
    t = F.regexp_replace(t, r"(\.\d{6})\d+", "$1")
    return F.coalesce(*[F.try_to_timestamp(t, F.lit(p)) for p in ("yyyy-MM-dd HH:mm:ss[.SSSSSS][.SSS][ ]XXX", "yyyy-MM-dd HH:mm:ss[.SSSSSS][.SSS][ ]xx", "yyyy-MM-dd HH:mm:ss[.SSSSSS][.SSS][,SSS]", "yyyy/MM/dd HH:mm:ss", "yyyy-MM-dd")])


def epoch_time(x) -> Column:
    """Seconds, milliseconds above 1e10, microseconds above 1e14."""
    v = c(x).try_cast("double")
    return F.when(v > 1e14, F.timestamp_micros(v.cast("long"))).when(v > 1e10, F.timestamp_millis(v.cast("long"))).otherwise(F.timestamp_micros((v * 1e6).cast("long")))


def minute_of(x) -> Column:
    return F.floor(F.unix_timestamp(c(x)) / 60)


# --- numbers, text -----------------------------------------------------------------


def safe_int(x) -> Column:
    return F.trim(c(x)).try_cast("int")


def dash_null(x) -> Column:
    """'-' and the empty text mean nothing."""
    return F.nullif(F.nullif(c(x), F.lit("-")), F.lit(""))


def url_decoded(x) -> Column:
    """'+' is a space, %xx a byte; a per cent sign without two digits stays."""
    return F.coalesce(F.try_url_decode(F.regexp_replace(c(x), r"%(?![0-9A-Fa-f]{2})", "%25")), c(x))


def http_severity(status) -> Column:
    return F.when(c(status) >= 500, "ERROR").when(c(status) >= 400, "WARNING").otherwise("INFO")


def key_values(x, pattern: str = r'([\w.-]+)=("[^"]*"|\'[^\']*\'|\S*)') -> Column:
    """k=v pairs, bare or quoted, as a map; of a key given twice the last stays."""
    keys, values = F.regexp_extract_all(c(x), F.lit(pattern), 1), F.regexp_extract_all(c(x), F.lit(pattern), 2)
    pairs = F.arrays_zip(keys.alias("k"), F.transform(values, lambda v: F.regexp_replace(v, "^[\"']|[\"']$", "")).alias("v"))
    last = F.filter(pairs, lambda p, i: ~F.array_contains(F.slice(keys, i + F.lit(2), F.greatest(F.size(keys), F.lit(1))), p["k"]))
    return F.map_from_entries(last)


# --- addresses ---------------------------------------------------------------------


def is_ipv4(ip) -> Column:
    return F.coalesce(c(ip).rlike(IPV4), F.lit(False))


def ip_number(ip) -> Column:
    """An IPv4 address as a number; null for other text."""
    p = F.split(c(ip), r"\.")
    n = sum((p[i].try_cast("long") * 256 ** (3 - i) for i in range(1, 4)), p[0].try_cast("long") * 256**3)
    return F.when(is_ipv4(ip), n)


def _cidr(text: str) -> tuple[int, int]:
    ip, bits = text.split("/")
    n = 0
    for part in ip.split("."):
        n = n * 256 + int(part)
    size = 1 << 32 - int(bits)
    return n - n % size, n - n % size + size - 1


def in_networks(ip, networks) -> Column:
    """Whether an address lies in one of the networks; the address is read once, whatever their number."""

    def inside(n):
        out = F.lit(False)
        for lo, hi in map(_cidr, networks):
            out = out | n.between(lo, hi)
        return out

    return F.coalesce(F.get(F.transform(F.array(ip_number(ip)), inside), F.lit(0)), F.lit(False))


PRIVATE = ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16")
LOOPBACK = ("127.0.0.0/8",)
DOCUMENTATION = ("192.0.2.0/24", "198.51.100.0/24", "203.0.113.0/24")
MULTICAST = ("224.0.0.0/4",)
LINK_LOCAL = ("169.254.0.0/16",)
RESERVED = ("0.0.0.0/8", "100.64.0.0/10", "192.0.0.0/24", "198.18.0.0/15", "240.0.0.0/4")


def ip_class(ip) -> Column:
    """invalid, loopback, multicast, documentation, private or public."""
    return (
        F.when(~is_ipv4(ip), "invalid").when(in_networks(ip, LOOPBACK), "loopback").when(in_networks(ip, MULTICAST), "multicast")
        .when(in_networks(ip, DOCUMENTATION), "documentation").when(in_networks(ip, PRIVATE + LINK_LOCAL), "private").otherwise("public")
    )


def is_internal(ip) -> Column:
    """For confidence: the private ranges and loopback."""
    return in_networks(ip, PRIVATE + LOOPBACK)


def is_not_routable(ip) -> Column:
    """For indicators: every reserved range, and text that is no address."""
    return ~is_ipv4(ip) | in_networks(ip, PRIVATE + LOOPBACK + DOCUMENTATION + LINK_LOCAL + RESERVED)


# Networks of exit nodes
TOR = ("185.220.100.0/22", "185.220.104.0/22", "199.249.224.0/21", "204.8.156.0/22", "176.10.99.0/24", "77.247.181.0/24")


def is_tor_exit(ip) -> Column:
    return in_networks(ip, TOR)


def same_subnet(a, b, bits: int) -> Column:
    return F.shiftright(ip_number(a), 32 - bits) == F.shiftright(ip_number(b), 32 - bits)


def ipv4s_in(text) -> Column:
    """Distinct addresses in order."""
    return F.array_distinct(F.regexp_extract_all(c(text), F.lit(IN_TEXT), 0))


# --- findings ----------------------------------------------------------------------


def severity_rank(x) -> Column:
    return lookup({s: i for i, s in enumerate(SEVERITIES)}, x)


def risk_score(severity, confidence, asset=1.0) -> Column:
    a = F.lit(asset) if isinstance(asset, float) else c(asset)
    return F.round(F.least(lookup(WEIGHTS, severity, 4.0) * c(confidence) * a, F.lit(10.0)), 2)


def exact_mean(x, places: int) -> Column:
    """An aggregate: the mean of numbers with so many places, by integers, as sums of doubles depend on their order."""
    return F.sum(F.round(c(x) * 10**places).cast("long")) / (F.lit(float(10**places)) * F.count(c(x)))


def risk_band(score) -> Column:
    s = c(score)
    return F.when(s >= 85, "CRITICAL").when(s >= 70, "HIGH").when(s >= 40, "MEDIUM").when(s > 0, "LOW").otherwise("INFO")


def anomaly_label(score) -> Column:
    s = c(score)
    return F.when(s >= 8, "CRITICAL anomaly").when(s >= 6, "HIGH anomaly").when(s >= 4, "SUSPICIOUS").otherwise("Normal")


def threat_level(critical, high, medium, low) -> Column:
    return F.when(c(critical) > 0, "CRITICAL").when(c(high) > 0, "HIGH").when(c(medium) > 0, "ELEVATED").when(c(low) > 0, "LOW").otherwise("QUIET")


def threat_label(critical, high, medium, low) -> Column:
    """The labels of a case's view, where threat_level has those of its summary."""
    return F.when(c(critical) > 0, "CRITICAL").when(c(high) > 0, "HIGH").when(c(medium) > 0, "MEDIUM").when(c(low) > 0, "LOW").otherwise("READY")


def register_sql_functions(spark) -> None:
    """ip_number, ip_class, same_subnet, is_tor_exit and ipv4s_in for plain SQL, as SQL functions without Python."""
    n = "cast(split(ip, '[.]')[0] as bigint)*16777216+cast(split(ip, '[.]')[1] as bigint)*65536+cast(split(ip, '[.]')[2] as bigint)*256+cast(split(ip, '[.]')[3] as bigint)"
    ok = "ip rlike '^(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])([.](25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$'"
    spark.sql(f"create or replace temporary function ip_number(ip string) returns bigint return case when {ok} then {n} end")
    tests = [("loopback", LOOPBACK), ("multicast", MULTICAST), ("documentation", DOCUMENTATION), ("private", PRIVATE + LINK_LOCAL)]
    cases = " ".join("when " + " or ".join(f"ip_number(ip) between {a} and {b}" for a, b in map(_cidr, nets)) + f" then '{name}'" for name, nets in tests)
    spark.sql(f"create or replace temporary function ip_class(ip string) returns string return case when ip_number(ip) is null then 'invalid' {cases} else 'public' end")
    spark.sql("create or replace temporary function same_subnet(a string, b string, bits int) returns boolean return shiftright(ip_number(a), 32 - bits) = shiftright(ip_number(b), 32 - bits)")
    exits = " or ".join(f"ip_number(ip) between {a} and {b}" for a, b in map(_cidr, TOR))
    spark.sql(f"create or replace temporary function is_tor_exit(ip string) returns boolean return coalesce({exits}, false)")
    pattern = IN_TEXT.replace("\\", "\\\\")
    spark.sql(f"create or replace temporary function ipv4s_in(text string) returns array<string> return array_distinct(regexp_extract_all(text, '{pattern}', 0))")
