"""Case work on small tables."""

import hashlib
import hmac
import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from emberlog.functions import core
from emberlog.operators import cases, correlate, ioc, matching, report, search
from emberlog.plans.adapter import events
from emberlog.queries import found
from emberlog.sources import formats

DIR = "/root/testdata/sf0.001"


def test_header_order(spark):
    lines = [("a", 1, "#fields\tx\ty"), ("a", 2, "1\t2"), ("b", 1, "#fields\ty\tx"), ("b", 2, "1\t-"), ("c", 1, "no header")]
    got = {r["source_file"]: r["fields"] for r in formats.by_header(spark.createDataFrame(lines, "source_file string, line_number long, raw_line string"), "#fields", "\t").collect()}
    assert got == {"a": {"x": "1", "y": "2"}, "b": {"y": "1"}}


def test_encodings(spark, tmp_path):
    for name, code in (("a", "utf-8"), ("b", "utf-16"), ("c", "latin-1")):
        (tmp_path / name).write_bytes("né\n\nzwei\n".encode(code))
    got = formats.read_any_encoding(spark, str(tmp_path)).collect()
    assert sorted((r["line_number"], r["raw_line"]) for r in got) == [(1, "né")] * 3 + [(3, "zwei")] * 3


def test_file_facts(spark, tmp_path):
    (tmp_path / "a.log").write_text("text " * 100)
    (tmp_path / "b.bin").write_bytes(bytes(range(16)) * 100)
    got = {r["extension"]: r for r in cases.file_facts(spark, str(tmp_path)).collect()}
    assert got["log"]["size"] == 500 and got["log"]["lines_guess"] == 2
    assert not got["log"]["is_binary"] and got["bin"]["is_binary"]


def test_years(spark):
    rows = [("f", i, m) for i, m in enumerate((11, 12, 12, 1, 2, 12, 1))]
    got = cases.with_years(spark.createDataFrame(rows, "source_file string, line_number long, month int"), 2020).orderBy("line_number").collect()
    assert [r["year"] for r in got] == [2020, 2020, 2020, 2021, 2021, 2021, 2022]


def test_ledger(spark):
    a = spark.createDataFrame([("h1", 1), ("h2", 2)], "sha256 string, size long")
    b = spark.createDataFrame([("h2", 2), ("h3", 3)], "sha256 string, size long")
    assert sorted(r["sha256"] for r in cases.new_entries(a, b).collect()) == ["h1", "h2", "h3"]


def test_selection(spark):
    rows = spark.createDataFrame([(1, "C:\\x\\cmd.exe"), (2, "cmd"), (3, None)], "i int, image string")
    assert [r["i"] for r in rows.where(cases.selection({"image": "*\\CMD.exe"})).collect()] == [1]
    assert [r["i"] for r in rows.where(cases.selection({"image|startswith": ["cm", "zz"]})).collect()] == [2]


def test_exports_and_bundle(spark, tmp_path):
    f = found(spark, DIR)
    i = ioc.merged(ioc.of_findings(f)).cache()
    cases.export(i, str(tmp_path / "e"))
    for kind in ("csv", "tsv", "zeek", "misp"):
        assert spark.read.option("header", True).csv(f"{tmp_path}/e/{kind}").count() == i.count()
    search.bundle({"findings": f.limit(5).drop("tactic_ids"), "iocs": i}, str(tmp_path / "b"))
    assert {r["name"]: r["n"] for r in spark.read.json(f"{tmp_path}/b/manifest").collect()} == {"findings": 5, "iocs": i.count()}
    search.save(f.select("id", "rule_id", "session_id"), str(tmp_path / "t"))
    one = spark.read.parquet(str(tmp_path / "t")).where("session_id = '2024-01-10'")
    assert "PartitionFilters: [isnotnull(session_id" in one._jdf.queryExecution().toString()
    i.unpersist()


def test_stix_ids_agree(spark):
    f = found(spark, DIR)
    ids = {r["id"] for r in cases.stix_objects(f).collect()}
    assert all(r["source"] in ids and r["target"] in ids for r in cases.stix_relationships(f).collect())


def test_threat_scores(spark):
    kinds = "d int, t int, r int, p int, u boolean, b boolean"
    rows = spark.createDataFrame([(5, 10, 0, 0, False, False), (0, 0, -60, 3, False, False), (0, 0, 0, 12, True, False), (None, None, None, None, None, True), (None, None, None, None, None, None)], kinds)
    assert [r[0] for r in rows.select(ioc.threat_score("d", "t", "r", "p", "u", "b")).collect()] == [5.0, 7.0, 7.0, 8.0, 0.0]


def test_small_functions(spark):
    one = spark.range(1)
    assert one.select(core.is_tor_exit(F.lit("185.220.101.5")), core.same_subnet(F.lit("10.0.0.1"), F.lit("10.0.0.200"), 24), core.url_decoded(F.lit("a%2+b%zz%41"))).first()[:] == (True, True, "a%2 b%zzA")
    assert one.select(core.epoch_time(F.lit("1700000000.5")) == core.epoch_time(F.lit("1700000000500"))).first()[0]
    assert events(spark, DIR).count() == 1000


def finding(spark, *rows):
    kinds = "id string, rule_id string, rule_name string, severity string, category string, confidence double, risk_score double, source_ip string, dest_ip string, hostname string, username string, process_name string, event_id string, us long, line_number long, raw_line string, source_file string, session_id string, auth_result string, hour_of_day int, mitre_ids array<string>, tactic_names array<string>, http_user_agent string, http_uri_decoded string, supporting_lines array<string>"
    names = [k.strip().split()[0] for k in kinds.split(", ")]
    base = {"severity": "HIGH", "category": "auth", "confidence": 0.8, "risk_score": 5.0, "us": 0, "session_id": "s", "mitre_ids": [], "tactic_names": [], "hour_of_day": 12, "raw_line": "line"}
    return spark.createDataFrame([tuple((base | {"id": str(i), "line_number": i} | r).get(n) for n in names) for i, r in enumerate(rows)], kinds)


def test_ledger_signatures(spark):
    rows = [("e1", "/a", "h1", 5), ("e2", "/b", "h2", 6), ("e3", "/c", "h3", 7), ("e4", "/d", "h4", 8)]
    columns = ["entry_id", "file_path", "sha256", "size"]
    book = cases.signed(spark.createDataFrame(rows, "entry_id string, file_path string, sha256 string, size long"), "secret", columns)
    first = book.orderBy("entry_id").first()
    text = json.dumps({"entry_id": "e1", "file_path": "/a", "sha256": "h1", "size": 5}, separators=(",", ":"))
    assert first["entry_hmac"] == hmac.new(b"secret", text.encode(), hashlib.sha256).hexdigest()
    book = book.withColumn("size", F.when(F.col("entry_id") == "e2", 99).otherwise(F.col("size")))
    now = spark.createDataFrame([("/a", "h1"), ("/b", "h2"), ("/c", "other")], "path string, sha256 string")
    got = {r["entry_id"]: (r["verified"], r["error"]) for r in cases.verified(book, now, "secret", columns).collect()}
    assert got == {"e1": (True, None), "e2": (False, "tampered"), "e3": (False, "modified"), "e4": (False, "missing")}


def test_conditions(spark):
    rows = spark.createDataFrame([(1, "cmd.exe", "bob"), (2, "cmd.exe", "system"), (3, "sh", "bob"), (4, None, "bob")], "i int, image string, user string")
    s = {"sel_a": {"image": "cmd*"}, "sel_b": {"image": "s?"}, "flt": {"user": "SYSTEM"}}
    ids = lambda text: [r["i"] for r in rows.where(cases.condition(text, s)).orderBy("i").collect()]
    assert ids("sel_a and not flt") == [1] and ids("1 of sel_*") == [1, 2, 3] and ids("all of sel_*") == []
    assert ids("(sel_a or sel_b) and not flt") == [1, 3] and ids("not 1 of them") == [4]


def test_indicators_of_findings(spark):
    f = finding(
        spark,
        {"rule_id": "R1", "category": "malware", "source_ip": "45.1.1.1", "dest_ip": "8.8.4.4", "hostname": "web1", "process_name": "mimikatz.exe", "http_user_agent": "sqlmap/1", "event_id": "4625", "mitre_ids": ["T1"],
         "http_uri_decoded": "/r?u=http://Bad.Example.COM/x", "raw_line": "seen /etc/passwd and C:\\\\temp\\\\a.exe by Bob@Mail.example.org", "supporting_lines": ["from evil.example.net at 9.9.9.9", "a" * 64]},
    )
    got = {(r["type"], r["value"]): r for r in ioc.of_findings(f).collect()}
    want = {("ipv4", "45.1.1.1"): 0.8, ("ipv4", "8.8.4.4"): 0.72, ("hostname", "web1"): 0.68, ("process", "mimikatz.exe"): 0.85, ("user_agent", "sqlmap/1"): 0.9, ("url", "http://Bad.Example.COM/x"): 0.8, ("domain", "evil.example.net"): 0.56, ("ipv4", "9.9.9.9"): 0.6, ("email", "bob@mail.example.org"): 0.64, ("hash_sha256", "a" * 64): 0.8, ("file_path", "/etc/passwd"): 0.56}
    assert {k: got[k]["confidence"] for k in want} == want
    assert got[("hostname", "web1")]["tags"] == ["malware", "T1", "EventID:4625"] and got[("hostname", "web1")]["source_rule"] == "R1"
    assert {k for k in got if k[0] == "domain"} >= {("domain", "bad.example.com"), ("domain", "mail.example.org")}
    both = ioc.merged(ioc.of_findings(f))
    assert ioc.filtered(both, rule="r1", tag="eventid", drop_private=True).count() == both.count() and ioc.filtered(both, rule="zzz").count() == 0


def test_behaviour_without_a_past(spark):
    rows = [{"source_ip": "1.1.1.1", "category": "auth_attack", "severity": "LOW", "hour_of_day": 12}] * 2 + [{"source_ip": "2.2.2.2", "category": "web", "severity": "CRITICAL", "hour_of_day": 3}] * 3 + [{"source_ip": "3.3.3.3", "category": "web", "severity": "LOW"}] * 30
    got = {r["entity"]: r for r in correlate.anomaly(correlate.behaviour(finding(spark, *rows)), "s").collect()}
    # failures alone; grave, off hours and mean severity; the number of findings gives nothing
    assert [(got[e]["score"], got[e]["label"]) for e in ("1.1.1.1", "2.2.2.2", "3.3.3.3")] == [(3.0, "Normal"), (7.0, "HIGH anomaly"), (0.0, "Normal")]
    assert got["2.2.2.2"]["flags"] == ["grave", "off hours"] and not got["1.1.1.1"]["has_baseline"]


def test_graph_ends(spark):
    rows = [{"hostname": "h", "source_ip": "1.1.1.1"}, {"dest_ip": "2.2.2.2"}, {"process_name": "p"}, {"source_file": "/var/log/a.log"}, {"category": "web"}]
    got = {(r["source"], r["target"]) for r in correlate.graph_edges(finding(spark, *rows)).collect()}
    assert got == {("1.1.1.1", "h"), ("external", "2.2.2.2"), ("external", "process:p"), ("external", "log:a.log"), ("external", "target:web")}


def test_playbook_names(spark):
    steps = spark.createDataFrame([("web_attack", "p", "w"), ("malware", "p", "m"), ("default", "p", "d")], "category string, phase string, step string")
    got = {r["category"]: r["step"] for r in cases.playbook_steps(finding(spark, *({"category": c} for c in ("api_security", "impact", "recon", "ai_attack"))), steps).collect()}
    assert got == {"api_security": "w", "impact": "m", "recon": "d", "ai_attack": "d"}


def test_entity_risk_without_confidence(spark):
    got = correlate.entity_risk(finding(spark, {"source_ip": "1.1.1.1", "confidence": 0.0, "risk_score": 8.0})).first()
    assert got["risk_score"] == round(8.0 * 0.75 * 2.4, 2)


def test_decoys(spark):
    e = spark.createDataFrame([(1, "f", "a", 0, "read Canary-User-7 now"), (2, "f", "b", 0, "the blue folder"), (3, "f", "c", 0, "key k9z")], "line_number long, source_file string, source_ip string, us long, raw_line string")
    d = spark.createDataFrame([("t1", "canary-user-7"), ("t2", "Blue Folder"), ("t3", "k9z"), ("t4", "")], "token_id string, value string")
    assert sorted((r["token_id"], r["line_number"]) for r in cases.decoy_hits(e, d).collect()) == [("t1", 1), ("t2", 2), ("t3", 3)]


@pytest.mark.parametrize("small", [100_000, 0])
def test_values_in_lines(spark, small):
    """Values of 1 to 40 characters, alike ones and ones of many scripts, equal to looking for each in each line."""
    r = random.Random(3)
    alphabet = "aAb.- honeyÄé✓𝄞k9"
    lines = ["".join(r.choice(alphabet) for _ in range(r.randrange(80))) for _ in range(300)] + ["read honey.txt.", "my-honey.txt", "HONEY.TXT", "", None, "x" * 20_000 + "honey.txt"]
    values = {"honey.txt", "prefix-aaaa-1", "prefix-aaaa-2"} | {line[at : at + r.randrange(1, 41)] for line in lines if line for at in [r.randrange(len(line))] for _ in range(2)}
    values |= {"".join(r.choice(alphabet) for _ in range(n)) for n in range(1, 41)}
    rows = spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)], "source_file string, line_number long, raw_line string").repartition(3)
    own = spark.createDataFrame([(v.lower(),) for v in values] + [("",), (None,)], "value string")
    got = sorted((x["line_number"], x["value"]) for x in matching.containing(rows, own, "raw_line", ["source_file", "line_number"], small).collect())
    low = {v.lower() for v in values}
    assert got == sorted((i, v) for i, x in enumerate(lines) if x for v in low if v in x.lower())
    assert matching.containing(rows, own.where("value = ''"), "raw_line", ["source_file", "line_number"], small).collect() == []


def test_pieces_that_others_share_are_not_used(spark):
    values = [f"akia-common-prefix-{i:06d}" for i in range(500)]
    got = matching.rarest_pieces(spark.createDataFrame([(v,) for v in values], "value string")).collect()
    assert len(got) == 500 and max(Counter(x["piece"] for x in got).values()) == 1


def test_intervals(spark):
    """Against all pairs: ties, times on the edge of the window and of buckets, nulls, and a user with most rows."""
    r = random.Random(4)
    at = lambda: r.choice([r.randrange(40), 10, 20, 30]) * 1_000_000
    rows = [(i, r.choice(["u", "u", "u", "v", None]), r.choice("abc") if r.random() < 0.9 else None, at() if r.random() < 0.95 else None) for i in range(400)]
    e = spark.createDataFrame(rows, "line_number long, username string, source_ip string, us long").repartition(3)
    got = {x["line_number"]: x["other_line_number"] for x in matching.last_other(e, "username", "source_ip", ["line_number"], ["line_number"], 10).collect()}
    want = {}
    for i, u, ip, t in rows:
        before = [(t2, j) for j, u2, ip2, t2 in rows if None not in (u, ip, t, u2, ip2, t2) and u == u2 and ip != ip2 and (t2, j) < (t, i) and t2 >= t - 10_000_000]
        if before:
            want[i] = max(before)[1]
    assert got == want
    right = e.select("username", F.col("us").alias("right_us"), F.col("line_number").alias("other"))
    pairs = sorted((x["line_number"], x["other"]) for x in matching.interval_join(e, right, ["username"], 10).collect())
    assert pairs == sorted((i, j) for i, u, _, t in rows for j, v, _, s in rows if None not in (u, v, t, s) and u == v and t <= s <= t + 10_000_000)


def test_chain_of_the_case_where_no_source_has_one(spark):
    kinds = "source_ip string, hostname string, category string, rule_id string, mitre_ids array<string>, risk_score double, us long, line_number long"
    rows = [(f"1.1.1.{i}", None, "recon" if i % 2 else "auth", f"R{i}", None, 0.0, i, i) for i in range(12)]
    got = correlate.derived_chains(spark.createDataFrame(rows, kinds)).collect()
    assert [(r["chain_name"], r["source"], r["categories"], r["finding_count"], len(r["rules"])) for r in got] == [("Highest-risk detection path", "case", ["auth", "recon"], 10, 10)]
    risky = correlate.derived_chains(spark.createDataFrame([*rows, ("2.2.2.2", None, "recon", "X", None, 3.0, 1, 99)], kinds)).collect()
    assert [r["source"] for r in risky] == ["2.2.2.2"]
    assert correlate.derived_chains(spark.createDataFrame([], kinds)).collect() == []


def test_case_tables(spark, tmp_path):
    root = str(tmp_path)
    assert report.read(spark, "notes", root).count() == 0
    report.append(spark, "notes", [("s1", "ann", "look", 1)], root)
    report.append(spark, "notes", [("s1", "bob", "done", 2)], root)
    assert sorted(r["note"] for r in report.read(spark, "notes", root).collect()) == ["done", "look"]
    f = finding(spark, {"source_ip": "1.1.1.1", "hostname": "h"})
    report.append(spark, "risk_snapshots", report.risk_snapshot(f, 7), root)
    assert {(r["kind"], r["taken_us"]) for r in report.read(spark, "risk_snapshots", root).collect()} == {("ip", 7), ("host", 7)}
    report.save_report(f, f.select("id", F.lit("open").alias("action"), F.lit(1).alias("created_us")), f"{root}/r")
    assert spark.read.json(f"{root}/r/summary").first()["findings"] == 1
    report.save_graph(f, f"{root}/g")
    assert spark.read.parquet(f"{root}/g/nodes").count() == 2


def test_decoy_counts(spark):
    """Counted by value: equal to the hits for each token, with tokens of several values, shared values, and lines that hold a value twice."""
    lines = [(i, "f", "a", 0, x) for i, x in enumerate(["Abc abc", "xabcx", "de", "abde", "", "zz", "abc de"])]
    e = spark.createDataFrame(lines, "line_number long, source_file string, source_ip string, us long, raw_line string")
    d = spark.createDataFrame([("t1", "ABC"), ("t2", "abc"), ("t3", "ab"), ("t3", "de"), ("t4", "q"), ("t5", ""), ("t6", None), ("t7", "a")], "token_id string, value string")
    want = [("t1", 3, 0), ("t2", 3, 0), ("t3", 5, 0), ("t7", 4, 0)]
    assert sorted(tuple(r) for r in cases.decoy_counts(e, d).collect()) == want
    assert sorted(tuple(r) for r in cases.decoy_counts(e.union(e), d).collect()) == want


def test_decoys_within_longer_addresses(spark, tmp_path):
    """An address that is the beginning of another is held by lines of both, in the query and in its SQL."""
    import duckdb

    from emberlog import queries
    from emberlog.plans import oracle

    con = duckdb.connect()
    con.execute("create table events as select i::bigint as event_id, timestamp '2024-01-01' as ts, case when i % 2 = 0 then 4 else 254 end::bigint as user_id, 'view' as event_type, 1.0::double as value, '{\"k\": 7}' as props from range(10) r(i)")
    con.execute(f"copy events to '{tmp_path}/events.parquet' (format parquet)")
    want = [("t45.33.4.5", 10), ("t45.33.4.55", 5)]
    assert sorted(con.execute(oracle.SQL["decoy_hits"]).fetchall()) == want
    assert sorted(tuple(r) for r in queries.QUERIES["decoy_hits"](spark, str(tmp_path)).collect()) == want
