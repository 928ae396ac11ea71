"""Detection on small event tables, and stateful rules against plain state machines."""

import dataclasses
import random
import re
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from emberlog.operators import correlate, detect, search
from emberlog.rules.catalog import RULES
from emberlog.rules.model import C, Rule, pattern_of

S = 1_000_000
FIELDS = (
    "line_number long, source_file string, us long, source_ip string, dest_ip string, username string, hostname string, auth_result string, http_status int, http_method string, http_bytes long, "
    "http_uri string, http_uri_decoded string, http_user_agent string, message string, process_name string, event_id string, dest_port int, severity string, raw_line string, session_id string"
)
NAMES = [f.split()[0] for f in FIELDS.split(", ")]


def events(spark, rows):
    made = []
    for i, r in enumerate(rows):
        own = {"line_number": i, "source_file": "f", "source_ip": "45.1.1.1", "raw_line": f"line {i}", "session_id": "s"} | r
        made.append(tuple(own.get(n) for n in NAMES))
    return spark.createDataFrame(made, FIELDS).withColumn("timestamp", F.timestamp_micros("us"))


def rule(**k):
    return Rule("X", "x", "HIGH", "auth", 0.8, (), (), k.pop("type", "threshold"), **k)


def lines(df):
    return sorted(r["line_number"] for r in df.collect())


def test_catalog():
    assert len(RULES) == 162 and len({r.id for r in RULES}) == 162
    assert {t: sum(r.type == t for r in RULES) for t in ("regex", "threshold", "sequence")} == {"regex": 138, "threshold": 21, "sequence": 3}


def test_every_pattern_compiles(spark):
    for r in RULES:
        if r.pattern:
            re.compile(r.pattern)
            spark.range(1).select(F.lit("x").rlike(pattern_of(r))).collect()


def test_threshold(spark):
    r = rule(key="source_ip", count=5, seconds=60, where={"auth_result": "failure"})
    fail = [{"us": s * S, "auth_result": "failure"} for s in (0, 5, 10, 15, 25)]
    assert lines(detect.threshold_fires(events(spark, fail), r)) == [4]
    assert lines(detect.threshold_fires(events(spark, [x | {"auth_result": "success"} for x in fail]), r)) == []
    edge = [{"us": s * S, "auth_result": "failure"} for s in (0, 1, 2, 3, 60)]
    assert lines(detect.threshold_fires(events(spark, edge), r)) == [4]
    late = [{"us": s * S, "auth_result": "failure"} for s in (0, 1, 2, 3, 61)]
    assert lines(detect.threshold_fires(events(spark, late), r)) == []
    untimed = [*fail[:4], {"us": None, "auth_result": "failure"}]
    assert lines(detect.threshold_fires(events(spark, untimed), r)) == []


def test_distinct(spark):
    r = rule(key="source_ip", count=3, seconds=60, distinct="username")
    assert lines(detect.threshold_fires(events(spark, [{"us": 0, "username": u} for u in ("alice", "bob", None, "bob", "carol")]), r)) == [4]


def test_sequences(spark):
    root = rule(type="sequence", key="source_ip", seconds=300, steps=({"match_field": "auth_result", "value": "failure", "match_field2": "username", "value2": "root"}, {"match_field": "auth_result", "value": "success", "match_field2": "username", "value2": "root"}))
    rows = [{"us": 0, "auth_result": "failure", "username": "root"}, {"us": 10 * S, "auth_result": "success", "username": "root"}]
    assert lines(detect.sequence_fires(events(spark, rows), root)) == [1]
    assert lines(detect.sequence_fires(events(spark, [rows[0], rows[1] | {"source_ip": "9.9.9.9"}]), root)) == []
    three = rule(type="sequence", key="source_ip", seconds=300, steps=({"match_field": "auth_result", "value": "failure", "min_count": 3}, {"match_field": "auth_result", "value": "success"}))
    many = [{"us": i * S, "auth_result": "failure"} for i in range(3)] + [{"us": 4 * S, "auth_result": "success"}]
    assert lines(detect.sequence_fires(events(spark, many), three)) == [3]
    sudo = next(r for r in RULES if r.id == "PRIV-003")
    assert lines(detect.sequence_fires(events(spark, [{"us": 0, "message": "sudo -l"}, {"us": 30 * S, "message": "SUDO vi"}]), sudo)) == [1]


def test_composite(spark):
    failures = rule(key="source_ip", count=3, seconds=60, where={"auth_result": "failure"})
    shell = rule(type="regex", match_field="http_uri_decoded", pattern="(cmd|shell)=")
    both = C("X", "source_ip", 300, [failures, shell])
    rows = [{"us": i * S, "auth_result": "failure"} for i in range(3)] + [{"us": 10 * S, "http_uri_decoded": "/shell.php?cmd=id"}]
    got = detect.with_lines(events(spark, rows), detect.composite_fires(events(spark, rows), both)).collect()
    assert [(r["line_number"], r["event_count"], r["supporting_lines"]) for r in got] == [(3, 2, ["line 0", "line 1", "line 2"])]
    assert lines(detect.composite_fires(events(spark, rows[1:]), both)) == []
    assert lines(detect.composite_fires(events(spark, [*rows[:3], rows[3] | {"us": 303 * S}]), both)) == []
    either = C("X", "source_ip", 60, [rule(type="regex", match_field="http_uri_decoded", pattern=p) for p in ("union.*select", "<script>")], "or")
    assert lines(detect.composite_fires(events(spark, [{"us": 0, "http_uri_decoded": "/search?q='+UNION+SELECT+1--"}]), either)) == [0]


def test_evidence_and_indicators(spark):
    burst = [{"us": i * S, "http_status": 404, "http_uri": f"/{i}"} for i in range(30)]
    found = detect.detect(events(spark, [*burst, {"us": 99 * S, "http_uri_decoded": "/?q=<script>alert(1)", "http_user_agent": "x" * 600}])).collect()
    scan = next(r for r in found if r["rule_id"] == "RECON-002")
    assert len(scan["supporting_lines"]) == 10 and scan["supporting_lines"][-1] == scan["raw_line"]
    script = next(r for r in found if r["rule_id"] == "WEB-002")
    assert script["supporting_lines"] is None and script["indicators"]["matched_text"] == script["matched_text"]
    assert script["indicators"]["source_ip"] == "45.1.1.1" and all(v is not None and len(v) <= 500 for v in script["indicators"].values())


def test_one_key_with_many_events(spark):
    """A key without a gap: what is held does not grow with its events."""
    n = 300_000
    one = spark.range(n).selectExpr("id as line_number", "'f' as source_file", "id * 1000 as us", "'1.1.1.1' as source_ip", "cast(id % 3 as string) as username", "concat('l', id) as raw_line", "'failure' as auth_result")
    assert detect.fires(one, [rule(key="source_ip", count=10, seconds=3600, where={"auth_result": "failure"})]).count() == n // 10
    assert detect.fires(one, [rule(key="source_ip", count=4, seconds=3600, distinct="username")]).count() == 0


def naive_threshold(rows, n, width):
    held, out = {}, []
    for us, line, key in rows:
        d = held.setdefault(key, [])
        d[:] = [x for x in d if x >= us - width] + [us]
        if len(d) >= n:
            out.append(line)
            d.clear()
    return sorted(out)


def naive_distinct(rows, n, width):
    held, out = {}, []
    for us, line, key, v in rows:
        d = held.setdefault(key, [])
        d[:] = [x for x in d if x[0] >= us - width] + [(us, v)]
        if len({x for _, x in d if x}) >= n:
            out.append(line)
            d.clear()
    return sorted(out)


def test_against_state_machines(spark):
    r = random.Random(3)
    rows, us = [], 0
    for i in range(1500):
        us += r.choice([0, 1, 3, 20]) * S
        rows.append((us, i, f"1.1.1.{r.randrange(6)}", r.choice(["a", "b", "c", "d", None])))
    table = events(spark, [{"us": u, "source_ip": k, "username": v} for u, _, k, v in rows])
    for n, seconds in ((2, 10), (3, 40), (5, 120)):
        assert lines(detect.threshold_fires(table, rule(key="source_ip", count=n, seconds=seconds))) == naive_threshold([x[:3] for x in rows], n, seconds * S)
    for n, seconds in ((2, 30), (3, 60), (4, 200)):
        assert lines(detect.threshold_fires(table, rule(key="source_ip", count=n, seconds=seconds, distinct="username"))) == naive_distinct(rows, n, seconds * S)


def naive_bursts(rows, width):
    kept, out = {}, {}
    for us, line, key, text in rows:
        if key not in kept or us > kept[key][0] + width:
            kept[key] = us, line, text
        out.setdefault((key, kept[key][1]), []).append((text, line))
    return sorted((*k, len(v), len({t for t, _ in v} - {next(t for t, n in v if n == k[1])})) for k, v in out.items())


def test_bursts_against_a_plain_loop(spark):
    """Also across batches: 3 rows each."""
    r = random.Random(8)
    rows, us = [], 0
    for i in range(800):
        us += r.choice([0, 1, 5, 30]) * S
        rows.append((us, i, f"1.1.1.{r.randrange(4)}", f"t{r.randrange(5)}"))
    table = found(spark, [{"rule_id": "W", "us": u, "source_ip": k, "raw_line": t} for u, _, k, t in rows])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = detect.deduplicate(table, 60).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted((x["source"], x["line_number"], x["n_findings"], x["n_merged"]) for x in got) == naive_bursts(rows, 60 * S)


def test_a_burst_of_many_lines_is_counted_not_collected(spark):
    many = spark.range(5000).selectExpr("'W' as rule_id", "'f' as source_file", "'1.1.1.1' as source_ip", "cast(null as string) as hostname", "id as line_number", "id * 1000 as us", "concat('l', id) as raw_line")
    (one,) = detect.deduplicate(many, 60).collect()
    assert one["n_findings"] == 5000 and one["n_merged"] == 4999 and one["merged"] == list(range(1, detect.MEMBERS + 1))


def random_rule(r):
    seconds = r.choice([1, 3, 10, 40])
    kind = r.choice(["count", "distinct", "sequence"])
    if kind == "sequence":
        return rule(type="sequence", key="source_ip", seconds=seconds, steps=tuple({"match_field": "auth_result", "value": r.choice(["success", "failure"]), "min_count": r.randrange(1, 4)} for _ in range(r.randrange(1, 4))))
    return rule(key="source_ip", count=r.randrange(2, 6), seconds=seconds, where={} if r.random() < 0.5 else {"auth_result": "failure"}, distinct="username" if kind == "distinct" else None)


def plain_sequence(rows, one):
    """Tries each reset: whichever comes first, the steps met or an event past the window, makes the next."""
    out, start, anchor = [], 0, rows[0]["us"] if rows else None
    while start < len(rows):
        at, todo = start, [(s["value"], s.get("min_count", 1)) for s in one.steps]
        end = None
        while at < len(rows) and rows[at]["us"] <= anchor + one.seconds * S:
            if rows[at]["auth_result"] == todo[0][0]:
                todo[0] = (todo[0][0], todo[0][1] - 1)
                if not todo[0][1]:
                    todo.pop(0)
                    if not todo:
                        end = at
                        break
            at += 1
        if end is not None:
            out.append(rows[end]["n"])
            start, anchor = end + 1, rows[end]["us"]
        elif at < len(rows):
            start, anchor = at, rows[at]["us"]
        else:
            break
    return out


def plain_fires(rows, one):
    if one.type == "sequence":
        return plain_sequence(rows, one)
    out, last = [], -1
    for i, row in enumerate(rows):
        seen = [x for x in rows[last + 1 : i + 1] if x["us"] >= row["us"] - one.seconds * S and (not one.where or x["auth_result"] == "failure")]
        if one.where and row["auth_result"] != "failure":
            continue
        n = len({x["username"] for x in seen} - {None}) if one.distinct else len(seen)
        if n >= one.count and not (one.distinct and row["username"] is None):
            out.append(row["n"])
            last = i
    return out


def test_hot_keys_fold_by_chunks_as_whole(spark):
    """Random rules over keys of which one has most events: by chunks, in one task with small batches, and by definition."""
    r = random.Random(11)
    rows, us = [], 0
    for _ in range(1500):
        us += r.choice([0, 0, 1, 2, 8]) * S
        rows.append({"us": us, "source_ip": "1.1.1.1" if r.random() < 0.8 else f"1.1.1.{r.randrange(2, 6)}", "username": r.choice(["a", "b", "c", "d", "e", None]), "auth_result": r.choice(["success", "failure", None])})
    table = events(spark, rows)
    rules = [dataclasses.replace(random_rule(r), id=f"R{i}") for i in range(12)]
    for i, row in enumerate(rows):
        row["n"] = i
    want = sorted((one.id, n) for one in rules for ip in {x["source_ip"] for x in rows} for n in plain_fires([x for x in rows if x["source_ip"] == ip], one))
    facts = lambda df: sorted((x["rule_id"], x["line_number"], x["us"], x["event_count"], x["first_us"], tuple(x["evidence"])) for x in df.collect())
    whole = facts(detect.fires(table, rules))
    assert [x[:2] for x in whole] == want
    assert facts(detect.fires(table, rules, hot=200, chunk=100)) == whole
    assert facts(detect.fires(table, rules, hot=200, chunk=7)) == whole
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert facts(detect.fires(table, rules)) == whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def found(spark, rows):
    kinds = "rule_id string, severity string, category string, confidence double, risk_score double, source_ip string, us long, line_number long, raw_line string, source_file string, hostname string"
    names = [k.split()[0] for k in kinds.split(", ")]
    return spark.createDataFrame([tuple(({"line_number": i, "source_file": "f", "raw_line": f"l{i}"} | r).get(n) for n in names) for i, r in enumerate(rows)], kinds)


def test_bursts(spark):
    w = [{"rule_id": "W1", "source_ip": "1.1.1.1", "us": s * S} for s in (0, 5, 10)]
    got = detect.deduplicate(found(spark, w)).collect()
    assert len(got) == 1 and got[0]["merged"] == [1, 2] and got[0]["n_merged"] == 2
    assert detect.deduplicate(found(spark, [w[0], w[0] | {"us": 120 * S}])).count() == 2
    assert detect.deduplicate(found(spark, [w[0] | {"us": None}, w[0] | {"us": None}])).count() == 2


@pytest.mark.parametrize(
    ("categories", "chain"),
    [(("recon", "web_attack", "persistence"), "Full Web Compromise"), (("auth", "privilege_escalation", "impact"), "Full Compromise to Ransomware")],
)
def test_chains(spark, categories, chain):
    one = found(spark, [{"category": c, "source_ip": "1.1.1.1", "risk_score": 5.0} for c in categories])
    assert [r["chain_name"] for r in correlate.kill_chains(one).collect()] == [chain]
    other = found(spark, [{"category": c, "source_ip": f"1.1.1.{i}", "risk_score": 5.0} for i, c in enumerate(categories)])
    assert correlate.kill_chains(other).count() == 0


def test_confidence(spark):
    base = {"us": 0, "http_user_agent": "sqlmap/1.7", "http_status": 200, "http_method": "POST"}
    got = events(spark, [base, base | {"source_ip": "192.168.1.50", "http_user_agent": "x"}]).select("line_number", detect.confidence(F.lit(0.85), F.array(F.lit("TA0001"))).alias("c"))
    a, b = (r["c"] for r in got.orderBy("line_number").collect())
    assert 0.85 < a <= 1.0 and b < 0.85


def test_filters(spark):
    f = found(spark, [{"severity": s, "confidence": c, "category": "web_attack", "risk_score": 1.0} for s, c in (("CRITICAL", 0.9), ("HIGH", 0.8), ("MEDIUM", 0.7), ("LOW", 0.5))])
    assert search.hunt(f, min_severity="HIGH").count() == 2
    assert search.hunt(f, min_confidence=0.8).count() == 2
    with pytest.raises(ValueError):
        search.hunt(f, nonsense=1)


def test_web_log(spark):
    uris = ["/?id=1' or 1=1", "/?q=<script>alert(1)", "/../../etc/passwd"]
    hits = detect.regex_hits(events(spark, [{"us": i * S, "http_uri_decoded": u, "http_uri": u} for i, u in enumerate(uris)] + [{"us": 9 * S, "http_user_agent": "${jndi:ldap://x/a}"}]))
    ids = {r["rule_id"] for r in hits.collect()}
    assert {"WEB-001", "WEB-002", "WEB-003", "DISC-008"} <= ids
    burst = events(spark, [{"us": i * S, "http_status": 404} for i in range(30)])
    n = detect.stateful_hits(burst).where("rule_id = 'RECON-002'").count()
    assert 1 <= n < 30


def test_values_of_a_field_are_matched_once(spark):
    """Values that come again meet the patterns once, beside the events; with many values, row by row: equal hits."""
    from emberlog.plans.adapter import events as table

    e = table(spark, "/root/testdata/sf0.001")
    by_value, by_row = detect.regex_hits(e), detect.regex_hits(e, few=0)
    told = lambda df: sorted(tuple(r) for r in df.select("line_number", "rule_id", "matched_text").collect())
    assert told(by_value) == told(by_row) != []
    assert by_value.columns == by_row.columns
    # only the rules with conditions are still matched against each row
    spark.conf.set("spark.sql.debug.maxToStringFields", 10_000)
    patterns = lambda df: df._jdf.queryExecution().analyzed().toString().lower().count("rlike(")
    least = sum(1 for r in RULES if r.type == "regex" and r.where)
    assert patterns(by_row) >= 100 > 20 > patterns(by_value) >= least
