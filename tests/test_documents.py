"""Rules as documents."""

import dataclasses
import json

import pytest
from test_detect import S, events, lines, rule

from emberlog.functions import core
from emberlog.operators import detect
from emberlog.rules.catalog import RULES
from emberlog.rules.documents import RuleError, document_of, parsed, read_rules, rules_of
from emberlog.rules.model import C


def test_all_rules_as_documents(spark, tmp_path):
    """Written as YAML and as JSON, and read again, they are the same; so are their findings."""
    yaml = pytest.importorskip("yaml")
    half = len(RULES) // 2
    (tmp_path / "a.yaml").write_text(yaml.safe_dump({"rules": [document_of(r) for r in RULES[:half]]}))
    (tmp_path / "b.json").write_text(json.dumps({"rules": [document_of(r) for r in RULES[half:]]}))
    (tmp_path / "notes.txt").write_text("no rules")
    got = read_rules(spark, str(tmp_path))
    plain = lambda r: dataclasses.replace(r, where={k: list(v) if isinstance(v, (list, tuple)) else v for k, v in r.where.items()}, pattern=r.pattern and "".join(r.pattern.split()), steps=tuple(dict(s) for s in r.steps))
    assert [plain(r) for r in got] == [plain(r) for r in RULES]
    e = events(spark, [{"us": i * S, "http_status": 404, "http_uri_decoded": "/?q=<script>alert(1)" if i % 3 else "/../../etc/passwd"} for i in range(30)])
    facts = lambda rules: sorted((x["rule_id"], x["line_number"], x["risk_score"]) for x in detect.detect(e, rules).collect())
    assert facts(got) == facts(RULES) and {"RECON-002", "WEB-002"} <= {x[0] for x in facts(got)}


def test_folded_patterns_and_lifecycle():
    pytest.importorskip("yaml")
    text = """
rules:
  - id: A-1
    name: two
    description: told in a line
    status: experimental
    version: 3
    tags: [x, y]
    match_field: message
    pattern: >
      (?i)(one|
      two)
    mitre:
      - {tactic_id: TA0001, technique_id: T1078, sub_technique: ".004"}
"""
    (one,) = rules_of([parsed(text, True)])
    assert one.pattern == "(?i)(one|two)" and one.type == "regex" and one.confidence == 0.75 and one.severity == "MEDIUM" and one.category == "unknown"
    assert one.mitre == (("TA0001", "T1078.004"),) and one.about == {"description": "told in a line", "status": "experimental", "version": 3, "tags": ["x", "y"]}
    assert rules_of([{"rules": [document_of(one)]}]) == [one]


GOOD = {"id": "G-1", "name": "g", "match_field": "message", "pattern": "x"}
BAD = {
    "type": ({**GOOD, "type": "magic"}, "unknown type"), "missing": ({"id": "B", "name": "b", "type": "threshold", "group_by": "source_ip", "count": 3}, "window_secs is missing"), "severity": ({**GOOD, "severity": "URGENT"}, "unknown severity"),
    "confidence": ({**GOOD, "confidence": 7}, "confidence"), "count": ({"id": "B", "name": "b", "type": "threshold", "group_by": "source_ip", "count": 0, "window_secs": 5}, "count"), "typo": ({**GOOD, "mach_field": "x"}, "mach_field is not known"),
    "pattern": ({**GOOD, "pattern": "(a"}, "pattern is wrong"), "endless": ({**GOOD, "pattern": "(a+)+b"}, "repeats a group"), "large": ({**GOOD, "pattern": "a" * 7000}, "too large"), "steps": ({"id": "B", "name": "b", "type": "sequence", "group_by": "u", "steps": [{"value": "x"}]}, "step 0"),
    "nested": ({"id": "B", "name": "b", "type": "composite", "sub_rules": [{"type": "composite", "sub_rules": [GOOD]}]}, "part 0"), "part": ({"id": "B", "name": "b", "type": "composite", "sub_rules": [{"type": "regex", "match_field": "m"}]}, "part 0: pattern is missing"),
    "twice": (GOOD, "given twice"), "shape": ("x", "no mapping"),
}


@pytest.mark.parametrize("name", BAD)
def test_wrong_documents_are_named(name):
    bad, what = BAD[name]
    with pytest.raises(RuleError, match=what) as e:
        rules_of([{"rules": [GOOD, bad]}, {"rules": [{**GOOD, "id": "G-2"}]}])
    assert str(e.value).count("\n") == 0 and "G-2" not in str(e.value)
    with pytest.raises(RuleError, match="document 0"):
        rules_of([{"rule": []}])


def test_composites_come_from_documents(spark):
    own = C("X", "source_ip", 300, [rule(key="source_ip", count=3, seconds=60, where={"auth_result": "failure"}), rule(type="regex", match_field="http_uri_decoded", pattern="(cmd|shell)=")])
    (got,) = rules_of([{"rules": [document_of(own)]}])
    rows = [{"us": i * S, "auth_result": "failure"} for i in range(3)] + [{"us": 10 * S, "http_uri_decoded": "/shell.php?cmd=id"}]
    assert lines(detect.composite_fires(events(spark, rows), got)) == [3]


def test_fields_in_extra(spark):
    rows = spark.createDataFrame([(1, {"logon": "3", "deep": '{"a": {"b": "yes"}}'}), (2, {"logon": "2"}), (3, None), (4, {"logon.x": "q"})], "line_number long, extra map<string,string>")
    e = rows.selectExpr("*", "'f' as source_file", "line_number * 1000000 as us", "'raw' as raw_line")
    one = lambda **k: rule(type="regex", **k)
    hits = lambda r: sorted(x["line_number"] for x in detect.regex_hits(e, [r]).collect())
    assert hits(one(match_field="extra.logon", pattern="^[23]$")) == [1, 2]
    assert hits(one(match_field="extra.logon", pattern=".", where={"extra.deep.a.b": "yes"})) == [1]
    assert hits(one(match_field="extra.logon.x", pattern="q")) == [4]
    assert lines(detect.threshold_fires(e, rule(key="extra.logon", count=1, seconds=5))) == [1, 2]


def test_sql_functions(spark):
    core.register_sql_functions(spark)
    row = spark.sql("select same_subnet('10.1.2.3', '10.1.9.9', 16) a, same_subnet('10.1.2.3', '10.2.9.9', 16) b, same_subnet('x', '10.1.2.3', 8) c, is_tor_exit('185.220.101.4') d, is_tor_exit('8.8.8.8') e, ipv4s_in('from 1.2.3.4 to 5.6.7.8 and 1.2.3.4, not 999.1.1.1') f").first()
    assert (row["a"], row["b"], row["c"], row["d"], row["e"]) == (True, False, None, True, False) and row["f"][:2] == ["1.2.3.4", "5.6.7.8"]
