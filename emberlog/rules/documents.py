"""Rules as documents: YAML or JSON, one list of rules each, and rules back as documents.

A document is a mapping with a list under rules. What is wrong in one is told by the rule's id; nothing is left out silently.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable

from pyspark.sql import SparkSession

from ..functions.core import SEVERITIES
from .model import Rule

#: what each type needs, and what any rule may say
NEEDS = {"regex": ("match_field", "pattern"), "threshold": ("group_by", "count", "window_secs"), "sequence": ("group_by", "steps"), "composite": ("sub_rules",)}
MAY = {"filter", "count_distinct", "logic", "mitre", "indicators", "confidence", "severity", "category", "type", "window_secs", "group_by"}
ABOUT = {"description", "tags", "status", "version", "author", "created", "modified", "references", "false_positives", "owner", "enabled"}
STEP = {"match_field", "value", "value_contains", "match_field2", "value2", "min_count", "must_follow", "window_secs"}
# What is taken where a document says nothing, and the size of a pattern
WINDOWS = {"sequence": 300, "composite": 600}
CONFIDENCE, SEVERITY, CATEGORY, KEY = 0.75, "MEDIUM", "unknown", "source_ip"
LONGEST, GROUPS, BRANCHES = 6000, 120, 600


class RuleError(ValueError):
    """Names every rule that is wrong, and why."""


def rules_of(documents: Iterable[dict]) -> list[Rule]:
    """All rules of some documents; raises RuleError if any is wrong or an id is given twice."""
    out, wrong, seen = [], [], set()
    for n, document in enumerate(documents):
        if not isinstance(document, dict) or not isinstance(document.get("rules"), list):
            wrong.append(f"document {n}: no list under rules")
            continue
        for k, one in enumerate(document["rules"]):
            name = str(one.get("id") if isinstance(one, dict) and one.get("id") else f"rule {k} of document {n}")
            problems = _problems(one)
            if name in seen:
                problems.append("the id is given twice")
            seen.add(name)
            if problems:
                wrong.append(f"{name}: {'; '.join(problems)}")
            else:
                out.append(_rule(one))
    if wrong:
        raise RuleError("\n".join(wrong))
    return out


def parsed(text: str, yaml: bool) -> dict:
    if not yaml:
        return json.loads(text)
    from yaml import safe_load

    return safe_load(text)


def read_rules(spark: SparkSession, path: str) -> list[Rule]:
    """The rules of all .yaml, .yml and .json files in a folder that Spark can read, in order of their names."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.{yaml,yml,json}").selectExpr("_metadata.file_path as path", "value").orderBy("path").collect()
    documents, wrong = [], []
    for file in files:
        try:
            documents.append(parsed(file["value"], not file["path"].endswith(".json")))
        except Exception as e:
            wrong.append(f"{file['path']}: {e}")
    if wrong:
        raise RuleError("\n".join(wrong))
    return rules_of(documents)


def _problems(one, part: bool = False) -> list[str]:
    if not isinstance(one, dict):
        return ["no mapping"]
    kind = one.get("type", "regex")
    if kind not in NEEDS:
        return [f"unknown type {kind!r}"]
    out = [f"{k} is missing" for k in (() if part else ("id", "name")) + NEEDS[kind] if one.get(k) in (None, "", [])]
    known = MAY | ABOUT | {"id", "name"} | set(NEEDS[kind])
    out += [f"{k} is not known for {kind}" for k in one if k not in known]
    if str(one.get("severity", SEVERITY)).upper() not in SEVERITIES:
        out.append(f"unknown severity {one['severity']!r}")
    if not isinstance(one.get("confidence", CONFIDENCE), (int, float)) or not 0 <= one.get("confidence", CONFIDENCE) <= 1:
        out.append("confidence is not within 0 and 1")
    for k in ("count", "window_secs"):
        if one.get(k) is not None and (not isinstance(one[k], int) or isinstance(one[k], bool) or one[k] < 1):
            out.append(f"{k} is not a number from 1 on")
    if not isinstance(one.get("filter") or {}, dict):
        out.append("filter is no mapping")
    if kind == "regex" and isinstance(one.get("pattern"), str):
        out += _pattern_problems(_clean(one["pattern"]))
    for k, step in enumerate(one.get("steps") or []) if kind == "sequence" else ():
        if not isinstance(step, dict) or "match_field" not in step or not {"value", "value_contains"} & set(step):
            out.append(f"step {k} needs match_field, and value or value_contains")
        elif extra := set(step) - STEP:
            out.append(f"step {k}: {', '.join(sorted(extra))} not known")
    if kind == "composite":
        if str(one.get("logic", "AND")).upper() not in ("AND", "OR"):
            out.append("logic is neither AND nor OR")
        for k, own in enumerate(one.get("sub_rules") or []):
            if isinstance(own, dict) and own.get("type") == "composite":
                out.append(f"part {k}: a composite has no composite parts")
            else:
                out += [f"part {k}: {x}" for x in _problems(own, True)]
    return out


def _clean(pattern: str) -> str:
    """White space that comes from folding a document's lines is no part of a pattern."""
    return re.sub(r"\s+", "", pattern)


def _pattern_problems(pattern: str) -> list[str]:
    if len(pattern) > LONGEST or pattern.count("(") > GROUPS or pattern.count("|") > BRANCHES:
        return ["the pattern is too large"]
    try:
        re.compile(pattern)
    except re.error as e:
        return [f"the pattern is wrong: {e}"]
    # a repeated group that holds a repetition can take time without end
    plain = re.sub(r"\[(?:\\.|[^\]\\])*\]", "x", pattern)
    return ["the pattern repeats a group that repeats"] if re.search(r"\((?:\\.|[^()\\])*[+*](?:\\.|[^()\\])*\)(?:[+*]|\{\d*,?\d*\})", plain) else []


def _rule(one: dict, key: str | None = None, name: str = "") -> Rule:
    kind, rule_id = one.get("type", "regex"), str(one.get("id") or name)
    own_key = one.get("group_by") or key or (KEY if kind == "composite" else None)
    mitre = tuple((t.get("tactic_id", ""), f"{t.get('technique_id', '')}{t.get('sub_technique') or ''}") for t in one.get("mitre") or [])
    return Rule(
        rule_id, str(one.get("name") or rule_id), str(one.get("severity", SEVERITY)).upper(), one.get("category", CATEGORY), float(one.get("confidence", CONFIDENCE)), mitre, tuple(one.get("indicators") or ()), kind,
        dict(one.get("filter") or {}), one.get("match_field"), _clean(one["pattern"]) if one.get("pattern") else None, own_key, one.get("count"), one.get("window_secs") or WINDOWS.get(kind), one.get("count_distinct"),
        tuple(one.get("steps") or ()), tuple(_rule(x, own_key, f"{rule_id}.{k}") for k, x in enumerate(one.get("sub_rules") or [])), str(one.get("logic", "AND")).upper(), {k: v for k, v in one.items() if k in ABOUT},
    )


def document_of(rule: Rule) -> dict:
    """A rule as it stands in a document."""
    split = [re.fullmatch(r"(.*?)(\.\d{3})?", t) for _, t in rule.mitre]
    mitre = [{"tactic_id": a, "technique_id": m[1]} | ({"sub_technique": m[2]} if m[2] else {}) for (a, _), m in zip(rule.mitre, split, strict=True)]
    out = {"id": rule.id, "name": rule.name, "severity": rule.severity, "category": rule.category, "confidence": rule.confidence, "type": rule.type, "mitre": mitre, "indicators": list(rule.indicators)}
    more = {"filter": rule.where, "match_field": rule.match_field, "pattern": rule.pattern, "group_by": rule.key, "count": rule.count, "window_secs": rule.seconds, "count_distinct": rule.distinct, "steps": [dict(s) for s in rule.steps]}
    out |= {k: v for k, v in more.items() if v}
    if rule.type == "composite":
        out |= {"sub_rules": [document_of(p) for p in rule.parts], "logic": rule.logic}
    return out | rule.about
