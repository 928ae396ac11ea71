"""Rules as data, and their predicates as columns."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    id: str
    name: str
    severity: str
    category: str
    confidence: float
    mitre: tuple[tuple[str, str], ...]
    indicators: tuple[str, ...]
    type: str
    where: dict = field(default_factory=dict, hash=False)
    match_field: str | None = None
    pattern: str | None = None
    key: str | None = None
    count: int | None = None
    seconds: int | None = None
    distinct: str | None = None
    steps: tuple = ()
    parts: tuple = ()  # of a composite: rules
    logic: str = "AND"
    about: dict = field(default_factory=dict, hash=False, compare=False)  # what a document says besides: description, tags, status, version, ...

    @property
    def tactics(self) -> list[str]:
        return list(dict.fromkeys(t for t, _ in self.mitre))

    @property
    def techniques(self) -> list[str]:
        return [t for _, t in self.mitre]


def _head(id, name, severity, category, confidence, mitre, indicators):
    return id, name, severity, category, confidence, tuple(tuple(x.split("/")) for x in mitre.split()), tuple(indicators.split())


def R(*a) -> Rule:
    """head..., field, pattern[, filter]"""
    return Rule(*_head(*a[:7]), "regex", a[9] if len(a) > 9 else {}, match_field=a[7], pattern=a[8])


def T(*a) -> Rule:
    """head..., key, count, seconds, filter, distinct field or None"""
    return Rule(*_head(*a[:7]), "threshold", a[10], key=a[7], count=a[8], seconds=a[9], distinct=a[11])


def S(*a) -> Rule:
    """head..., key, seconds, steps"""
    return Rule(*_head(*a[:7]), "sequence", key=a[7], seconds=a[8], steps=tuple(a[9]))


def C(id, key, seconds, parts, logic="AND", name="", severity="HIGH", category="correlation", confidence=0.8) -> Rule:
    """A composite: parts are rules over the same key."""
    return Rule(id, name or id, severity, category, confidence, (), (), "composite", key=key, seconds=seconds, parts=tuple(parts), logic=logic.upper())


def column_of(name: str) -> Column:
    """A field of an event by name; extra.k is the value that the map extra has for k, or, where k is a path, what the JSON text of its first name holds there."""
    first, _, rest = name.partition(".")
    if not rest:
        return F.col(name)
    value = F.col(first).getItem(rest)
    name, _, path = rest.partition(".")
    return F.coalesce(value, F.get_json_object(F.col(first).getItem(name), f"$.{path}")) if path else value


def event_filter(where: dict) -> Column:
    """All conditions of a rule's filter; a missing value never meets one."""
    out = F.lit(True)
    for k, v in where.items():
        if k == "http_method":
            c = F.upper("http_method") == str(v).upper()
        elif k.endswith("_contains"):
            c = F.lower(F.coalesce(column_of(k.removesuffix("_contains")), F.lit(""))).contains(str(v).lower())
        elif k == "severity_in":
            c = F.upper("severity").isin([str(x).upper() for x in v])
        elif k.endswith("_in"):
            c = column_of(k.removesuffix("_in")).isin(list(v))
        else:
            c = column_of(k).cast("string") == str(v)
        out = out & F.coalesce(c, F.lit(False))
    return out


def pattern_of(rule: Rule) -> str:
    """The pattern for Java: case-insensitive, by Unicode's cases."""
    return "(?iu)" + rule.pattern.replace("(?i)", "")


def indicators_of(rule: Rule, columns) -> list[str]:
    """The fields that a rule names for its findings and that there are."""
    return [f for f in rule.indicators if f in columns]


def matches(rule: Rule) -> Column:
    """Cheap conditions first; a null field matches nothing."""
    value = column_of(rule.match_field).cast("string")
    return event_filter(rule.where) & F.coalesce(value.rlike(pattern_of(rule)), F.lit(False))


def step_matches(step: dict) -> Column:
    value = column_of(step["match_field"]).cast("string")
    if "value_contains" in step:
        c = F.lower(value).contains(str(step["value_contains"]).lower())
    else:
        c = value == str(step["value"])
    if "match_field2" in step:
        c = c & (column_of(step["match_field2"]).cast("string") == str(step["value2"]))
    return F.coalesce(c, F.lit(False))
