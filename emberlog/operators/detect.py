"""Detection: patterns, thresholds, sequences and composites over events, and what follows on findings.

Pattern rules are one projection. Rules with state are chains over each key's events in order (chains.py). Rows without a timestamp take no part in them.
"""

from __future__ import annotations

from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import core
from ..rules.catalog import RULES, TACTICS
from ..rules.model import Rule, column_of, event_filter, indicators_of, matches, pattern_of, step_matches
from . import chains, hot_keys, shared

SECOND = 1_000_000
CHUNK = 16  # patterns in one array, so that generated methods stay small
HITS = "array<struct<rule_id:string,matched_text:string>>"
VALUES_OF_A_TASK, VALUE_TASKS = 5_000, 2_000  # distinct values that one task matches, about, and tasks at most
# Names of scanning tools
TOOLS = "sqlmap|nikto|nessus|openvas|masscan|nmap|nuclei|dirbuster|gobuster|feroxbuster|hydra|medusa|burpsuite|metasploit|zgrab"


def rules_table(spark, rules=RULES) -> DataFrame:
    rows = [(r.id, r.name, r.severity, r.category, r.confidence, r.tactics, [TACTICS.get(t, t) for t in r.tactics], r.techniques) for r in rules]
    return spark.createDataFrame(rows, "rule_id string, rule_name string, severity string, category string, base_confidence double, tactic_ids array<string>, tactic_names array<string>, mitre_ids array<string>")


def regex_hits(events: DataFrame, rules=None, few: int = shared.ROWS) -> DataFrame:
    """One row for each event and pattern rule that it meets: the event's columns, rule_id, matched_text (200 characters at most).

    A rule without conditions looks at one field, so each distinct value of a field is matched once, by all cores, and the values that meet a rule are
    broadcast to the events. That is done for fields with few distinct values, as a sketch counts them; values of other fields, rules
    with conditions and streams are matched row by row.
    """
    rules = tuple(r for r in (rules or RULES) if r.type == "regex")
    rows = shared.spread(events)
    application = rows.sparkSession.sparkContext.applicationId
    known = {} if rows.isStreaming else _hits_by_value(rows, rules, few, application)
    each = [_hits_of(direct, None, application)] if (direct := tuple(r for r in rules if r.where or r.match_field not in known)) else []
    wide = rows
    for i, (name, table) in enumerate((n, t) for n, t in known.items() if t is not None):
        wide = wide.join(F.broadcast(table.toDF(f"_value{i}", f"_hits{i}")), column_of(name).cast("string") == F.col(f"_value{i}"), "left")
        each.append(F.coalesce(f"_hits{i}", F.array().cast(HITS)))
    hits = F.flatten(F.array(*each)) if each else F.array().cast(HITS)
    return wide.select(*rows.columns, F.explode(hits).alias("_hit")).select(*rows.columns, "_hit.*")


def _hits_by_value(rows: DataFrame, rules: tuple[Rule, ...], few: int, application: str) -> dict[str, DataFrame | None]:
    """For each field with few distinct values: a written table of those that meet rules without conditions, with their hits; None where no value does."""
    by: dict[str, list[Rule]] = {}
    for r in rules:
        if not r.where:
            by.setdefault(r.match_field, []).append(r)
    if not by:
        return {}
    names = list(by)
    value = {n: column_of(n).cast("string") for n in names}
    counted = rows.agg(*[F.approx_count_distinct(value[n]).alias(f"n{i}") for i, n in enumerate(names)]).first()
    names = [n for i, n in enumerate(names) if counted[i] <= few]
    if not names:
        return {}
    distinct = rows.select(F.explode(F.array(*[F.struct(F.lit(i).alias("field"), value[n].alias("value")) for i, n in enumerate(names)])).alias("x")).select("x.*").where("value is not null").distinct()
    # written, as a condition on values would else be moved before their distinction, to each row
    distinct = shared.written(distinct, "pattern-values")
    tasks = min(VALUE_TASKS, max(rows.sparkSession.sparkContext.defaultParallelism, distinct.count() // VALUES_OF_A_TASK))
    hits = F.array().cast(HITS)
    for i, n in enumerate(names):
        hits = F.when(F.col("field") == i, _hits_of(tuple(by[n]), "value", application)).otherwise(hits)
    met = distinct.repartition(tasks, "field", "value").select("field", "value", hits.alias("hits")).where(F.size("hits") > 0)
    met = shared.written(met, "pattern-hits")
    have = {r[0] for r in met.select("field").distinct().collect()}
    return {n: met.where(F.col("field") == i).select("value", "hits") if i in have else None for i, n in enumerate(names)}


@lru_cache(64)
def _hits_of(rules: tuple[Rule, ...], column: str | None, application: str) -> Column:
    """An array of the rules that a row meets; of a value, by the name of its column, where there is no row. Kept, as building it takes seconds."""
    arrays = []
    for at in range(0, len(rules), CHUNK):
        hits = []
        for r in rules[at : at + CHUNK]:
            value = (column_of(r.match_field) if column is None else F.col(column)).cast("string")
            meets = matches(r) if column is None else F.coalesce(value.rlike(pattern_of(r)), F.lit(False))
            hits.append(F.when(meets, F.struct(F.lit(r.id).alias("rule_id"), F.substring(F.regexp_extract(value, pattern_of(r), 0), 1, 200).alias("matched_text"))))
        arrays.append(F.array_compact(F.array(*hits)))
    return F.flatten(F.array(*arrays))


def confidence(base, tactics: Column, event_count=None) -> Column:
    """The rule's confidence, moved by what the event shows, within 0 and 1."""
    ip = F.coalesce("source_ip", F.lit(""))
    inside = core.is_internal("source_ip")
    add = lambda cond, x: F.when(F.coalesce(cond, F.lit(False)), x).otherwise(0.0)
    total = (
        core.c(base)
        + add(F.col("http_user_agent").rlike(f"(?i)({TOOLS})"), 0.10)
        + add((ip != "") & ~inside, 0.08)
        + add((F.col("http_status") == 200) & F.col("http_method").isin("POST", "GET"), 0.08)
        + add(F.col("auth_result") == "failure", 0.05)
        + add(F.size(tactics) > 1, 0.05)
        - add(inside, 0.15)
    )
    if event_count is not None:
        total = total - add((core.c(event_count) > 0) & (core.c(event_count) < 3), 0.10)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), total))


def findings(hits: DataFrame, asset: float = 1.0) -> DataFrame:
    """Findings of hits: the rule's columns, confidence, risk, and an id that is a hash of what names the finding; the event's own severity is event_severity."""
    hits = hits.withColumnRenamed("severity", "event_severity")
    count = "event_count" if "event_count" in hits.columns else None
    joined = hits.join(F.broadcast(rules_table(hits.sparkSession)), "rule_id")
    out = joined.withColumn("confidence", F.round(confidence("base_confidence", F.col("tactic_ids"), count), 4)).withColumn("risk_score", core.risk_score("severity", "confidence", asset))
    return out.withColumn("id", F.sha2(F.concat_ws(":", "source_file", "rule_id", F.col("line_number").cast("string")), 256))


FIRES = "source_file string, key string, rule_id string, line_number long, us long, event_count int, first_us long, evidence array<long>"
BITS = 60  # flags of one event that are carried in a number


def _flags(rule: Rule) -> list[Column]:
    """One flag for each step, or one that tells whether the rule sees the event."""
    if rule.type == "sequence":
        return [step_matches(s) for s in rule.steps]
    return [matches(rule) if rule.type == "regex" else event_filter(rule.where)]


def columns_of(rules: list[Rule]) -> tuple[list[Column], list[Column], list[chains.Plan]]:
    """Flags and values of an event that rules look at, and each rule with the places of its own."""
    flags, values, plans = [], [], []
    for rule in rules:
        own = []
        for part in rule.parts if rule.type == "composite" else (rule,):
            f = _flags(part)
            own.append((len(flags), (1 << len(f)) - 1, len(values) if part.distinct else None))
            flags += f
            if part.distinct:
                values.append(column_of(part.distinct).cast("string"))
        plans.append(chains.Plan(rule, own))
    return flags, values, plans


def mask_of(flags: list[Column]) -> Column:
    return sum((F.when(f, F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, f in enumerate(flags)), F.lit(0).cast("long"))


def window_of(rule: Rule) -> int:
    """The longest time, in microseconds, that a rule's state looks back."""
    return SECOND * sum(r.seconds or 0 for r in (rule, *rule.parts))


def _groups(rules: list[Rule]) -> list[list[Rule]]:
    """Rules of one key, as many as have flags for one number."""
    groups: dict[str, list[list[Rule]]] = {}
    for r in rules:
        mine = groups.setdefault(r.key, [[]])
        if len(columns_of([*mine[-1], r])[0]) > BITS:
            mine.append([])
        mine[-1].append(r)
    return [g for mine in groups.values() for g in mine]


def seen_by(events: DataFrame, rules: list[Rule]) -> tuple[DataFrame, list[chains.Plan], int]:
    """source_file, key, us, line_number, mask and values v0, v1, ... of the events that rules of one key see; and the rules' plans.

    Events without a time or without the key take no part, and events that no rule sees stay out unless a sequence's window may begin with them.
    """
    flags, values, plans = columns_of(rules)
    key = column_of(rules[0].key).cast("string")
    rows = events.where(F.col("us").isNotNull() & key.isNotNull() & (key != ""))
    rows = rows.select("source_file", key.alias("key"), F.col("us").cast("long").alias("us"), F.col("line_number").cast("long").alias("line_number"), mask_of(flags).alias("mask"), *[v.alias(f"v{i}") for i, v in enumerate(values)])
    if not any(part.type == "sequence" for plan in plans for part in plan.parts):
        rows = rows.where("mask <> 0")
    return rows, plans, len(values)


def fires(events: DataFrame, rules: list[Rule], hot: int = hot_keys.HOT, chunk: int = hot_keys.CHUNK) -> DataFrame:
    """FIRES rows of threshold, sequence and composite rules; one source file never counts with another. evidence: numbers of the last lines that led to a fire.

    All rules of one key run in one pass over its sorted events: Spark deals the events by key and sorts them, and only what the rules look at is
    dealt, no lines. See chains.py for what a task does. Keys with more than hot events are counted first, and their thresholds are folded by
    chunks on all cores (hot_keys.py); their sequences and composites take one task each, in bounded memory.
    """
    parts = []
    for group in _groups(rules):
        rows, plans, values = seen_by(events, group)
        thresholds = [p for p in plans if p.rule.type == "threshold"]
        cuts = hot_keys.hot_keys(rows, hot, chunk) if thresholds else None
        if cuts is None:
            parts.append(_folded(rows, plans, values))
            continue
        others = [p for p in plans if p.rule.type != "threshold"]
        few = shared.small(cuts.select(*hot_keys.KEYS))
        parts += [_folded(rows.join(few, hot_keys.KEYS, "left_anti"), plans, values), hot_keys.fires(rows, cuts, thresholds, values, fires_batch, FIRES)]
        if others:
            parts.append(_folded(rows.join(few, hot_keys.KEYS, "left_semi"), others, values))
    return reduce(DataFrame.unionByName, parts) if parts else events.sparkSession.createDataFrame([], FIRES)


def _folded(rows: DataFrame, plans: list[chains.Plan], values: int) -> DataFrame:
    keys = hot_keys.KEYS

    def scan(batches):
        for found in chains.scanned(batches, keys, plans, values):
            if found:
                yield fires_batch(found)

    return rows.repartition(*keys).sortWithinPartitions(*keys, "us", "line_number").mapInArrow(scan, FIRES)


def fires_batch(found: list[tuple]) -> pa.RecordBatch:
    source, key, rule, fired = zip(*found, strict=True)
    line, us, count, first, evidence = zip(*fired, strict=True)
    kinds = [pa.string()] * 3 + [pa.int64()] * 2 + [pa.int32(), pa.int64(), pa.list_(pa.int64())]
    columns = [source, key, rule, line, us, count, first, evidence]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["source_file", "key", "rule_id", "line_number", "us", "event_count", "first_us", "evidence"])


def with_lines(events: DataFrame, found: DataFrame) -> DataFrame:
    """Fires with supporting_lines: the lines of their evidence, in order. The fires are written once; where few (they are counted), they are broadcast and no event is shuffled."""
    found = shared.written(found, "fires")
    wanted = found.select("source_file", "rule_id", "key", F.col("line_number").alias("_at"), F.posexplode("evidence").alias("_place", "line_number"))
    lines = events.select("source_file", F.col("line_number").cast("long").alias("line_number"), "raw_line").join(shared.small(wanted), ["source_file", "line_number"])
    each = lines.groupBy("source_file", "rule_id", "key", "_at", "_place").agg(F.min("raw_line").alias("line"))
    own = each.groupBy("source_file", "rule_id", "key", F.col("_at").alias("line_number")).agg(F.transform(F.array_sort(F.collect_list(F.struct("_place", "line"))), lambda x: x["line"]).alias("supporting_lines"))
    return found.join(own, ["source_file", "rule_id", "key", "line_number"], "left")


def threshold_fires(events: DataFrame, rule: Rule) -> DataFrame:
    """FIRES of one threshold: count events (or distinct values) of one key within the window, both ends included; then it begins anew."""
    return fires(events, [rule])


def sequence_fires(events: DataFrame, rule: Rule) -> DataFrame:
    """FIRES of one sequence of steps; see chains.Steps."""
    return fires(events, [rule])


def composite_fires(events: DataFrame, rule: Rule) -> DataFrame:
    """FIRES of a composite, whose parts are pattern, threshold or sequence rules over its key: all of them within its window, or any. A part that has fired counts until the window after it has passed, and hears nothing meanwhile."""
    return fires(events, [rule])


def stateful_hits(events: DataFrame, rules=None) -> DataFrame:
    """Hits of all rules with state: the firing event's columns, rule_id, event_count, first_us and supporting_lines, the last lines that led to it."""
    found = with_lines(events, fires(events, [r for r in rules or RULES if r.type != "regex"]))
    found = found.select("source_file", "line_number", "event_count", "first_us", "rule_id", "supporting_lines")
    return events.join(shared.small(found), ["source_file", "line_number"])


def detect(events: DataFrame, rules=None) -> DataFrame:
    """All findings of all rules, with indicators, and supporting_lines where a rule has state."""
    return with_indicators(findings(regex_hits(events, rules).unionByName(stateful_hits(events, rules), allowMissingColumns=True)), rules)


def with_indicators(found: DataFrame, rules=None) -> DataFrame:
    """Adds indicators, a map of the fields that each rule names (500 characters at most, none that is null), and matched_text."""
    by: dict[tuple, list[str]] = {}
    for r in rules or RULES:
        by.setdefault(tuple(indicators_of(r, found.columns)), []).append(r.id)
    groups = tuple((fields, tuple(ids)) for fields, ids in by.items())
    return found.withColumn("indicators", _indicators(groups, "matched_text" in found.columns, found.sparkSession.sparkContext.applicationId))


@lru_cache(16)
def _indicators(groups: tuple, text: bool, application: str) -> Column:
    pair = lru_cache(None)(lambda f: F.when(F.col(f).isNotNull(), F.struct(F.lit(f).alias("k"), F.substring(F.col(f).cast("string"), 1, 500).alias("v"))))
    out = F.array().cast("array<struct<k:string,v:string>>")
    for fields, ids in groups:
        pairs = [pair(f) for f in (*fields, *(["matched_text"] if text else []))]
        if pairs:
            out = F.when(F.col("rule_id").isin(*ids), F.array_compact(F.array(*pairs))).otherwise(out)
    return F.map_from_entries(out)


MEMBERS = 20  # lines of a burst that are named; all are counted


def bursts(found: DataFrame, seconds: int = 60) -> DataFrame:
    """Findings by burst: source_file, rule_id, source, line_number and us of the one that is kept, kept_hash, and member_line, member_us and member_hash (of its line) of each that is in it, the kept one too.

    Of each rule and source, in order of time, a finding more than the window after the one kept last is kept. A finding without a time is a burst of its own.
    """
    source = F.coalesce("source_ip", "hostname", F.lit("?"))
    line, us, text = F.col("line_number").cast("long"), F.col("us").cast("long"), F.xxhash64("raw_line")
    rows = found.select("source_file", "rule_id", source.alias("source"), line.alias("member_line"), us.alias("member_us"), text.alias("member_hash"))
    keys = ["source_file", "rule_id", "source"]
    schema = f"{', '.join(f'{k} string' for k in keys)}, line_number long, us long, kept_hash long, member_line long, member_us long, member_hash long"

    def scan(batches):
        now, open_burst, kept = None, chains.Bursts(seconds * SECOND), None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(k) for k in keys]
            line, us, text = (batch.column(c).to_numpy() for c in ("member_line", "member_us", "member_hash"))
            starts = chains.runs_of(columns)
            facts = np.empty((len(us), 3), np.int64)
            for lo, hi in zip(starts, np.append(starts[1:], len(us)), strict=True):
                if lo or chains.key_at(columns, 0) != now:
                    open_burst = chains.Bursts(seconds * SECOND)
                own = lo + (of := open_burst.kept_of(us[lo:hi]))
                facts[lo:hi] = np.stack([line[own], us[own], text[own]], 1)
                if (before := of < 0).any():
                    facts[lo:hi][before] = kept
                kept = facts[hi - 1].copy()
            now = chains.key_at(columns, len(us) - 1)
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(facts[:, i].copy()) for i in range(3)), *(batch.column(c) for c in ("member_line", "member_us", "member_hash"))], [*keys, "line_number", "us", "kept_hash", "member_line", "member_us", "member_hash"])

    timed = rows.where("member_us is not null").repartition(*keys).sortWithinPartitions(*keys, "member_us", "member_line").mapInArrow(scan, schema)
    alone = rows.where("member_us is null").select(*keys, F.col("member_line").alias("line_number"), F.col("member_us").alias("us"), F.col("member_hash").alias("kept_hash"), "member_line", "member_us", "member_hash")
    return timed.unionByName(alone.withColumn("us", F.lit(None).cast("long")))


def deduplicate(found: DataFrame, seconds: int = 60) -> DataFrame:
    """Bursts as one finding: source_file, rule_id, source, line_number and us of the kept, n_findings in the burst, n_merged, the number of distinct other lines in it, and merged, the numbers of the first MEMBERS of those. A finding without a time always stays."""
    keys = ["source_file", "rule_id", "source", "line_number", "us"]
    rows = bursts(found, seconds)
    timed = rows.where("us is not null")
    each = timed.groupBy(*keys, "kept_hash", "member_hash").agg(F.min(F.struct("member_us", "member_line")).alias("first"), F.count("*").alias("n"))
    other = F.when(F.col("member_hash") != F.col("kept_hash"), F.col("first"))
    size = F.count("other")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("other").isNull(), "other"))
    ranked = each.withColumn("other", other).withColumn("place", place)
    first = F.array_sort(F.collect_list(F.when(F.col("other").isNotNull() & (F.col("place") <= MEMBERS), F.col("other"))))
    out = ranked.groupBy(*keys).agg(F.sum("n").alias("n_findings"), size.alias("n_merged"), F.transform(first, lambda x: x["member_line"]).alias("merged"))
    alone = rows.where("us is null").select(*keys, F.lit(1).cast("long").alias("n_findings"), F.lit(0).cast("long").alias("n_merged"), F.array().cast("array<long>").alias("merged"))
    return out.unionByName(alone)


def first_per_minute(found: DataFrame) -> DataFrame:
    """The first of findings with one rule, source, trigger line, severity and minute."""
    source = F.coalesce("source_ip", "hostname", F.lit("?"))
    w = Window.partitionBy("rule_id", source, "raw_line", "severity", F.floor(F.col("us") / (60 * SECOND))).orderBy("line_number")
    return found.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
