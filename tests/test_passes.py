"""Steps that several parts of a query read run once."""

import random
from collections import Counter

import pytest

from pyspark.sql import functions as F

from emberlog import queries
from emberlog.functions import core
from emberlog.operators import chains, correlate, ioc, search, shared, text
from emberlog.plans.adapter import events

DIR = "/root/testdata/sf0.001"


def test_derived_chains_reads_findings_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    kinds = "source_ip string, hostname string, category string, rule_id string, mitre_ids array<string>, risk_score double, us long, line_number long"
    rows = [(f"1.1.1.{i % 3}", None, ("recon", "impact")[i % 2], f"R{i % 4}", ["T1"], float(i), i, i) for i in range(60)]
    found = spark.createDataFrame(rows, kinds).repartition(2).mapInArrow(counted, kinds)
    got = correlate.derived_chains(found).collect()
    assert seen.value == len(rows)
    assert [(r["source"], r["finding_count"], r["max_risk_score"]) for r in got] == [("1.1.1.2", 20, 59.0), ("1.1.1.1", 20, 58.0), ("1.1.1.0", 20, 57.0)]


@pytest.mark.parametrize(("name", "table"), [("case_stats", "events.parquet"), ("ioc_feeds", "documents.parquet")])
def test_what_is_read_several_times_is_written_first(spark, name, table):
    assert not any(table in f for f in queries.QUERIES[name](spark, DIR).inputFiles())


@pytest.mark.parametrize("top", [1, 5, 12, 400])
def test_top_terms(spark, top):
    """Equal to counting all terms and pairs, with ties and with fewer words than are wanted."""
    r = random.Random(top)
    docs = [[r.choice("abcdefghijklmnop"[: 2 + i % 15]) * 2 for _ in range(r.randrange(12))] for i in range(80)]
    n = Counter(t for d in docs for t in d) + Counter(" ".join(p) for d in docs for p in zip(d, d[1:]))
    want = sorted(n.items(), key=lambda x: (-x[1], x[0]))[:top]
    got = text.top_terms(spark.createDataFrame([(d,) for d in docs], "t array<string>"), top)
    assert sorted((tuple(x) for x in got.collect()), key=lambda x: (-x[1], x[0])) == want


def test_tf_idf_shuffles_no_rare_pairs(spark):
    """A key that comes twice is one document, as all of its rows count together."""
    docs = spark.createDataFrame([(1, "red red blue"), (1, "red green"), (2, "blue blue"), (3, None)], "doc_id long, text string")
    got = {(r["doc_id"], r["term"]): r["weight"] for r in text.tf_idf(docs, top=2).collect()}
    assert set(got) == {(1, "red"), (1, "blue"), (2, "blue")}
    assert got[2, "blue"] == 1 and abs(got[1, "red"] ** 2 + got[1, "blue"] ** 2 - 1) < 1e-12


def _rows_by_task(df):
    return [n for n in df.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n]


def test_a_table_of_one_row_group_is_dealt(spark, tmp_path):
    """It reads as more partitions than there are cores, of which one holds all rows."""
    spark.range(20_000).selectExpr("id as event_id", "timestamp_micros(id) as ts", "id % 9 as user_id", "'view' as event_type", "1.0D as value", "concat('{k:', id % 50, '}') as props").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        table = spark.read.parquet(f"{tmp_path}/events.parquet")
        assert table.rdd.getNumPartitions() > 4 and _rows_by_task(table) == [20_000]
        assert max(_rows_by_task(shared.spread(table))) <= 5_100
        assert len(_rows_by_task(shared.spread(table, 1_000))) == 20
        assert max(_rows_by_task(events(spark, str(tmp_path)))) <= 5_100
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_corpus_tests_read_findings_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    kinds = "test string, rule_id string"
    found = spark.createDataFrame([("a", f"R{i % 3}") for i in range(30)], kinds).mapInArrow(counted, kinds)
    tests = spark.createDataFrame([("a", "R1", "expected"), ("a", "R9", "expected"), ("a", "R2", "forbidden")], "test string, rule_id string, kind string")
    got = search.corpus_tests(found, tests, spark.createDataFrame([("a", 30)], "test string, least long")).collect()
    assert seen.value == 30
    assert [tuple(r) for r in got] == [("a", 30, "R9", "R2", False)]


@pytest.mark.parametrize("name", ["report_top", "case_numbers"])
def test_findings_that_are_read_twice_are_written_first(spark, name):
    assert not any("events.parquet" in f for f in queries.QUERIES[name](spark, DIR).inputFiles())


def _chain(rule, us, mask, values=(), cuts=()):
    """Fires of one rule over one key's events, taken in pieces."""
    flags = len(rule.steps) or 1
    plan = chains.Plan(rule, [(0, (1 << flags) - 1, 0 if values else None)])
    state, out = plan.start(len(values)), []
    for lo, hi in zip([0, *cuts], [*cuts, len(us)]):
        fires, state = plan.run(chains.Events.of(us[lo:hi], range(lo, hi), mask[lo:hi], [v[lo:hi] for v in values]), state)
        out += fires
    return out


def test_a_sequence_that_is_never_completed_is_not_tried_at_each_reset(monkeypatch):
    tries, met = [], chains.Steps._met
    monkeypatch.setattr(chains.Steps, "_met", lambda *a: tries.append(1) or met(*a))
    rule = queries._rule(type="sequence", key="username", seconds=10, steps=({"match_field": "a", "value": "1"}, {"match_field": "a", "value": "2"}))
    assert not _chain(rule, [i * 20_000_000 for i in range(2000)], [1 + i % 2 for i in range(2000)])
    assert len(tries) <= 2


def test_sparse_events_are_not_gone_through_for_distinct_values(monkeypatch):
    rows, needs = [], chains._distinct_needs
    monkeypatch.setattr(chains, "_distinct_needs", lambda r, *a: rows.append(len(r)) or needs(r, *a))
    rule = queries._rule(type="threshold", key="username", count=3, seconds=10, distinct="dest_port")
    us = [i * 20_000_000 for i in range(2000)] + [40_000_000_000 + i for i in range(4)]
    fires = _chain(rule, us, [1] * len(us), [[str(i % 3) for i in range(len(us))]])
    assert [f[0] for f in fires] == [2002] and sum(rows) <= 4


@pytest.mark.parametrize("seed", range(20))
def test_chains_equal_a_walk(seed):
    """Sequences and distinct thresholds against a walk event by event, in one piece and in several."""
    r = random.Random(seed)
    n, width = 120, r.choice([5, 20, 60])
    us = sorted(r.randrange(1500) * 1_000_000 for _ in range(n))
    mask, value = [r.randrange(4) for _ in range(n)], [r.choice("abcd") for _ in range(n)]
    cuts = sorted(r.sample(range(1, n), 3))
    least = r.choice([1, 2])
    sequence = queries._rule(type="sequence", key="username", seconds=width, steps=({"match_field": "a", "value": "1", "min_count": least}, {"match_field": "a", "value": "2"}))
    want, anchor, step, met = [], None, 0, 0
    for i in range(n):
        if anchor is None or us[i] - anchor > width * 1_000_000:
            anchor, step, met = us[i], 0, 0
        if mask[i] >> step & 1:
            met += 1
            if met == (least, 1)[step]:
                step, met = step + 1, 0
        if step == 2:
            want.append(i)
            anchor, step, met = us[i], 0, 0
    distinct = queries._rule(type="threshold", key="username", count=3, seconds=width, distinct="dest_port")
    also, since = [], 0
    for i in range(n):
        seen = {value[j] for j in range(since, i + 1) if mask[j] & 1 and us[i] - us[j] <= width * 1_000_000}
        if mask[i] & 1 and len(seen) >= 3:
            also.append(i)
            since = i + 1
    for at in ((), cuts):
        assert [f[0] for f in _chain(sequence, us, mask, (), at)] == want
        assert [f[0] for f in _chain(distinct, us, [m & 1 for m in mask], [value], at)] == also


def test_indicators_are_looked_for_once(spark):
    """object_relations reads them three times."""
    plan = queries.QUERIES["object_relations"](spark, DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan


def test_an_address_is_read_once_for_all_networks(spark):
    rows = spark.createDataFrame([("10.1.2.3", True), ("172.31.255.255", True), ("172.32.0.0", False), ("8.8.8.8", False), ("192.168.1", False), (None, False)], "ip string, want boolean")
    got = rows.select("want", core.in_networks("ip", core.PRIVATE).alias("got"))
    assert got.where("want <> got or got is null").isEmpty()
    assert rows.select(core.in_networks("ip", core.PRIVATE).alias("x"))._jdf.queryExecution().analyzed().toString().lower().count("rlike") == 1


def test_hints_lose_no_indicator(spark, monkeypatch):
    r = random.Random(5)
    pieces = ["a" * 32, "AB" * 20, "0f" * 32, "c:\\x\\y.exe", "/etc/passwd", "/tmp/a/b", "/home", "a.b@c.de", "8.8.4.4", "1.2.3", "Evil.Example.COM", "x.ru", "plain", "=", ";", "\n", "."]
    texts = [("".join(r.choice(pieces) + r.choice(["", " ", " ", ":"]) for _ in range(r.randrange(9))),) for _ in range(400)] + [(None,)]
    rows = spark.createDataFrame(texts, "text string").withColumn("n", F.monotonically_increasing_id())
    found = lambda: sorted(tuple(x) for x in ioc.extract(rows, "text", F.lit(1.0), "n").collect())
    got = found()
    monkeypatch.setattr(ioc, "HINTS", [("", tuple(range(len(ioc.KINDS))))])
    assert got == found()
    assert {x[0] for x in got} == {k for k, _, _ in ioc.KINDS}
