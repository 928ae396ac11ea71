"""Tables that are kept up: retrieval index, case tables, files read before."""

import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from emberlog.operators import layers, report, retrieval, search
from emberlog.queries import found
from emberlog.sources import manifest

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def findings(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("findings"))
    found(spark, DIR).write.parquet(f"{path}/f")
    return spark.read.parquet(f"{path}/f")


def test_index_takes_only_what_is_new(spark, tmp_path, findings):
    path = str(tmp_path / "index")
    ids = findings.select("session_id", "rule_id", "raw_line").distinct().count()
    some = findings.where("line_number % 3 = 0")
    first = retrieval.refresh(some, path, 1)
    n = some.select("session_id", "rule_id", "raw_line").distinct().count()
    assert first.count() == n
    assert retrieval.refresh(some, path, 2).count() == 0
    assert retrieval.refresh(findings, path, 3).count() == ids - n
    assert retrieval.refresh(findings, path, 3).count() == ids - n  # the run again
    index = retrieval.open_index(spark, path)
    assert index.count() == ids == index.select("id").distinct().count()
    one = index.orderBy("id").first()
    best = retrieval.nearest(index, one["text"], 1, F.col("severity") == one["severity"]).first()
    assert best["id"] == one["id"] and best["score"] == 1.0


def files_of(root):
    return {str(p): (p.stat().st_mtime_ns, p.stat().st_size) for p in Path(root).rglob("part-*")}


def test_delete_session(spark, tmp_path, findings):
    root = str(tmp_path)
    search.save(findings, f"{root}/findings")
    sessions = sorted(r[0] for r in findings.select("session_id").distinct().collect())
    gone = sessions[1]
    for s in sessions:
        report.append(spark, "notes", [(s, "ann", f"note {s}", 1)] * 3, root)
        report.append(spark, "sessions", [(s, "a=b/c.log", "h", 1)], root)
    report.append(spark, "actions", findings.select("id", F.lit("open").alias("action"), F.lit("ann").alias("analyst"), F.lit(1).alias("created_us")), root)
    tables = ["notes", "sessions", "evidence", "attack_chains"]
    size = lambda: {t: report.read(spark, t, root).count() for t in tables} | {"actions": report.read(spark, "actions", root).count(), "findings": spark.read.parquet(f"{root}/findings").count()}
    before, files = size(), files_of(root)
    n = findings.where(F.col("session_id") == gone).count()
    deleted = report.delete_session(spark, gone, root)
    after = size()
    assert {t: before[t] - after[t] for t in before} == {t: deleted.get(t, 0) for t in before}
    assert deleted["findings"] == deleted["actions"] == n and deleted["notes"] == 3 and deleted["sessions"] == 1
    now = files_of(root)
    others = {p: v for p, v in files.items() if f"session_id={gone}" not in p and "/actions/" not in p}
    assert all(now.get(p) == v for p, v in others.items())
    assert report.read(spark, "actions", root).join(spark.read.parquet(f"{root}/findings"), "id", "left_anti").count() == 0
    assert report.delete_session(spark, "nobody", root)["findings"] == 0


def test_layers_of_chains(spark):
    kinds = "source_ip string, hostname string, category string, rule_id string, mitre_ids array<string>, risk_score double, severity string"
    f = spark.createDataFrame([("1.1.1.1", None, "web_attack", "W1", ["T1", "T2", "T3", "T4", "T5"], 5.0, "LOW"), (None, "h", "recon", "R1", None, None, "odd"), ("", None, None, None, [], 9.0, "CRITICAL")], kinds)
    chains = spark.createDataFrame([("1.1.1.1", ["a", "b", "c"], ["R1", "R2"], ["T9"], 8.0), ("2.2.2.2", ["a"], [], ["T9"], 7.0), ("3.3.3.3", [], ["R1"], [], 1.0)], "source string, categories array<string>, rules array<string>, techniques array<string>, max_risk_score double")
    nodes, edges, about = layers.layered_graph(f, chains)
    got = {(r["source"], r["target"], r["relation"]): r["weight_norm"] for r in edges.collect()}
    # a, b and c are nodes of no finding: their edges would dangle
    assert {k for k in got if k[2].startswith("chain")} == {("rule:R2", "tech:T9", "chain_technique")}
    names = {r["node"] for r in nodes.collect()}
    assert {"src:h", "src:unknown-source", "cat:uncategorized", "rule:rule", "tech:T4", "src:2.2.2.2"} <= names and "tech:T5" not in names and "src:3.3.3.3" not in names
    row = about.first()
    assert row["edges_raw"] - row["edges_kept"] == row["edges_dropped"] > 0 and row["reduced"] and row["chain_count"] == 3
    few = layers.layered_graph(f, chains, 4, 2)
    kept = {r["node"] for r in few[0].collect()}
    assert len(kept) == 4 and few[1].count() <= 2 and all({r["source"], r["target"]} <= kept for r in few[1].collect())
    assert few[2].first()["nodes_dropped"] == row["nodes_raw"] - 4


def test_numbered_lines_of_files_in_blocks(spark, tmp_path):
    (tmp_path / "a.log").write_text("".join(f"line {i} {'x' * (i % 50)}\n" for i in range(1, 3001)))
    (tmp_path / "b.log").write_text("one\n\nthree\r\n")
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        got = manifest.numbered_lines(spark, str(tmp_path))
        rows = got.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    a = {r["line_number"]: r["raw_line"] for r in rows if r["source_file"].endswith("a.log")}
    assert len(a) == 3000 and all(a[i].startswith(f"line {i} ") for i in a)
    assert sorted((r["line_number"], r["raw_line"]) for r in rows if r["source_file"].endswith("b.log")) == [(1, "one"), (2, ""), (3, "three")]


def test_files_that_changed_are_refused(spark, tmp_path):
    names = ["grown", "same", "cut", "other_head", "other_last", "gone", "empty"]
    for n in names:
        (tmp_path / n).write_text("" if n == "empty" else "".join(f"{n} {i}\n" for i in range(150)))
        os.utime(tmp_path / n, (1_700_000_000, 1_700_000_000))
    old = spark.createDataFrame(manifest.taken(spark, str(tmp_path)).collect(), manifest.SCHEMA)
    (tmp_path / "grown").open("a").write("more 1\nmore 2\n")
    (tmp_path / "cut").write_text("cut 0\n")
    (tmp_path / "other_head").write_text("X" + (tmp_path / "other_head").read_text() + "tail\n")
    (tmp_path / "other_last").write_text((tmp_path / "other_last").read_text().replace("other_last 149", "other_last 14X") + "tail\n")
    (tmp_path / "gone").unlink()
    (tmp_path / "fresh").write_text("f1\nf2\n")
    (tmp_path / "empty").write_text("now\n")
    decided = manifest.decisions(spark, str(tmp_path), old)
    got = {Path(r["source_file"]).name: r["decision"] for r in decided.collect()}
    assert got == {"grown": "appended", "same": "unchanged", "cut": "truncated", "other_head": "replaced", "other_last": "replaced", "gone": "missing", "fresh": "new", "empty": "new"}  # Spark lists no empty files
    lines = sorted((r["line_number"], r["raw_line"]) for r in manifest.new_lines(spark, decided).collect())
    assert lines == sorted([(151, "more 1"), (152, "more 2"), (1, "f1"), (2, "f2"), (1, "now")])
