"""The pipeline's stages in line: against plain versions, on awkward tables, and on their own output."""

import re

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from emberlog.llm import decontaminate, jaccard_join, mixing, secrets_scan, toxicity  # noqa: E402
from emberlog.llm.common import written  # noqa: E402

SF = "/root/testdata/sf0.001"


def staged(spark, docs, sf_dir):
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, sf_dir), f"test-{name}")
        yield name, docs


def test_each_stage_against_a_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r["doc_id"]: r for r in docs.collect()}
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    names = []
    for name, out in staged(spark, docs, SF):
        now = {r["doc_id"]: r for r in out.collect()}
        assert out.count() == len(now) and set(now) <= set(before)
        if name == "toxicity":
            flags = {r["doc_id"]: r["tox_flag"] for r in toxicity.scored(docs, model).collect()}
            assert set(now) == {d for d in before if not flags[d]}
        elif name == "jaccard_join":
            sets = {d: frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else None for d, r in before.items() for w in [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or ""))]}
            comp = {d: d for d in sets}

            def top(d, comp=comp):
                while comp[d] != d:
                    d = comp[d]
                return d

            ids = sorted(sets)
            for i, a in enumerate(ids):
                for b in ids[i + 1 :]:
                    if sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                        x, y = sorted((top(a), top(b)))
                        comp[y] = x
            assert set(now) == {d for d in ids if top(d) == d}
        elif name == "decontamination":
            words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
            tests = [words(t) for t in items]

            def dirty(text):
                own = words(text)
                for item in tests:
                    if len(item) < 3:
                        if own == item and item:
                            return True
                        continue
                    if len(item) < 16:
                        if any(sum(a != b for a, b in zip(item, own[at:], strict=False)) <= len(item) // 8 for at in range(len(own) - len(item) + 1)):
                            return True
                        continue
                    run = [0.0] * (len(item) + 1)
                    for w in own:  # one row of diagonals
                        run = [0.0, *(max(0.0, run[q] + (1.0 if w == item[q] else -decontaminate.MISMATCH)) for q in range(len(item)))]
                        if max(run) >= decontaminate.LEAST:
                            return True
                return False

            assert set(now) == {d for d, r in before.items() if not dirty(r["text"])}
        elif name == "secrets":
            spans = {r["doc_id"]: r["secrets"] for r in secrets_scan.secret_spans(spark.createDataFrame(list(before.values()), out.schema)).collect()}
            for d, r in before.items():
                text, at, want = r["text"] or "", 0, ""
                for s in spans[d]:
                    if s["start"] >= at:
                        want += text[at : s["start"]] + "[SECRET]"
                    at = max(at, s["end"])
                assert (now[d]["text"] or "") == want + text[at:] and secrets_scan.base_spans(text).count("access") <= want.count("[SECRET]")
        else:
            taken = {r["doc_id"]: r["taken"] for r in mixing.mix(spark.createDataFrame(list(before.values()), "doc_id long, text string, lang string, source string, n_chars long")).collect()}
            size = {d: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for d, r in before.items()}
            assert {d: now[d]["mix_copies"] * size[d] for d in now} == {d: t for d, t in taken.items() if t}
        if name != "mixing":
            assert out.columns == docs.columns
        names.append(name)
        before = now
    assert names == ["toxicity", "jaccard_join", "decontamination", "secrets", "mixing"]


def test_run_is_the_stages_in_line(spark):
    *_, (_, last) = staged(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF)
    key = lambda df: sorted((r["doc_id"], r["text"] or "", r["mix_copies"]) for r in df.collect())
    assert key(corpus_pipeline.run(spark, SF)) == key(last)


def test_awkward_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, out in staged(spark, docs.limit(0), SF):
        assert out.count() == 0
    rows = [(None, None, None, None), (-1, "", "en", None), (-2, "a few words", None, "a"), (-2, "a few words", None, "a")]  # ids without labels
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "1 as again", "2 as mix_source", "3 as keep", "4 as mix_copies", "0.5D as tox_score")
    for name, out in staged(spark, odd, SF):
        assert set(out.columns) >= {"doc_id", "text", "lang", "source", "again"}, name
    assert out.where("doc_id = -2").count() == 1


def test_own_output_once_more(spark):
    mixed = mixing.mixed_documents(spark.read.parquet(f"{SF}/documents.parquet"))
    assert mixing.mixed_documents(mixed).columns == mixed.columns
    model = toxicity.train(mixed, spark.read.parquet(f"{SF}/labels.parquet"))
    once = toxicity.scored(mixed, model)
    assert toxicity.scored(once, model).columns == once.columns
    assert jaccard_join.one_of_each(mixed.selectExpr("*", "1 as again")).columns == [*mixed.columns, "again"]
