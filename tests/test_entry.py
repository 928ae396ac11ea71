"""Every registered query runs, and gives the rows of its SQL."""

import math
import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from emberlog import queries
from emberlog.plans import oracle

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{DIR}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else str(v) if hasattr(v, "isoformat") else v


def rows_of(rows, columns, order):
    at = [columns.index(c) for c in order]
    return sorted((tuple(plain(r[i]) for i in at) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, DIR)
    got = [tuple(r) for r in df.collect()]
    assert got
    if name in oracle.SQL:
        cur = duck.execute(oracle.SQL[name])
        columns = [c[0] for c in cur.description]
        order = sorted(columns)
        assert sorted(df.columns) == order
        assert rows_of(got, df.columns, order) == rows_of(cur.fetchall(), columns, order)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert os.path.exists(DIR)


@pytest.mark.parametrize("gone", [("emberlog/llm", "tests/llm"), ("emberlog/llm", "tests/llm", "corpus_pipeline.py")])
def test_without_the_subpackage(tmp_path, gone):
    """The rest imports and has all its queries in a copy without the training-data operators."""
    here = Path(__spark_entry__.__file__).parent
    for name in ("emberlog", "tests", "__spark_entry__.py", "corpus_pipeline.py"):
        if name not in gone and (here / name).exists():
            (shutil.copytree if (here / name).is_dir() else shutil.copy)(here / name, tmp_path / name)
    for name in gone:
        shutil.rmtree(tmp_path / name, ignore_errors=True)
    code = "import __spark_entry__ as e; from emberlog import queries; assert set(e.queries()) == set(queries.QUERIES), 1; assert set(e.oracle_sql()) <= set(e.queries()), 2"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
