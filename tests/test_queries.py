"""Every registered query with SQL gives what DuckDB gives on the same tables."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys

import pytest

from strata.plans import registry

#: Computed here: with several conftest files the name does not tell which one is meant.
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
TABLES = ("lineitem", "part", "orders")


@pytest.fixture(scope="module")
def duck(sf_dir):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(frame):
    frame = frame[sorted(frame.columns)]
    for c in frame:
        if frame[c].dtype.kind == "f":
            frame[c] = frame[c].round(9) + 0.0
    return sorted(map(str, frame.astype(object).where(frame.notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query(spark, sf_dir, duck, name):
    assert _plain(registry.QUERIES[name](spark, sf_dir).toPandas()) == _plain(duck.execute(registry.ORACLE_SQL[name]).df())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_without_the_corpus_folders(tmp_path):
    """The rest stands alone: with both folders gone, whether the pipeline's file is there or not."""
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", ".pytest_cache"))
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q); print(len(q), 'pipeline' in q)"
    for gone in (None, "corpus_pipeline.py"):
        if gone and (copy / gone).exists():
            os.remove(copy / gone)
        said = subprocess.run([sys.executable, "-B", "-c", code], cwd=copy, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, capture_output=True, text=True, check=True)
        assert said.stdout.split() == [str(len(registry.QUERIES)), "False"]
