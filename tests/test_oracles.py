"""Every registered query with SQL, against DuckDB."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import oracle
import pytest

import standex.plans.domain_queries
import standex.plans.io_queries
import standex.plans.job_queries
import standex.plans.search_queries
import standex.plans.stream_queries  # noqa: F401
from standex.plans.registry import ORACLES, QUERIES

ROOT = Path(__file__).resolve().parent.parent


@pytest.fixture(scope="module")
def con(small):
    return oracle.connect(small)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_duckdb(spark, small, con, name):
    assert oracle.rows_of(QUERIES[name](spark, small)) == oracle.rows_in(con, ORACLES[name])


def test_entry_module_without_the_optional_parts(small, tmp_path):
    """In a copy without the training-text folders, everything else still imports and runs."""
    for name in ("standex", "jobs", "__spark_entry__.py", "corpus_pipeline.py"):
        at = ROOT / name
        if at.exists():
            copy = shutil.copytree if at.is_dir() else shutil.copy
            copy(at, tmp_path / name)
    shutil.rmtree(tmp_path / "standex" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); assert 'pipeline' not in q and 'recommend' in q; print(len(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=120, check=False)
    assert done.returncode == 0, done.stderr
    assert int(done.stdout) == len(QUERIES)


def test_entry_module(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(QUERIES) <= set(entry.queries())
