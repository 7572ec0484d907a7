"""Every registered query of the tree operators against its SQL, and the driver's contract."""

import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__ as entry
from arborspark.plans.oracle import oracle_sql
from arborspark.plans.queries import queries
from compare import canonical, duck

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, sf_dir, name):
    got = queries()[name](spark, sf_dir).toPandas()
    if name not in oracle_sql():
        assert len(got)
        return
    want = duck(sf_dir).execute(oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


def test_entry(spark, sf_dir):
    assert entry.entry(spark).columns == ["host", "n_files", "n_lines", "n_chars", "n_tokens"]


def test_the_rest_works_without_the_llm_folders(tmp_path):
    shutil.copytree(REPO, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", ".pytest_cache"))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 50 and not any(x.startswith('op') or x == 'pipeline' for x in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", check=True)
