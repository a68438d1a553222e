"""The driver contract, with and without the optional folders."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry

ROOT = Path(entry.__file__).parent


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 60


def test_entry_runs(spark):
    if not Path("/root/testdata/sf0.001").exists():
        pytest.skip("no test tables here")
    assert entry.entry(spark).count() == 100


def test_works_without_the_optional_folders(tmp_path):
    shutil.copytree(ROOT / "clausemill", tmp_path / "clausemill", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 60 and 'pipeline' not in q and not any(k.startswith('op') for k in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin"}, check=True)


def test_a_missing_library_costs_the_optional_queries_alone(tmp_path):
    """Where the subpackage is there but cannot be imported, the rest still works."""
    shutil.copytree(ROOT / "clausemill", tmp_path / "clausemill", ignore=shutil.ignore_patterns("__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    shutil.copy(ROOT / "corpus_pipeline.py", tmp_path) if (ROOT / "corpus_pipeline.py").exists() else None
    code = "import sys; sys.modules['xxhash'] = sys.modules['public_tokenizers'] = None; import __spark_entry__ as e; q = e.queries(); assert len(q) > 60 and 'pipeline' not in q and not any(k.startswith('op') for k in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-W", "ignore", "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin"}, check=True)
