"""The entry points, also without the subpackage of the training-data operators."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("elsewhere", [False, True])
@pytest.mark.parametrize("gone", [["laborlens/llm", "tests/llm"], ["laborlens/llm", "tests/llm", "corpus_pipeline.py"], ["corpus_pipeline.py"]])
def test_queries_can_be_listed_without(gone, elsewhere, tmp_path):
    """elsewhere: PYTHONPATH names this checkout, which still has all files."""
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", *(g.rsplit("/", 1)[-1] for g in gone)))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and len(q) > 100 and set(e.oracle_sql()) <= set(q); import pkgutil, laborlens; [__import__(m.name) for m in pkgutil.walk_packages(laborlens.__path__, 'laborlens.')]"
    path = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | ({"PYTHONPATH": str(ROOT)} if elsewhere else {})
    subprocess.run([sys.executable, "-c", code], cwd=copy, env=path, check=True, timeout=120)
