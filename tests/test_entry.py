"""The library and its entry point stand without the package llm."""

import os
import shutil
import subprocess
import sys

import pytest

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("pipeline", [True, False])
def test_the_rest_works_without_llm(tmp_path, pipeline):
    left_out = shutil.ignore_patterns("llm", ".git", "__pycache__", ".pytest_cache", *([] if pipeline else ["corpus_pipeline.py"]))
    shutil.copytree(REPO, tmp_path / "repo", ignore=left_out)
    code = "import __spark_entry__ as e; names = set(e.queries()); assert names == set(e.oracle_sql()) and 'pipeline' not in names, names"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", env=env, check=True, timeout=120)
    listed = subprocess.run([sys.executable, "-m", "pytest", "tests", "--collect-only", "-q"], cwd=tmp_path / "repo", env=env, capture_output=True, text=True, timeout=120)
    assert listed.returncode == 0, listed.stdout[-2000:]
