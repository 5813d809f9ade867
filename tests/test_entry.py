"""The entry module with and without the training-data folders."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SHOW = "import __spark_entry__ as e; print(' '.join(sorted(e.queries())), '|', ' '.join(sorted(e.oracle_sql())))"


@pytest.mark.parametrize("gone", [("textloom/llm", "tests/llm", "corpus_pipeline.py"), ("textloom/llm", "tests/llm"), ("corpus_pipeline.py",)])
def test_core_queries_stand_alone(tmp_path, gone):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    for name in gone:
        path = copy / name
        shutil.rmtree(path, ignore_errors=True) if path.is_dir() else path.unlink(missing_ok=True)
    out = subprocess.run([sys.executable, "-c", SHOW], cwd=copy, capture_output=True, text=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert out.returncode == 0, out.stderr
    names, sql = (set(x.split()) for x in out.stdout.split("|"))
    assert {"style_profile", "post_scores", "approval_gate"} <= names and sql <= names
    assert "pipeline" not in names
    assert ("op4_exact_dedup" in names) == (gone == ("corpus_pipeline.py",) and (copy / "textloom/llm").exists())
