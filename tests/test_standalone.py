"""The library without the text operators: what is left must import, and answer the same queries."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("also", [(), ("corpus_pipeline.py",)])
def test_without_the_subpackage(tmp_path, also):
    """The repository with exactly the two folders deleted, and with the pipeline's file gone as well."""
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", ".hypothesis"))
    for folder in ("dossier/llm", "tests/llm"):
        shutil.rmtree(tmp_path / "repo" / folder, ignore_errors=True)
    for name in also:
        (tmp_path / "repo" / name).unlink(missing_ok=True)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 70 and set(o) <= set(q) and not any(k.startswith('op') and k[2].isdigit() for k in q) and 'pipeline' not in q"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", env={**os.environ, "PYTHONPATH": str(tmp_path / "repo")}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr


def test_nothing_else_imports_the_subpackage():
    for folder, _, names in os.walk(os.path.join(ROOT, "dossier")):
        if os.sep + "llm" not in folder:
            for name in names:
                if name.endswith(".py"):
                    with open(os.path.join(folder, name)) as f:
                        assert "llm" not in f.read(), os.path.join(folder, name)
