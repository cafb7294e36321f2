"""The driver's entry with and without the corpus operators."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
ASK = "import __spark_entry__ as e; print(*sorted(e.queries())); print(*sorted(e.oracle_sql()))"


def _asked(folder):
    run = subprocess.run([sys.executable, "-c", ASK], cwd=folder, env=os.environ | {"PYTHONPATH": str(folder)}, capture_output=True, text=True, timeout=120)
    if run.returncode:
        raise RuntimeError(run.stderr)
    return [set(line.split()) for line in run.stdout.splitlines()]


@pytest.fixture
def copy(tmp_path):
    """The library and its entry, without the corpus operators."""
    shutil.copytree(f"{ROOT}/helixframe", tmp_path / "helixframe", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    return tmp_path


def test_without_the_folder(copy):
    names, sql = _asked(copy)
    assert "feature_breadth" in names and sql <= names and not any(n.startswith("op") and n[2].isdigit() for n in names)


def test_with_an_empty_folder_left(copy):
    own = _asked(copy)
    (copy / "helixframe/llm/__pycache__").mkdir(parents=True)
    assert _asked(copy) == own


def test_failures_inside_the_operators_show(copy):
    (copy / "helixframe/llm").mkdir()
    (copy / "helixframe/llm/__init__.py").touch()
    (copy / "helixframe/llm/queries.py").write_text("import no_such_module_at_all")
    with pytest.raises(RuntimeError, match="no_such_module_at_all"):
        _asked(copy)
