"""The library without its optional text operators, and without what only they need."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
ASK = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(q.startswith('op') or q == 'pipeline' for q in e.queries()))"


def answer(folder, *first):
    path = os.pathsep.join([*map(str, first), str(folder)])
    run = subprocess.run([sys.executable, "-c", ASK], cwd=folder, env=os.environ | {"PYTHONPATH": path}, capture_output=True, text=True, timeout=120)
    assert run.returncode == 0, run.stderr
    return run.stdout.split()


def test_without_text_operators(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    n, n_sql, any_text = answer(copy)
    assert int(n) > 80 and int(n_sql) > 70 and any_text == "False"


def test_with_the_pipeline_left_behind(tmp_path):
    """Only the subpackage is gone: the pipeline's file is left out too."""
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__"))
    (copy / "corpus_pipeline.py").write_text("from gaugeline.llm import quality\n")
    assert answer(copy)[2] == "False"


def test_without_a_package_of_the_text_operators(tmp_path):
    (tmp_path / "zstandard.py").write_text("raise ModuleNotFoundError('zstandard')\n")
    n, _, any_text = answer(ROOT, tmp_path)
    assert int(n) > 80 and any_text == "False"
