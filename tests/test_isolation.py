"""The library stands without the training-data subpackage and the pipeline."""

import os
import re
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
SKIPPED = shutil.ignore_patterns(".git", "llm", "__pycache__", ".pytest_cache", "spark-warehouse")
CODE = "import __spark_entry__ as e; q = e.queries(); print(len(q), any(n.startswith('op') and n[2].isdigit() or n == 'pipeline' for n in q)); e.oracle_sql()"


@pytest.mark.parametrize("pipeline", ["kept", "gone", "on the path"])
def test_imports_without_the_subpackage(tmp_path, pipeline):
    """The repository without both llm folders, with and without corpus_pipeline.py, here or elsewhere on the path."""
    here = tmp_path / "repo"
    shutil.copytree(ROOT, here, ignore=SKIPPED)
    path, one = str(here), here / "corpus_pipeline.py"
    if pipeline != "kept":
        one.unlink(missing_ok=True)
    if pipeline == "on the path" and (ROOT / one.name).exists():
        (tmp_path / "other").mkdir()
        shutil.copy(ROOT / one.name, tmp_path / "other")
        path += f"{os.pathsep}{tmp_path / 'other'}"
    out = subprocess.run([sys.executable, "-B", "-c", CODE], cwd=here, env=os.environ | {"PYTHONPATH": path}, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    assert int(out.stdout.split()[0]) > 100 and out.stdout.split()[1] == "False"


def test_nothing_else_imports_the_subpackage():
    for p in (ROOT / "loamstone").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT / "loamstone").parts:
            assert not re.search(r"loamstone\.llm|from \.llm|corpus_pipeline", p.read_text()), p
