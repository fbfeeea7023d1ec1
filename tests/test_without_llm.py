"""The library without its llm subpackage, as after the deletion of both folders and the pipeline."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("pipeline", [False, True])
def test_entry_without_llm(tmp_path, pipeline):
    """The other queries are listed whether or not ``corpus_pipeline.py`` still lies there."""
    copy = tmp_path / "repo"
    shutil.copytree(REPO, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", "*.parquet", *([] if pipeline else ["corpus_pipeline.py"])))
    (copy / "bazaarflow/llm/__pycache__").mkdir(parents=True)
    code = "import __spark_entry__ as e; q = e.queries(); print(sum(n.startswith('op') or n == 'pipeline' for n in q), len(q), set(e.oracle_sql()) <= set(q))"
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=copy, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    llm, every, known = done.stdout.split()
    assert llm == "0" and int(every) > 100 and known == "True"


def test_nothing_else_imports_llm():
    for f in [*(REPO / "bazaarflow").rglob("*.py"), *(REPO / "tests").glob("*.py")]:
        if "llm" not in f.relative_to(REPO).parts:
            assert not any(line.lstrip().startswith(("import ", "from ")) and ("llm" in line or "corpus_pipeline" in line) for line in f.read_text().splitlines()), f
