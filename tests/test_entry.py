"""The entry module works with and without the removable parts of the repository."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
NAMES = "import __spark_entry__ as e; print(*sorted(e.queries())); print(*sorted(e.oracle_sql()))"


def listed(folder, code=NAMES):
    """What a Python process of its own says, in which only this folder's modules are on the path."""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    return subprocess.run([sys.executable, "-B", "-c", code], cwd=folder, capture_output=True, text=True, env=env)


def copy(tmp_path):
    for p in ("evalloom", "__spark_entry__.py", "corpus_pipeline.py"):
        src = ROOT / p
        if src.is_dir():
            shutil.copytree(src, tmp_path / p, ignore=shutil.ignore_patterns("__pycache__"))
        elif src.exists():
            shutil.copy(src, tmp_path / p)
    return tmp_path


@pytest.mark.parametrize("gone", [("evalloom/llm",), ("evalloom/llm", "corpus_pipeline.py"), ("corpus_pipeline.py",)])
def test_other_queries_stay(tmp_path, gone):
    folder = copy(tmp_path)
    for p in gone:
        target = folder / p
        shutil.rmtree(target, ignore_errors=True) if target.is_dir() else target.unlink(missing_ok=True)
    out = listed(folder)
    assert out.returncode == 0, out.stderr
    names, sql = (line.split() for line in out.stdout.strip().split("\n"))
    assert "score_qa_f1" in names and "score_qa_f1" in sql and "pipeline" not in names
    if "evalloom/llm" in gone:
        assert not any(n.startswith("op") and n[2].isdigit() for n in names)


def test_other_import_errors_are_raised(tmp_path):
    folder = copy(tmp_path)
    (folder / "evalloom/llm").mkdir(exist_ok=True)
    (folder / "evalloom/llm/__init__.py").write_text("")
    (folder / "evalloom/llm/queries.py").write_text("import no_such_library\n")
    out = listed(folder)
    assert out.returncode and "no_such_library" in out.stderr
    (folder / "evalloom/llm/queries.py").write_text("from . import no_such_part\nfrom .no_such_module import x\n")
    out = listed(folder)
    assert out.returncode and "no_such" in out.stderr
