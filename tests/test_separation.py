"""The library without its optional parts: a copy in which they were never there."""
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
CODE = """
import __spark_entry__ as e
q, o = e.queries(), e.oracle_sql()
assert len(q) > 200 and set(o) <= set(q)
assert not any(n.startswith("op") and n[2:3].isdigit() or n == "pipeline" for n in q), sorted(q)
print(len(q))
"""


@pytest.mark.parametrize("left_out", [("llm",), ("llm", "corpus_pipeline.py"), ("corpus_pipeline.py", "llm", "tests")])
def test_entry_works_without(tmp_path, left_out):
    shutil.copytree(ROOT, tmp_path / "copy", ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", *left_out))
    done = subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path / "copy", capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]


def test_nothing_else_imports_the_subpackage():
    for f in (ROOT / "votelens").rglob("*.py"):
        if "llm" not in f.relative_to(ROOT).parts:
            assert not [x for x in f.read_text().splitlines() if "import" in x and "llm" in x], f
