"""The driver's contract, with and without the corpus subpackage."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).parent.parent


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["entity", "n", "form"] and df.count() > 0


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_without_the_corpus_subpackage(tmp_path):
    for p in ("__spark_entry__.py", "bracketry"):
        (shutil.copytree if (ROOT / p).is_dir() else shutil.copy)(ROOT / p, tmp_path / p)
    shutil.rmtree(tmp_path / "bracketry/llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q); print(len(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    assert int(done.stdout.split()[-1]) > 90


def test_nothing_else_imports_the_corpus_subpackage():
    for p in (ROOT / "bracketry").rglob("*.py"):
        if "llm" not in p.parts:
            assert "llm" not in p.read_text(), p
