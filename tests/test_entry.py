"""The driver's contract, with and without the corpus operators."""

from __future__ import annotations

import re
import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(entry.__file__).resolve().parent


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["qid", "rank", "label", "score", "stage", "match_level"]
    assert df.count() > 0


def test_sql_names_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_rest_works_without_corpus_operators(tmp_path):
    """The folders of the corpus operators may be deleted."""
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    shutil.copytree(ROOT / "termweave", tmp_path / "termweave", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    said = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and not any(n.startswith('op1') for n in q); assert 'ontology_cascade' in q; e.oracle_sql(); print('fine')"
    run = subprocess.run([sys.executable, "-B", "-c", said], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert run.stdout.strip() == "fine", run.stderr


def test_nothing_else_imports_corpus_operators():
    for p in (ROOT / "termweave").rglob("*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"^\s*(from|import)\b.*\bllm\b", p.read_text(), re.M), p
