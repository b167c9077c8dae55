"""The library does without the subpackage llm and the pipeline."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
DATA = Path("/root/testdata/sf0.001")


def test_entry_without_llm(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", "llm", "corpus_pipeline.py"))
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=copy, check=True)
    if DATA.is_dir():  # and a query runs
        session = "from pyspark.sql import SparkSession; s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate(); "
        run = f"import __spark_entry__ as e; {session}n = e.queries()['cls_preview'](s, {str(DATA)!r}).count(); assert n > 0; assert e.entry(s).count() > 0"
        subprocess.run([sys.executable, "-B", "-c", run], cwd=copy, check=True, env={**os.environ, "PYTHONPATH": str(copy)})


def test_nothing_else_imports_llm():
    for p in (ROOT / "resight").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert "llm" not in p.read_text(), p
