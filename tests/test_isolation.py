"""The library without its corpus part."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parent.parent


def test_entry_without_corpus_operators(tmp_path):
    skip = shutil.ignore_patterns(".git", "__pycache__", "llm", ".pytest_cache")
    for gone in (("corpus_pipeline.py",), ()):  # the pipeline module may stay behind
        copy = tmp_path / f"repo{len(gone)}"
        shutil.copytree(REPO, copy, ignore=skip)
        for name in gone:
            (copy / name).unlink(missing_ok=True)
        code = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and len(q) > 100 and set(e.oracle_sql()) <= set(q)"
        subprocess.run([sys.executable, "-c", code], cwd=copy, env=os.environ | {"PYTHONPATH": str(copy)}, check=True, timeout=120)
