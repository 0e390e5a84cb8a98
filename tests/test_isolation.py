"""The library without its optional subpackage."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_without_the_optional_folders(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", "llm"))
    code = "import __spark_entry__ as e; q = e.queries(); assert q and set(e.oracle_sql()) <= set(q) and not [n for n in q if n.startswith('op') or n == 'pipeline']; import prismfold.streaming.intake, prismfold.sources.ingest"
    for gone in ((), ("corpus_pipeline.py",)):
        for name in gone:
            os.remove(copy / name)
        subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, timeout=300, env={**os.environ, "PYTHONPATH": str(copy)})
