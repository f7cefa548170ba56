"""The entry point without the training-data operators, and without what they need."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def names(folder: str, before: str = "") -> set[str]:
    code = f"{before}\nimport __spark_entry__ as e\nprint(*e.queries())\nassert set(e.oracle_sql()) <= set(e.queries())"
    out = subprocess.run([sys.executable, "-W", "ignore", "-c", code], cwd=folder, capture_output=True, text=True, check=True, env=os.environ | {"PYTHONPATH": folder})
    return set(out.stdout.split())


def test_queries_without_the_folders(tmp_path):
    here = tmp_path / "repo"
    shutil.copytree(os.path.join(ROOT, "tidemark"), here / "tidemark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), here)
    found = names(str(here))
    assert "trending_tickers" in found and not any(n.startswith("op") and n[2].isdigit() or n == "pipeline" for n in found)


def test_a_query_runs_without_the_folders(tmp_path):
    """And so does the suite's collection: nothing outside tests/llm needs the operators."""
    here = tmp_path / "repo"
    shutil.copytree(os.path.join(ROOT, "tidemark"), here / "tidemark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copytree(os.path.join(ROOT, "tests"), here / "tests", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), here)
    env = os.environ | {"PYTHONPATH": str(here)}
    code = "from tidemark.session import build\nimport __spark_entry__ as e\ns = build('x', 'local[2]', **{'spark.ui.enabled': 'false', 'spark.sql.shuffle.partitions': '2'})\nprint('ROWS', e.queries()['knn_top10'](s, '/root/testdata/sf0.001').count(), e.entry(s).count())"
    out = subprocess.run([sys.executable, "-W", "ignore", "-c", code], cwd=here, capture_output=True, text=True, check=True, env=env)
    assert all(int(n) > 0 for n in out.stdout.partition("ROWS ")[2].split())
    collected = subprocess.run([sys.executable, "-m", "pytest", "tests", "--collect-only", "-q", "-p", "no:cacheprovider"], cwd=here, capture_output=True, text=True, check=True, env=env)
    assert "test_query[trending_tickers]" in collected.stdout


def test_queries_without_a_library():
    found = names(ROOT, "import sys\nsys.modules['xxhash'] = None")
    assert "trending_tickers" in found and "op3_simhash" not in found
