"""The driver's contract, with and without the optional subpackage."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def names(root):
    code = "import __spark_entry__ as e; print(*sorted(e.queries()), '|', *sorted(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=root, env={**os.environ, "PYTHONPATH": root}, capture_output=True, text=True, check=True).stdout
    left, right = out.split("|")
    return set(left.split()), set(right.split())


def test_imports_without_a_session_and_without_the_subpackage(tmp_path):
    queries, oracles = names(ROOT)
    assert oracles <= queries and "chunk_stats" in queries
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__"))
    left, _ = names(str(tmp_path / "r"))
    assert left == {q for q in queries if not q.startswith("op") and q != "pipeline"}


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
