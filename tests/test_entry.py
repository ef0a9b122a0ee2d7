"""The entry module with and without the language-model part of the library."""

import shutil
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parent.parent
CODE = "import __spark_entry__ as e, bench; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(len(q), sum(n.startswith('op') for n in q), 'pipeline' in q)"


def run(folder):
    done = subprocess.run([sys.executable, "-c", CODE], cwd=folder, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    return done.stdout.split()[-3:]


def test_queries_without_the_optional_part(tmp_path):
    kept = shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", ".*cache")
    shutil.copytree(REPO, tmp_path / "repo", ignore=kept)
    n, ops, pipeline = run(tmp_path / "repo")
    assert int(n) > 50 and (ops, pipeline) == ("0", "False")
    (tmp_path / "repo/tidemill/llm").mkdir()
    (tmp_path / "repo/tidemill/llm/__init__.py").write_text("")
    assert subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path / "repo", capture_output=True, timeout=120).returncode != 0
