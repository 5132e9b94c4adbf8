"""The driver's entry points, also where the LLM subpackage is gone."""

import shutil
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).parent.parent
COUNT = "import __spark_entry__ as e; print(len(e.queries()), len([q for q in e.queries() if q.startswith('op') or q == 'pipeline']), len(e.oracle_sql()))"


def counted(folder):
    return [int(x) for x in subprocess.run([sys.executable, "-c", COUNT], cwd=folder, capture_output=True, text=True, check=True).stdout.split()]


def copied(to, *gone):
    shutil.copytree(REPO, to, ignore=shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse"))
    for name in gone:
        path = to / name
        shutil.rmtree(path) if path.is_dir() else path.unlink(missing_ok=True)
    return to


def test_queries_without_the_subpackage(tmp_path):
    from tideline.plans import queries as core

    kept = [len(core.QUERIES), 0, len(core.ORACLE)]
    assert counted(copied(tmp_path / "a", "tideline/llm", "tests/llm", "corpus_pipeline.py")) == kept
    assert counted(copied(tmp_path / "b", "tideline/llm", "tests/llm")) == kept


def test_every_sql_has_its_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert "entry" not in entry.queries()
