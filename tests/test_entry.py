"""The driver's entry points, with and without the training-data subpackage."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


def test_catalogue_names():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert "curation_score" in entry.queries()


@pytest.mark.parametrize("gone", [("llm", "corpus_pipeline.py"), ("llm",)])
def test_the_rest_stands_without_the_subpackage(tmp_path, gone):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", *gone))
    (copy / "trajecta/llm/__pycache__").mkdir(parents=True)
    data = "/root/testdata/sf0.001"
    run = f"from pyspark.sql import SparkSession as S; s = S.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate(); assert e.queries()['hash_split'](s, '{data}').count() and e.entry(s).count()" if os.path.isdir(data) else ""
    code = f"import __spark_entry__ as e; assert e.queries() and set(e.oracle_sql()) <= set(e.queries()) and not [n for n in e.queries() if n.startswith('op') or n == 'pipeline']; {run}"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=copy, env=env, capture_output=True, text=True, timeout=240)
    assert out.returncode == 0, out.stderr
    for path in copy.rglob("*.py"):
        if "test" not in path.parts and path.name not in ("__spark_entry__.py", "test_entry.py", "corpus_pipeline.py"):
            assert "trajecta.llm" not in path.read_text(), path
