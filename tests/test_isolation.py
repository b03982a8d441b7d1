"""The library, its queries and its entry work where the corpus operators and the pipeline are gone."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("gone", [("tidelog/llm", "corpus_pipeline.py"), ("tidelog/llm",)])
def test_entry_without_corpus_operators(tmp_path, gone):
    for x in ("tidelog", "__spark_entry__.py", "corpus_pipeline.py"):
        source = os.path.join(ROOT, x)
        if os.path.isdir(source):
            shutil.copytree(source, tmp_path / x, ignore=shutil.ignore_patterns("__pycache__"))
        elif os.path.exists(source):
            shutil.copy(source, tmp_path / x)
    for x in gone:
        if os.path.isdir(tmp_path / x):
            shutil.rmtree(tmp_path / x)
        elif os.path.exists(tmp_path / x):
            os.remove(tmp_path / x)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 60 and set(e.oracle_sql()) <= set(q) and 'pipeline' not in q"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True)
