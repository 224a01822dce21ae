"""The library without the operators for training data: nothing outside them needs them."""

import shutil
import subprocess
import sys

from tests.conftest import ROOT

CHECK = """
import __spark_entry__ as entry
from strata.catalog import QUERIES, SQL
assert set(entry.queries()) == set(QUERIES) and set(entry.oracle_sql()) == set(SQL) and len(QUERIES) > 100
import strata.store, strata.streaming.feed, strata.sources.wire, strata.sources.log
"""


def test_without_llm(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    assert not list(copy.rglob("llm"))
    done = subprocess.run([sys.executable, "-c", CHECK], cwd=copy, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
