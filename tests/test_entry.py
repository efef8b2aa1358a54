"""The driver's contract, and the library standing without its optional subpackage."""

import os
import shutil
import subprocess
import sys

import pytest

from tests.conftest import ROOT

WITHOUT = """
import sys
sys.path.insert(0, sys.argv[1])
import __spark_entry__ as e
from wattline.plans.catalog import QUERIES
assert set(e.queries()) == set(QUERIES), set(e.queries()) ^ set(QUERIES)
assert set(e.oracle_sql()) <= set(QUERIES) and e.entry
"""


@pytest.mark.parametrize("pipeline", [False, True])
def test_stands_without_the_optional_subpackage(tmp_path, pipeline):
    """Copies without wattline/llm, with and without corpus_pipeline.py, and with a left-over __pycache__."""
    skip = shutil.ignore_patterns(".git", "llm", "__pycache__", *([] if pipeline else ["corpus_pipeline.py"]))
    copy = shutil.copytree(ROOT, tmp_path / "copy", ignore=skip)
    if pipeline:
        os.makedirs(copy / "wattline" / "llm" / "__pycache__")
    done = subprocess.run([sys.executable, "-c", WITHOUT, str(copy)], cwd=tmp_path, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr


def test_queries_have_unique_sources():
    import __spark_entry__ as e

    names = e.queries()
    assert set(e.oracle_sql()) <= set(names)
    assert e.FLAGSHIP in names
