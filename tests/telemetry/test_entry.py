"""The driver's three functions, also in a copy of the repository without the text operators."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[2]
SAY = "import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries(), set(e.oracle_sql()) <= set(e.queries()), callable(e.entry))"


@pytest.mark.parametrize("pipeline", [True, False])
def test_without_text_operators(tmp_path, pipeline):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", *([] if pipeline else ["corpus_pipeline.py"])))
    out = subprocess.run([sys.executable, "-B", "-c", SAY], cwd=copy, env=os.environ | {"PYTHONPATH": str(copy)}, capture_output=True, text=True, check=True)
    n, there, named, callable_ = out.stdout.split()
    assert int(n) > 50 and (there, named, callable_) == ("False", "True", "True")


def test_smoke(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
