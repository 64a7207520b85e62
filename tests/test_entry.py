"""The entry module with and without the optional text operators."""

import json
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from spokeworks.plans import QUERIES

REPO = Path(__file__).resolve().parents[1]
LIST = "import __spark_entry__ as e, json; print(json.dumps([sorted(e.queries()), sorted(e.oracle_sql())]))"


@pytest.mark.parametrize("pipeline_stays", [True, False])
def test_entry_without_the_text_operators(tmp_path, pipeline_stays):
    shutil.copytree(REPO / "spokeworks", tmp_path / "spokeworks", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    if pipeline_stays and (REPO / "corpus_pipeline.py").exists():
        shutil.copy(REPO / "corpus_pipeline.py", tmp_path)
    told = subprocess.run([sys.executable, "-c", LIST], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert told.returncode == 0, told.stderr
    names, sql = json.loads(told.stdout)
    assert names == sql == sorted(QUERIES)
