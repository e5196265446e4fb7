"""The driver contract, with and without the training-data operators."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _names(folder):
    code = "import json, __spark_entry__ as e; print(json.dumps([sorted(e.queries()), sorted(e.oracle_sql())]))"
    return subprocess.run([sys.executable, "-c", code], cwd=folder, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": ""})


def test_entry_without_training_data_operators(tmp_path):
    shutil.copytree(os.path.join(ROOT, "burnledger"), tmp_path / "burnledger", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    alone = _names(tmp_path)
    assert alone.returncode == 0, alone.stderr
    assert "op9_jaccard" not in alone.stdout and "pipeline" not in alone.stdout and "shared_usage" in alone.stdout
    # The pipeline's module may outlive the package that it uses.
    open(tmp_path / "corpus_pipeline.py", "w").write("from burnledger.llm import common\n")
    again = _names(tmp_path)
    assert again.returncode == 0 and again.stdout == alone.stdout
