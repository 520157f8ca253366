from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="no test data")
def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["l_returnflag", "n", "l_quantity_sum", "l_extendedprice_mean"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_the_rest_stands_without_the_corpus_operators(tmp_path):
    shutil.copytree(ROOT / "millrace", tmp_path / "millrace", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 250 and set(q) == set(e.oracle_sql()) and 'pipeline' not in q"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PYTHONPATH": "", "PATH": "/usr/bin:/bin"})
    users = [p for p in (ROOT / "millrace").rglob("*.py") if "llm" not in p.parts and "millrace.llm" in p.read_text()]
    assert not users
