"""The contract's three functions; the training-data operators can be taken away."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__

ROOT = Path(__spark_entry__.__file__).parent


def test_entry(spark):
    assert __spark_entry__.entry(spark).collect()[0]["n"] == 1500


def test_sql_belongs_to_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_nothing_else_imports_the_optional_part():
    for p in (ROOT / "weirflow").rglob("*.py"):
        if "llm" not in p.parts:
            assert "weirflow.llm" not in p.read_text(), p


def test_works_without_the_optional_part(tmp_path):
    for p in ("__spark_entry__.py", "weirflow"):
        subprocess.run(["cp", "-r", str(ROOT / p), str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "weirflow/llm")], check=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'npj' in q and 'pipeline' not in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, check=True)
