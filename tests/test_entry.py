"""The driver contract, with and without the optional subpackage."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_entry_and_keys(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["category", "findings"]


def test_without_the_optional_parts(tmp_path):
    shutil.copytree(ROOT / "gleanery", tmp_path / "gleanery", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    run = "import __spark_entry__ as e; q = e.queries(); assert 'findings_per_category' in q and not [n for n in q if n.startswith('op1_')]"
    env = {**os.environ, "PYTHONPATH": str(tmp_path)}
    subprocess.run([sys.executable, "-c", run], cwd=tmp_path, env=env, check=True)


def test_nothing_else_imports_the_optional_part():
    for path in (ROOT / "gleanery").rglob("*.py"):
        if "llm" not in path.parts:
            assert "llm" not in path.read_text(encoding="utf-8"), path
