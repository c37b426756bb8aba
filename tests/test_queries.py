"""Every registered core query against its SQL on the smallest tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

from sargam.plans import queries as core


def plain(value):
    if value is None or value is pd.NA or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, float):
        return int(value) if value == int(value) else round(value, 6)
    if hasattr(value, "item"):
        return plain(value.item())
    return value if isinstance(value, (int, str, bool)) else str(value)


def canonical(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(str([plain(v) for v in r]) for r in frame.astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def duck(root):
    connection = duckdb.connect()
    for file in os.listdir(root):
        connection.sql(f"create view {file.split('.')[0]} as select * from '{root}/{file}'")
    return connection


@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_query(spark, duck, root, name):
    got = core.QUERIES[name](spark, root).toPandas()
    if name not in core.ORACLES:
        assert len(got.columns)
        return
    want = duck.sql(core.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


def test_core_runs_without_the_subpackage(tmp_path):
    """A copy of the repository without the subpackage and its tests imports and builds its queries."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    here = Path(__file__).resolve().parent.parent
    shutil.copytree(here, tmp_path / "copy", ignore=shutil.ignore_patterns("llm", ".git", "__pycache__"))
    assert not (tmp_path / "copy/sargam/llm").exists() and not (tmp_path / "copy/tests/llm").exists()
    code = "import __spark_entry__ as e; assert e.llm is None and 'catalog_build' in e.queries() and not any(n.startswith('p1_') for n in e.queries()) and set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path / "copy")
