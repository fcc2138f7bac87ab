"""Every query of the library against its SQL on DuckDB, and those without SQL for stable schemas."""

from __future__ import annotations

import os
from collections import Counter

import duckdb
import pandas as pd
import pytest

from motionloom.plans import extra_queries, pose_queries, registry, table_queries, window_queries  # noqa: F401


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for name in os.listdir(sf):
        if name.endswith(".parquet"):
            con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{sf}/{name}'")
    return con


def rows(frame: pd.DataFrame) -> Counter:
    frame = frame[sorted(frame.columns)].astype(object)
    plain = lambda x: None if x is None or x is pd.NA or x != x else float(x) if isinstance(x, float) else x
    return Counter(tuple(plain(x) for x in r) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_equals_sql(spark, sf, duck, name):
    found, wanted = registry.QUERIES[name](spark, sf).toPandas(), duck.execute(registry.ORACLES[name]).df()
    assert sorted(found.columns) == sorted(wanted.columns)
    assert rows(found) == rows(wanted)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs_without_sql(spark, sf, name):
    assert registry.QUERIES[name](spark, sf).count() > 0


@pytest.mark.parametrize("left", [False, True])
def test_entry_works_without_the_llm_folders(tmp_path, sf, left):
    """The rest imports and runs with the subpackage, its tests and the pipeline deleted."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    for part in ("motionloom", "__spark_entry__.py"):
        source = root / part
        (shutil.copytree if source.is_dir() else shutil.copy)(source, tmp_path / part)
    shutil.rmtree(tmp_path / "motionloom" / "llm", ignore_errors=True)
    if left:  # an empty folder can be left over
        (tmp_path / "motionloom" / "llm" / "__pycache__").mkdir(parents=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and not any(n.startswith('op') for n in q) and set(e.oracle_sql()) <= set(q)"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=False)
    assert done.returncode == 0, done.stderr[-500:]
