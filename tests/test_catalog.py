"""Every query with SQL equals DuckDB; every query runs and has the columns it names."""

import glob
import os

import duckdb
import pytest

from marlstone.plans import catalog, catalog_models, catalog_tables  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return c


def shown(rows):
    return sorted(map(repr, rows))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rows = [tuple(r) for r in df.select(*cols).collect()]
    if name in catalog.SQL:
        rel = duck.sql(catalog.SQL[name])
        assert sorted(rel.columns) == cols
        assert shown(rel.project(", ".join(f'"{c}"' for c in cols)).fetchall()) == shown(rows)
    else:
        assert rows


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("code", ["import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries())", "import runpy, sys; sys.argv = ['cli', '--help']; runpy.run_module('marlstone.plans.cli', run_name='__main__')"])
def test_imports_need_no_session(code):
    import subprocess
    import sys
    from pathlib import Path

    done = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parent.parent, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
