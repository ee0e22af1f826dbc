"""Every registered query against its SQL on the smallest tables, and the package without its llm part."""

import math
import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
TABLES = "documents embeddings benchmark labels pages conversations events lineitem orders customer part supplier nation region".split()
NAMES = sorted(n for n in entry.queries() if not n.startswith("op") and n != "pipeline")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(value):
    if hasattr(value, "item"):
        value = value.item()
    if value is None or (isinstance(value, float) and math.isnan(value)) or str(value) in ("NaT", "<NA>"):
        return "null"
    return f"{value:.6g}" if isinstance(value, (int, float)) and not isinstance(value, bool) else str(value)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(map(plain, r)) for r in frame.values.tolist())


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    got = entry.queries()[name](spark, DATA).toPandas()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert list(got.columns)
        return
    want = duck.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).columns == ["query_id", "chunk", "score", "rank"]


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_rest_works_without_llm(tmp_path):
    top = os.path.dirname(os.path.abspath(entry.__file__))
    shutil.copytree(os.path.join(top, "provena"), tmp_path / "provena", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(top, "__spark_entry__.py"), tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(*e.queries())"], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert said.returncode == 0, said.stderr
    assert set(said.stdout.split()) == set(NAMES)
