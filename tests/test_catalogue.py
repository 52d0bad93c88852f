"""Every query against its SQL on the smallest tables, where those are there."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from lumigrid.plans import catalogue

FOLDER = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in ("embeddings", "orders", "events", "documents"):
        con.execute(f"create view {name} as select * from '{FOLDER}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query(spark, tables, name):
    df = catalogue.QUERIES[name](spark, FOLDER)
    cols = sorted(df.columns)
    key = lambda r: tuple((x is None, x) for x in r)
    got = sorted((tuple(r) for r in df.select(*cols).collect()), key=key)
    want = sorted(tables.execute(f"select {', '.join(cols)} from ({catalogue.ORACLES[name]})").fetchall(), key=key)
    assert got == want and got


@pytest.mark.parametrize("pipeline", [True, False])
def test_entry_works_without_the_text_package(tmp_path, pipeline):
    """On a copy whose text package is deleted, with the pipeline's file or without."""
    root = Path(__file__).resolve().parents[1]
    skip = shutil.ignore_patterns(".git", "llm", "__pycache__", *([] if pipeline else ["corpus_pipeline.py"]))
    shutil.copytree(root, tmp_path / "copy", ignore=skip)
    code = "import __spark_entry__ as e; print(*sorted(e.queries())); print(*sorted(e.oracle_sql()))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", env=env, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    assert [line.split() for line in out.stdout.splitlines()] == [sorted(catalogue.QUERIES), sorted(catalogue.ORACLES)]


def test_entry(spark):
    import __spark_entry__ as e

    assert set(catalogue.QUERIES) <= set(e.queries())
    assert e.entry(spark).count() > 0


def test_bad_checksums_are_found(spark):
    rows = catalogue.QUERIES["serde_crc"](spark, FOLDER).collect()
    assert all((r.error == "Invalid data checksum") == (r.image_id % 7 == 3) for r in rows)
