"""Every registered query with SQL next to it, on the smallest test tables."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
from syntabula.plans import load
from syntabula.session import release_tables
from tools.check_queries import compare

FOLDER = Path("/root/testdata/sf0.001")
NAMES = sorted(load()[1])
#: Queries that refuse groups of fewer than 20 values get the next larger tables.
LARGER = {"bootstrap_support", "validated_peaks"}

pytestmark = pytest.mark.skipif(not FOLDER.is_dir(), reason="test tables absent")


def tables(folder):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for path in folder.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


@pytest.fixture(scope="module")
def duck():
    return tables(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_rows_equal_the_sql(spark, duck, name):
    folder = FOLDER.with_name("sf0.01") if name in LARGER else FOLDER
    con = tables(folder) if name in LARGER else duck
    got = load()[0][name](spark, str(folder)).toPandas()
    release_tables(spark)
    # A table this small may leave nothing to report.
    assert compare(got, con.sql(load()[1][name]).df()) in ("", "EMPTY")


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
