"""Queries against their SQL in DuckDB. ``TIDEMARK_ALL_QUERIES=1`` checks every one of them."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = os.environ.get("TIDEMARK_SF_DIR", "/root/testdata/sf0.01")
QUICK = (
    "duplicate_hour_guard", "hourly_gap_fill", "daily_report", "zero_run_flag", "baseline_fit",
    "zscores", "expanding_splits", "ffill_bfill_impute", "robust_mad", "stream_hourly_readings",
)
SPARK_TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
    "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "date": "DATE",
}
NAMES = list(entry.oracle_sql()) if os.environ.get("TIDEMARK_ALL_QUERIES") else QUICK


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def ordered(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    result = duck.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    types = {c[0]: str(c[1]) for c in result.description}
    assert {c: SPARK_TYPES[kind] for c, kind in df.dtypes} == types
    assert ordered(map(tuple, df.collect()), df.columns) == ordered(result.fetchall(), columns)


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
