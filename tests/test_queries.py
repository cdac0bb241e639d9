"""Registered queries against their SQL on the smallest tables."""

import re

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, _rows

SF = "/root/testdata/sf0.001"
NAMES = [n for n in entry.oracle_sql() if not re.match(r"op\d+_|pipeline$", n)]  # those of the pipeline are tested in their own folder


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.sql("SET enable_progress_bar = false")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    rel = con.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert _rows(df.collect(), df.columns) == _rows(rel.fetchall(), rel.columns)


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
