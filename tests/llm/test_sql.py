"""Queries with SQL against DuckDB on the smallest tables; the pipeline's stages keep the columns."""

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from check import TABLES, _rows
from folio.llm.common import ORACLES, QUERIES
from tests.llm import helpers

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    rel = con.sql(ORACLES[name])
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(rel.columns)
    assert _rows(df.collect(), df.columns) == _rows(rel.fetchall(), rel.columns)


def test_all_are_registered():
    names = set(entry.queries())
    assert set(QUERIES) | {"pipeline"} <= names and set(ORACLES) <= set(entry.oracle_sql())
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)}


def test_pipeline_over_odd_documents(spark):
    docs = helpers.odd(spark)
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == columns and docs.count() > 0, name
    texts = [r.text or "" for r in docs.collect()]
    assert len(texts) == len(set(texts)) or "" in texts
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in docs.collect()}
