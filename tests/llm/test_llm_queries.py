"""Registered queries that SQL can express, against DuckDB on the smallest benchmark tables."""

from __future__ import annotations

import os
from collections import Counter

import duckdb
import pytest

from brineframe.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no benchmark tables")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "embeddings"):
        con.execute(f"create view {table} as select * from read_parquet('{SF}/{table}.parquet')")
    got = QUERIES[name](spark, SF)
    want = con.execute(ORACLES[name])
    columns = sorted(c[0] for c in want.description)
    place = [[c[0] for c in want.description].index(c) for c in columns]
    assert sorted(got.columns) == columns
    assert Counter(tuple(r) for r in got.select(*columns).collect()) == Counter(tuple(r[k] for k in place) for r in want.fetchall())


def test_every_document_has_a_row(spark):
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    for name in ("op5_quality_classifier", "op8_ngram_join"):
        assert QUERIES[name](spark, SF).select("doc_id").distinct().count() == n
