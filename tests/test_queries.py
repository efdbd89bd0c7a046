"""Every registered query of the observation operators against its SQL, on the smallest benchmark tables."""

from __future__ import annotations

import os
from collections import Counter

import duckdb
import pytest

from brineframe.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no benchmark tables")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for name in os.listdir(SF):
        con.execute(f"create view {name[:-8]} as select * from read_parquet('{SF}/{name}')")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    fix = lambda v: "NaN" if isinstance(v, float) and v != v else v
    return Counter(tuple(fix(r[k]) for k in order) for r in data)


def test_each_has_sql():
    assert QUERIES.keys() == ORACLES.keys()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, tables, name):
    got = QUERIES[name](spark, SF)
    want = tables.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, map(tuple, got.collect())) == rows(columns, want.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert QUERIES.keys() <= __spark_entry__.queries().keys() and ORACLES.keys() <= __spark_entry__.oracle_sql().keys()


def test_all_deployments(spark):
    """Every customer is a step and every supplier a deployment, also beyond the first 200."""
    big = "/root/testdata/sf0.1"
    if not os.path.isdir(big):
        pytest.skip("no larger tables")
    con = duckdb.connect()
    for name in ("customer", "supplier"):
        con.execute(f"create view {name} as select * from read_parquet('{big}/{name}.parquet')")
    got, want = QUERIES["deploy_asof_all"](spark, big), con.execute(ORACLES["deploy_asof_all"])
    found = rows(got.columns, map(tuple, got.collect()))
    assert found == rows([c[0] for c in want.description], want.fetchall()) and sum(found.values()) == con.execute("select count(*) from customer").fetchone()[0]
