"""Tables with a manifest of their order."""

from __future__ import annotations

import random

import pytest
from data import DUP, dup_rows
from pyspark.sql import functions as F

from brineframe.operators.merging import merge, merge_ordered
from brineframe.operators.order import ORDER
from brineframe.sources.ordered import ROW, OrderedTable

NAN = float("nan")


def test_numbers_pages_and_limits(spark, tmp_path):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), rng.choice([NAN, 1.0, 2.0, None]), k) for k in range(900)]
    table = OrderedTable.write(spark.createDataFrame(rows, "p string, x double, k long").repartition(5), str(tmp_path / "t"), ["p", "x", "k"], files=7)
    order = lambda r: (r[0] is not None, r[0] or "", r[1] is not None, r[1] != r[1], r[1] if r[1] == r[1] and r[1] is not None else 0, r[2])
    want = [k for _, _, k in sorted(rows, key=order)]
    got = {r[ROW]: r["k"] for r in table.numbered().collect()}
    assert [got[i + 1] for i in range(900)] == want and table.numbered().columns == ["p", "x", "k", ROW]
    assert [r["k"] for r in table.iterate()] == want
    manifest = table.manifest().orderBy("number").collect()
    assert 3 <= len(manifest) <= 7 and sum(r["rows"] for r in manifest) == 900 and [r["before"] for r in manifest] == [sum(x["rows"] for x in manifest[:i]) for i in range(len(manifest))]
    page = table.rows(300, 320)
    assert sorted((r[ROW], r["k"]) for r in page.collect()) == list(zip(range(300, 321), want[299:320])) and len(page.inputFiles()) <= 2
    assert "Sort" not in table.numbered()._jdf.queryExecution().optimizedPlan().toString()
    with pytest.raises(ValueError, match="no such rows"):
        table.rows(901, 950)


def test_a_merge_in_its_order(spark, tmp_path):
    rows = dup_rows()
    tables = [spark.createDataFrame(part, DUP).coalesce(1) for part in (rows[::2], rows[1::2])]
    table = merge_ordered(tables, str(tmp_path / "m"), files=3)
    want = merge(tables).collect()
    names = [c for c in table.numbered().columns if c != ROW]
    assert ORDER not in names and [repr([r[c] for c in names]) for r in table.iterate()] == [repr([r[c] for c in names]) for r in want]
    plain = merge_ordered(tables, str(tmp_path / "p"), number=False, keep_na_pres=True)
    assert [r["platform_code"] for r in plain.iterate()] == [r[0] for r in rows[::2] + rows[1::2]]


def test_an_empty_table(spark, tmp_path):
    table = OrderedTable.write(spark.range(0), str(tmp_path / "t"), ["id"])
    assert table.manifest().agg(F.sum("rows")).first()[0] in (None, 0) and list(table.iterate()) == []
