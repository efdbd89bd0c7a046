"""Sizes of tasks follow from the data, and what makes rows runs once."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from brineframe.operators import duplicates, merging
from brineframe.plans import report as reports
from brineframe.sources import ordered, spatial


def casts(spark, n):
    at = dt.datetime(2020, 1, 1)
    rows = [(f"P{k % 3}", k // 5, at + dt.timedelta(days=k // 10), float(k // 10), 50.0, "1", "1", 1.0, 2.0, float(k % 5)) for k in range(n)]
    return spark.createDataFrame(rows, "platform_code string, profile_no long, profile_timestamp timestamp_ntz, longitude double, latitude double, time_qc string, position_qc string, temp double, psal double, pres double")


def test_files_of_an_order(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ordered, "FILE_ROWS", 100)
    table = ordered.OrderedTable.write(spark.range(250), str(tmp_path / "t"), ["id"])
    assert table.manifest().count() == 3 and table.numbered().where(F.col("id") + 1 != F.col(ordered.ROW)).count() == 0


def test_ranges_of_a_merge(spark, monkeypatch):
    monkeypatch.setattr(merging, "FILE_ROWS", 20)
    out = merging.merge([casts(spark, 90)], number=False)
    assert out.rdd.getNumPartitions() == 5 and out.count() == 90


def test_files_by_position(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(spatial, "FILE_ROWS", 100)
    table = spatial.SpatialTable(spark, str(tmp_path / "t"))
    table.append(casts(spark, 250))
    assert table.zones().count() == 3 and table.rows().count() == 250


def test_report_of_marked_profiles(spark):
    df = casts(spark, 100)
    want = reports.report(duplicates.mark_duplicates(df)[0], "platform").collect()
    assert reports.marked_report(df).collect() == want and sum(r["dup_profiles"] for r in want) > 0


def test_profiles_are_made_once(spark):
    groups = duplicates.duplicate_groups(duplicates.profiles(casts(spark, 100)))
    assert "LogicalRDD" not in groups._jdf.queryExecution().analyzed().toString()
