from __future__ import annotations

import pytest
from data import DUP, NAN, day, dup_rows

from brineframe.functions.keys import KeyOptions
from brineframe.operators.duplicates import drop_duplicate_profiles, group_sizes, mark_duplicates, within_across
from brineframe.plans.render import duplicates_tsv


@pytest.fixture(params=[1, 3, 17])
def table(spark, tmp_path, request):
    path = str(tmp_path / "t")
    spark.createDataFrame(dup_rows(), DUP).repartition(request.param).write.parquet(path)
    return spark.read.parquet(path)


def ids(df, where="true"):
    return sorted({(r["platform_code"], r["profile_no"]) for r in df.where(where).collect()})


def test_mark(table):
    marked, report = mark_duplicates(table)
    assert ids(marked, "is_dup") == [("V", 4), ("V", 5), ("W", 9), ("Y", 1), ("Y", 2)]
    assert marked.count() == table.count() and marked.columns == [*table.columns, "is_dup"]
    rows = [(r["dup_group"], r["platform_code"], r["profile_no"], r["n_obs"]) for r in report.collect()]
    assert rows == [(1, "V", 4, 3), (1, "W", 9, 1), (2, "V", 5, 2), (2, "Y", 1, 4), (2, "Y", 2, 4)]
    again, _ = mark_duplicates(marked)
    assert ids(again, "is_dup") == ids(marked, "is_dup") and again.columns == marked.columns
    text = duplicates_tsv(report).splitlines()
    assert text[1].split("\t") == ["1", "V", "4", "22712.25", "2011-03-09 02:30:00", "-7.25", "58.1204", "3"]


def test_dedup(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame(dup_rows(), DUP).coalesce(1).write.parquet(path)
    table = spark.read.parquet(path)
    marked, _ = mark_duplicates(table)
    kept = drop_duplicate_profiles(marked)
    assert ids(kept) == [("V", 4), ("X", 2), ("Y", 1), ("Z", 7), ("Z", 8)]
    assert kept.where("is_dup").count() == 0 and "is_dup" not in drop_duplicate_profiles(table).columns


def test_ties_go_to_the_first_seen_however_the_scan_is_split(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = [(p, 1, 1, 0.0, day("2020-01-01"), 1.0, 1.0, 1.0, 1.0, 1.0, "", "", "") for p in "ZYXWVUTSRQ"]
    spark.createDataFrame(rows, DUP).coalesce(1).write.option("parquet.block.size", 1024).parquet(path)
    for size in ("128m", "1k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        assert ids(drop_duplicate_profiles(spark.read.parquet(path))) == [("Z", 1)]
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_options_and_null_ids(spark):
    base = lambda p, n, t, lon: (p, n, 1, 0.0, t and day(t), lon, 1.0, 1.0, 1.0, 1.0, "", "", "")
    rows = [base(None, None, "2020-01-01 01:00:00", 1.0004), base("", 0, "2020-01-01 01:00:00", 1.0004), base("A", 1, "2020-01-01 02:00:00", 1.0), base("B", 1, None, 1.0), base("C", 1, None, 1.0), base("D", 1, "2020-01-01", NAN)]
    df = spark.createDataFrame(rows, DUP)
    _, report = mark_duplicates(df)  # null ids are the profile ('', 0)
    assert [(r["platform_code"], r["n_obs"]) for r in report.collect()] == [("", 2), ("A", 1)]
    assert mark_duplicates(df, KeyOptions("%Y-%m-%d %H"))[1].count() == 0
    assert mark_duplicates(df, KeyOptions(decimals=4))[1].count() == 0
    assert mark_duplicates(df, KeyOptions(round_mode="ceil"))[1].count() == 0
    assert mark_duplicates(df, KeyOptions(round_mode="floor"))[1].count() == 2
    for bad in ({"time_format": "%Q"}, {"round_mode": "up"}, {"decimals": -1}):
        with pytest.raises(ValueError):
            KeyOptions(**bad)


def test_groups_are_numbered_by_time_over_many_times(spark):
    rows = [(p, k, 1, 0.0, day(f"20{k % 7 + 10}-0{k % 3 + 1}-11 0{k % 5}:00:00"), float(k), 1.0, 1.0, 1.0, 1.0, "", "", "") for k in range(60) for p in "AB"]
    report = mark_duplicates(spark.createDataFrame(rows, DUP).repartition(7), KeyOptions("%Y-%m-%dT%H"))[1].collect()
    order = sorted({(r["profile_timestamp"], r["longitude"]) for r in report})
    assert len(report) == 120 and all(order[r["dup_group"] - 1] == (r["profile_timestamp"], r["longitude"]) for r in report)


def test_sizes_and_split(spark):
    rows = [(1, "A", 2), (1, "A", 3), (2, "A", 1), (2, "B", 1), (2, "B", 4), *[(3, "C", 1)] * 12]
    report = spark.createDataFrame(rows, "dup_group long, platform_code string, n_obs long")
    assert sorted(tuple(r) for r in group_sizes(report).collect()) == [(2, 1, 2), (3, 1, 3), (11, 1, 12)]
    got = {r["kind"]: (r["n_groups"], r["n_profiles"], r["n_obs"], r["n_platforms"]) for r in within_across(report).collect()}
    assert got == {"within": (2, 14, 17, 2), "across": (1, 3, 6, 2)}
