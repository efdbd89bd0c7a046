from __future__ import annotations

import datetime as dt

import pytest
from data import NAN

from brineframe.operators.merging import merge

SCHEMA = "platform_code string, profile_timestamp timestamp_ntz, longitude double, latitude double, pres float, profile_no long, observation_no long"
T = dt.datetime(2020, 1, 1)


def table(spark, tmp_path, name, rows, schema=SCHEMA):
    path = str(tmp_path / name)
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
    return spark.read.parquet(path)


def cast(pressures, platform="A", lon=1.0, t=T, first=1):
    return [(platform, t, lon, 50.0, p, 7, first + k) for k, p in enumerate(pressures)]


def test_order(spark, tmp_path):
    df = table(spark, tmp_path, "a", cast([30.0, 20.0, 10.0]))
    assert [(r["pres"], r["observation_no"]) for r in merge([df]).collect()] == [(10.0, 1), (20.0, 2), (30.0, 3)]
    assert [(r["pres"], r["observation_no"]) for r in merge([df], sort_by_pres=False).collect()] == [(30.0, 1), (20.0, 2), (10.0, 3)]
    assert [r["pres"] for r in merge([df], number=False).collect()] == [30.0, 20.0, 10.0]
    assert merge([df]).columns == df.columns


def test_missing_pressure(spark, tmp_path):
    df = table(spark, tmp_path, "a", cast([10.0, NAN, 20.0, NAN, 30.0]))
    assert [r["observation_no"] for r in merge([df]).collect()] == [1, 2, 3]
    assert merge([df], keep_na_pres=True).count() == 5


def test_profiles_are_ranked_by_text_and_sorted_by_number(spark, tmp_path):
    df = table(spark, tmp_path, "a", cast([1.0], lon=9.0) + cast([1.0], lon=10.0) + cast([1.0], lon=10.05) + cast([1.0], "B"))
    got = [(r["platform_code"], r["longitude"], r["profile_no"]) for r in merge([df]).collect()]
    assert got == [("A", 9.0, 3), ("A", 10.0, 2), ("A", 10.05, 1), ("B", 1.0, 1)]


@pytest.mark.parametrize("parts", [1, 3, 17])
def test_partitions_do_not_matter(spark, tmp_path, parts):
    rows = [x for p in "ABC" for lon in (1.0, 2.5, 3.25) for x in cast([5.0, 3.0, 4.0], p, lon)]
    a, b = table(spark, tmp_path, "a", rows[::2]), table(spark, tmp_path, "b", rows[1::2])
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    got = [tuple(r) for r in merge([a, b]).collect()]
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert got == [tuple(r) for r in merge([a, b]).collect()]
    assert [r[-1] for r in got] == [1, 2, 3] * 9


def test_floats_meet_doubles_and_columns_must_agree(spark, tmp_path):
    a = table(spark, tmp_path, "a", cast([1.0]))
    b = table(spark, tmp_path, "b", cast([2.0]), SCHEMA.replace("longitude double", "longitude float"))
    out = merge([a, b])
    assert dict(out.dtypes)["longitude"] == "double" and [r["observation_no"] for r in out.collect()] == [1, 2]
    with pytest.raises(ValueError, match="differ"):
        merge([a, b.drop("pres")])
    with pytest.raises(ValueError):
        merge([])
