from __future__ import annotations

import pytest
from data import BOX, NA, NAN, QC, box_rows, na_rows, plain, qc_rows

from brineframe.operators.cleaning import Box, clean, drop_na, drop_na_pres, drop_qc, filter_box, filter_region
from brineframe.plans.regions import REGIONS


def ids(df):
    return sorted({(r["platform_code"], r["profile_no"]) for r in df.collect()})


@pytest.mark.parametrize("parts", [1, 3, 17])
def test_box(spark, parts):
    df = spark.createDataFrame(box_rows(), BOX).repartition(parts)
    near = Box(-3, 0, 60, 62)
    assert ids(filter_box(df, near)) == [("K7", 3), ("Q", 1)]
    assert ids(filter_box(df, near, "exclude")) == [("K7", 8), ("M2", 3), ("M2", 5)]
    assert ids(filter_box(df, Box(-3, 12, 60, 64))) == [("K7", 3), ("K7", 8), ("M2", 3), ("Q", 1)]
    assert filter_box(df, near).count() == 4 and filter_box(df, near).columns == df.columns


def test_box_edges_and_errors(spark):
    df = spark.createDataFrame([(-1.0, 2.0), (1.0, 2.5), (1.25, 2.0)], "longitude double, latitude double")
    assert filter_box(df, Box(-1, 1, 2, 2.5)).count() == 2
    for bad in ((5, -5, 0, 1), (0, 1, 5, -5)):
        with pytest.raises(ValueError):
            Box(*bad)
    with pytest.raises(ValueError):
        filter_box(df, Box(0, 1, 0, 1), "around")
    with pytest.raises(ValueError):
        filter_box(df.drop("latitude"), Box(0, 1, 0, 1))


def test_null_position_leaves_either_way_unless_another_bound_decides(spark):
    df = spark.createDataFrame([(None, 0.0), (None, 50.0), (NAN, 0.0), (0.0, 0.0)], "longitude double, latitude double")
    box = Box(-5, 5, -5, 5)
    assert [tuple(r) for r in filter_box(df, box).collect()] == [(0.0, 0.0)]
    assert plain(filter_box(df, box, "exclude").collect()) == plain([(None, 50.0), (NAN, 0.0)])


def test_region_equals_its_boxes_one_by_one(spark):
    rows = [(float(x), float(y)) for x in range(-10, 40, 2) for y in range(25, 70, 2)]
    df = spark.createDataFrame(rows, "longitude double, latitude double")
    for region in REGIONS.values():
        step = filter_box(df, region.include)
        for box in region.exclude:
            step = filter_box(step, box, "exclude")
        assert plain(filter_region(df, region.include, region.exclude).collect()) == plain(step.collect())


def test_filters_reach_the_scan(spark, tmp_path):
    spark.createDataFrame(box_rows(), BOX).write.parquet(str(tmp_path / "t"))
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    plan = filter_box(spark.read.parquet(str(tmp_path / "t")).select("longitude", "latitude"), Box(-5, 5, -5, 5))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual" in plan and "temp" not in plan


@pytest.mark.parametrize("parts", [1, 3, 17])
def test_dropqc(spark, parts):
    df = spark.createDataFrame(qc_rows(), QC).repartition(parts)
    assert ids(drop_qc(df)) == [("R1", 2), ("R1", 4), ("S9", 2)] and drop_qc(df).count() == 9


def test_dropqc_drops_nulls_and_keeps_the_schema(spark, tmp_path):
    df = spark.createDataFrame([("A", 1, 1, None, "1"), ("A", 1, 1, "4", "4")], QC)
    drop_qc(df).write.parquet(str(tmp_path / "none"))
    back = spark.read.parquet(str(tmp_path / "none"))
    assert back.count() == 0 and back.columns == df.columns


@pytest.mark.parametrize("parts", [1, 3, 17])
def test_dropna(spark, parts):
    df = spark.createDataFrame(na_rows(), NA).repartition(parts)
    assert ids(drop_na(df)) == [("H", 10), ("J", 2)] and drop_na(df).count() == 5


def test_dropna_never_keeps_null_ids(spark):
    df = spark.createDataFrame([(None, 1, 1, 1.0, 1.0, 1.0), ("A", None, 1, 1.0, 1.0, 1.0), ("A", 1, 1, 1.0, None, 1.0)], NA)
    assert drop_na(df).count() == 0


def test_drop_na_pres(spark):
    df = spark.createDataFrame([(1.0,), (NAN,), (None,)], "pres double")
    assert [r["pres"] for r in drop_na_pres(df).collect()] == [1.0]


def test_clean_checks_flags_before_measures(spark):
    """A profile whose only values are on rows with bad flags goes too."""
    schema = "platform_code string, profile_no long, time_qc string, position_qc string, temp double, psal double, pres double, longitude double, latitude double"
    rows = [("A", 1, "4", "1", 1.0, 1.0, 1.0, 10.0, 70.0), ("A", 1, "1", "1", NAN, 1.0, 1.0, 10.0, 70.0), ("B", 1, "1", "", 1.0, 1.0, 1.0, 10.0, 70.0), ("B", 2, "1", "", 1.0, 1.0, 1.0, 10.0, 50.0)]
    arctic = REGIONS["arctic"]
    assert ids(clean(spark.createDataFrame(rows, schema), arctic.include, arctic.exclude)) == [("B", 1)]
