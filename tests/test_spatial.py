"""Tables by position: the same rows as plain filters, from a stated share of files and row groups."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from brineframe.cli import dispatch
from brineframe.operators.cleaning import Box, filter_box, filter_region
from brineframe.sources.spatial import BITS, SpatialTable, curve, is_spatial

NAN = float("nan")
SCHEMA = "longitude double, latitude double, platform_code string, v long"


def casts(spark, n=40_000):
    """Positions all over the map, a tenth of them at one place, some without one."""
    rows = spark.range(n).select(
        F.when(F.col("id") % 10 == 0, 5.5).when(F.col("id") % 97 == 0, NAN).when(F.col("id") % 89 == 0, None).otherwise(F.pmod(F.xxhash64("id"), F.lit(36000)) / 100 - 180).alias("longitude"),
        F.when(F.col("id") % 10 == 0, 55.5).when(F.col("id") % 83 == 0, NAN).otherwise(F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(18000)) / 100 - 90).alias("latitude"),
        F.concat(F.lit("P"), F.col("id") % 50).alias("platform_code"), F.col("id").alias("v"),
    )
    return rows.repartition(5)


def scanned(df) -> tuple[int, int]:
    """Files and rows that the scan of a plan gave, once it ran."""
    df.write.format("noop").mode("overwrite").save()
    rows = df.toPandas()
    plan = df._jdf.queryExecution().executedPlan()
    found, left = [], [plan]
    while left:
        node = left.pop()
        name = node.getClass().getSimpleName()
        left += [node.executedPlan()] if name == "AdaptiveSparkPlanExec" else [node.child()] if "Stage" in name and hasattr(node, "child") and name == "InputAdapter" else [node.children().apply(k) for k in range(node.children().size())]
        if name == "FileSourceScanExec":
            found.append((node.metrics().apply("numFiles").value(), node.metrics().apply("numOutputRows").value()))
    assert len(found) == 1
    return (*found[0], len(rows))


def test_the_curve_takes_bits_in_turns(spark):
    step_x, step_y = 360 / (1 << BITS), 180 / (1 << BITS)
    cells = [(0, 0), (1, 0), (0, 1), (1, 1), (2, 0), (5, 3), ((1 << BITS) - 1, (1 << BITS) - 1), (123456, 654321)]
    rows = [(x * step_x - 180 + step_x / 2, y * step_y - 90 + step_y / 2) for x, y in cells] + [(500.0, 95.0), (-999.0, -91.0), (NAN, 1.0), (None, 1.0), (1.0, NAN)]
    got = [r[0] for r in spark.createDataFrame(rows, "a double, b double").select(curve(F.col("a"), F.col("b"))).collect()]
    both = lambda x, y: sum((x >> k & 1) << 2 * k | (y >> k & 1) << 2 * k + 1 for k in range(BITS))
    assert got == [both(*c) for c in cells] + [both(*cells[6]), 0] + [1 << 2 * BITS] * 3


@pytest.mark.parametrize("box", [Box(-10.0, 20.0, 40.0, 60.0), Box(5.5, 5.5, 55.5, 55.5), Box(-180.0, 180.0, -90.0, 90.0), Box(170.0, 179.5, -89.0, -80.0), Box(200.0, 300.0, 0.0, 1.0)])
def test_rows_are_those_of_the_filters(spark, tmp_path_factory, box):
    folder = tmp_path_factory.getbasetemp() / "spatial-rows"
    rows = casts(spark, 4000).cache()
    table = SpatialTable(spark, str(folder))
    if not is_spatial(spark, str(folder)):
        for k in range(3):  # three batches
            table.append(rows.where(f"v % 3 = {k}"), files=4)
    key = lambda df: sorted(map(repr, df.collect()))
    assert table.rows().count() == 4000 and table.zones().agg(F.sum("rows")).first()[0] == 4000
    for mode in ("include", "exclude"):
        assert key(table.box(box, mode)) == key(filter_box(rows, box, mode))
    assert key(table.region(Box(-100.0, 100.0, -50.0, 80.0), [box])) == key(filter_region(rows, Box(-100.0, 100.0, -50.0, 80.0), [box]))


def test_a_box_reads_few_files_and_row_groups(spark, tmp_path):
    rows = casts(spark)
    table = SpatialTable(spark, str(tmp_path / "t"), group_bytes=8 << 10)
    table.append(rows, files=16)
    box = Box(-60.0, -40.0, 20.0, 30.0)  # 1 in 324 of the map
    files, read, out = scanned(table.box(box))
    assert out == filter_box(rows, box).count() > 50
    assert files <= 4 and read <= 40_000 / 12  # a quarter of the files, and of these a third of the rows
    rows.write.parquet(str(tmp_path / "plain"))
    assert scanned(filter_box(spark.read.parquet(str(tmp_path / "plain")), box))[:2] == (5, 40_000)
    # a place that a tenth of all rows share is not in one file alone
    busy = table.zones().where("min_lon <= 5.5 and max_lon >= 5.5 and min_lat <= 55.5 and max_lat >= 55.5")
    assert busy.count() >= 2 and table.zones().agg(F.max("rows")).first()[0] < 40_000 / 16 * 2


def test_the_whole_box_excluded_opens_what_it_must(spark, tmp_path):
    table = SpatialTable(spark, str(tmp_path / "t"))
    table.append(casts(spark, 3000), files=6)
    left = table.box(Box(-180.0, 180.0, -90.0, 90.0), "exclude")
    assert all(r["longitude"] is None or math.isnan(r["longitude"]) or math.isnan(r["latitude"]) for r in left.collect())
    assert scanned(left)[0] < 6


def test_odd_tables(spark, tmp_path):
    table = SpatialTable(spark, str(tmp_path / "t"))
    assert not is_spatial(spark, str(tmp_path / "t"))
    table.append(spark.createDataFrame([], SCHEMA))
    assert is_spatial(spark, str(tmp_path / "t"))
    with pytest.raises(ValueError, match="no rows"):
        table.rows()
    lost = spark.createDataFrame([(NAN, 1.0, "a", 1), (None, None, None, None), (2.0, NAN, "b", 2)], SCHEMA)
    table.append(lost)
    assert table.box(Box(-180.0, 180.0, -90.0, 90.0)).count() == 0 and table.rows().count() == 3
    assert sorted(map(repr, table.box(Box(0.0, 1.0, 0.0, 1.0), "exclude").collect())) == sorted(map(repr, filter_box(lost, Box(0.0, 1.0, 0.0, 1.0), "exclude").collect()))
    with pytest.raises(ValueError, match="longitude"):
        table.append(lost.drop("longitude"))
    # a batch without its part of the zone map was not finished
    lost.write.parquet(str(tmp_path / "t" / "rows-half"))
    assert table.rows().count() == 3


def test_commands(spark, tmp_path):
    rows = casts(spark, 2000)
    rows.write.parquet(str(tmp_path / "in"))
    dispatch(["arrange", str(tmp_path / "in"), str(tmp_path / "t")], spark)
    area = ["--min-lon", "-10", "--max-lon", "20", "--min-lat", "40", "--max-lat", "60"]
    for mode in ("include", "exclude"):
        for src in ("in", "t"):
            dispatch(["filter", "--mode", mode, *area, str(tmp_path / src), str(tmp_path / f"{src}-{mode}")], spark)
        a, b = (sorted(map(repr, spark.read.parquet(str(tmp_path / f"{src}-{mode}")).collect())) for src in ("in", "t"))
        assert a == b and a
