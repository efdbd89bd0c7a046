"""Observation tables laid out by position, and reads that skip what a box can't hold.

Rows are sorted along a Z-curve: longitude and latitude become whole numbers whose bits take turns, so places that are near
on the map are near in the table. Files are ranges of the curve. Two things then let a read skip:

* a zone map, one row per file with the least and greatest coordinates and the number of rows without a position: files that no
  row of a box can be in are not opened at all, not even their footers;
* the row groups inside of a file, by their own least and greatest values, which Spark's Parquet reader compares with the
  filter. Rows without a position (NaN or null) lie at the end of the curve, in files of their own range, since one NaN would take a
  row group's limits away.

A table grows by batches. A batch's files count once its part of the zone map is there, which is written last.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.missing import require
from ..operators.cleaning import Box, filter_box, filter_region
from ..session import stored

#: Bits of each coordinate: cells of 0.00034 by 0.00017 degrees.
BITS = 20
#: Masks of the bits that stay after each doubling of the distance between them.
SPREAD = ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555))
#: Rows of a file, which one task sorts, and about how many bytes of a row group.
FILE_ROWS, GROUP_BYTES = 1_000_000, 16 << 20
ZONES = "file string, rows long, lost long, min_lon double, max_lon double, min_lat double, max_lat double"


def cell(value: Column, least: float, greatest: float) -> Column:
    """The number of the cell of a coordinate; what lies outside is in the outermost cell."""
    place = F.floor((value.cast("double") - least) / (greatest - least) * float(1 << BITS))
    return F.greatest(F.least(place, F.lit((1 << BITS) - 1)), F.lit(0)).cast("long")


def spread(x: Column) -> Column:
    """The bits of a number, with a 0 before each."""
    for shift, mask in SPREAD:
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask).cast("long"))
    return x


def placed(lon: Column, lat: Column) -> Column:
    """Whether both coordinates are numbers."""
    return lon.isNotNull() & lat.isNotNull() & ~F.isnan(lon.cast("double")) & ~F.isnan(lat.cast("double"))


def curve(lon: Column, lat: Column) -> Column:
    """The place on the Z-curve; rows without a position come last."""
    where = spread(cell(lon, -180.0, 180.0)).bitwiseOR(F.shiftleft(spread(cell(lat, -90.0, 90.0)), 1))
    return F.when(placed(lon, lat), where).otherwise(F.lit(1 << 2 * BITS).cast("long"))


class SpatialTable:
    """A table of observations at ``path``, by position. ``group_bytes`` is the size of a row group before compression."""

    def __init__(self, spark: SparkSession, path: str, group_bytes: int = GROUP_BYTES):
        self.spark, self.path, self.group_bytes = spark, path.rstrip("/"), group_bytes

    def append(self, df: DataFrame, files: int | None = None) -> None:
        """Adds rows as a batch of ``files`` files (by default from the number of rows). Nothing is visible before the end.
        What makes the rows runs once: they are written as they come, then counted and dealt out."""
        require(df.columns, "longitude", "latitude")
        df = stored(df, "unplaced")
        files = files or max(1, ceil(df.count() / FILE_ROWS))
        name = uuid.uuid4().hex
        key = curve(F.col("longitude"), F.col("latitude"))
        rows = df.withColumn("__z", key)
        # equal places are dealt out too, so that one busy place is no hot spot
        rows = rows.repartitionByRange(files, F.col("__z"), F.xxhash64(*(c for c in df.columns if not c.startswith("__")))).sortWithinPartitions("__z").drop("__z")
        rows.write.option("parquet.block.size", self.group_bytes).option("parquet.block.size.row.check.min", 100).parquet(f"{self.path}/rows-{name}")
        lon, lat = F.col("longitude").cast("double"), F.col("latitude").cast("double")
        there = placed(lon, lat)
        limits = [f(F.when(there, c)).alias(f"{n}_{e}") for e, c in (("lon", lon), ("lat", lat)) for n, f in (("min", F.min), ("max", F.max))]
        zones = self.spark.read.parquet(f"{self.path}/rows-{name}").groupBy(F.col("_metadata.file_path").alias("p")).agg(F.count(F.lit(1)).alias("rows"), F.count_if(~there).alias("lost"), *limits)
        # files are named from the table's folder on, so that it can be moved
        zones = zones.select(F.concat(F.lit(f"rows-{name}/"), F.substring_index("p", "/", -1)).alias("file"), "rows", "lost", "min_lon", "max_lon", "min_lat", "max_lat")
        zones.coalesce(1).write.mode("append").parquet(f"{self.path}/_zones")

    def zones(self) -> DataFrame:
        """The zone map: a row per file."""
        return self.spark.read.schema(ZONES).parquet(f"{self.path}/_zones")

    def _files(self, zones: DataFrame) -> DataFrame:
        """The rows of some files (their names come to the driver, as with any list of files)."""
        names = [r["file"] for r in zones.select("file").collect()]
        if names:
            return self.spark.read.parquet(*(f"{self.path}/{n}" for n in sorted(names)))
        first = self.zones().select("file").first()
        if first is None:
            raise ValueError(f"{self.path} has no rows yet")
        return self.spark.read.parquet(f"{self.path}/{first['file']}").limit(0)

    def rows(self) -> DataFrame:
        """All rows."""
        return self._files(self.zones())

    def box(self, box: Box, mode: str = "include") -> DataFrame:
        """``filter_box`` of the table, from the files that may hold such rows."""
        return filter_box(self._files(self.zones().where(may_meet(box) if mode == "include" else ~all_inside(box))), box, mode)

    def region(self, include: Box, exclude: Sequence[Box] = ()) -> DataFrame:
        """``filter_region`` of the table, from the files that may hold such rows."""
        keep = reduce(lambda a, b: a & ~all_inside(b), exclude, may_meet(include))
        return filter_region(self._files(self.zones().where(keep)), include, exclude)


def may_meet(box: Box) -> Column:
    """Of a zone: whether some row may be in a box. Rows without a position are in none."""
    meets = (F.col("max_lon") >= box.min_lon) & (F.col("min_lon") <= box.max_lon) & (F.col("max_lat") >= box.min_lat) & (F.col("min_lat") <= box.max_lat)
    return F.coalesce(meets, F.lit(False))


def all_inside(box: Box) -> Column:
    """Of a zone: whether every row is in a box."""
    inside = (F.col("min_lon") >= box.min_lon) & (F.col("max_lon") <= box.max_lon) & (F.col("min_lat") >= box.min_lat) & (F.col("max_lat") <= box.max_lat)
    return F.coalesce(inside & (F.col("lost") == 0), F.lit(False))


def is_spatial(spark: SparkSession, path: str) -> bool:
    """Whether there is a table by position at a path."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_zones")
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(where)
