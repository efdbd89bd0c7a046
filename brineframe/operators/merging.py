"""Merging observation tables and numbering their profiles anew."""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.missing import require
from ..session import stored
from ..sources.ordered import FILE_ROWS, OrderedTable
from .cleaning import drop_na_pres
from .order import ORDER, with_order

KEY = ("platform_code", "profile_timestamp", "longitude", "latitude")


def renumber(df: DataFrame, sort_by_pres: bool = True) -> DataFrame:
    """New profile_no and observation_no.

    A profile is a platform, time and position; within a platform profiles are numbered in the
    order of the *text* of time, longitude and latitude. Observations are numbered by pressure, or
    in their order of arrival. Distinct profiles are ranked per platform and day, and days summed up
    per platform; observations are ranked per profile. So a platform with most of the rows is no hot spot.
    """
    require(df.columns, *KEY, *(["pres"] if sort_by_pres else []))
    columns = [c for c in dict.fromkeys([*df.columns, "profile_no", "observation_no"]) if c != ORDER]
    text = F.concat(*[x for c in KEY for x in (F.col(c).cast("string"), F.lit("|"))][:-1])
    rows = with_order(df).withColumn("__profile", text).drop("profile_no", "observation_no")
    order = [F.col(c) for c in KEY[1:]] + ([F.col("pres")] if sort_by_pres else []) + [F.col(ORDER)]
    rows = rows.withColumn("observation_no", F.row_number().over(Window.partitionBy("platform_code", "__profile").orderBy(*order)).cast("long"))
    # the order of texts is that of their first ten characters (the date), then of the rest
    distinct = rows.select(F.col("platform_code").alias("__p"), F.substring("__profile", 1, 10).alias("__d"), F.col("__profile").alias("__t")).distinct()
    days = distinct.groupBy("__p", "__d").agg(F.count(F.lit(1)).alias("n"))
    earlier = F.sum("n").over(Window.partitionBy("__p").orderBy("__d").rowsBetween(Window.unboundedPreceding, -1))
    days = days.select(F.col("__p").alias("__q"), F.col("__d").alias("__e"), F.coalesce(earlier, F.lit(0)).alias("__before"))
    in_day = F.row_number().over(Window.partitionBy("__p", "__d").orderBy("__t"))
    numbers = distinct.withColumn("__n", in_day).join(days, F.col("__p").eqNullSafe(F.col("__q")) & F.col("__d").eqNullSafe(F.col("__e")))
    numbers = numbers.select("__p", "__t", (F.col("__before") + F.col("__n")).cast("long").alias("profile_no"))
    out = rows.join(numbers, F.col("platform_code").eqNullSafe(F.col("__p")) & F.col("__profile").eqNullSafe(F.col("__t")))
    return out.select(*columns, ORDER)


def merge(tables: Sequence[DataFrame], number: bool = True, sort_by_pres: bool = True, keep_na_pres: bool = False, by_path: bool = False) -> DataFrame:
    """Union of tables with equal columns, without rows that lack pressure, numbered anew.

    Coordinates that are float in one table and double in another become double. The result is
    sorted by platform, time, position and pressure, ties in the order of arrival: that of the
    tables, or with ``by_path`` that of their files' paths, so that a table may stand for many files.
    """
    out, keys = merged_rows(tables, number, sort_by_pres, keep_na_pres, by_path)
    # made once, then sorted in ranges of so many rows that a task has memory for, whatever the number of rows
    out = stored(out, "merged-rows")
    ranges = max(1, ceil(out.count() / FILE_ROWS))
    return out.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys).drop(ORDER)


def merge_ordered(tables: Sequence[DataFrame], path: str, number: bool = True, sort_by_pres: bool = True, keep_na_pres: bool = False, by_path: bool = False, files: int | None = None) -> OrderedTable:
    """``merge``, written with its order: see ``sources.ordered``."""
    out, keys = merged_rows(tables, number, sort_by_pres, keep_na_pres, by_path)
    return OrderedTable.write(out, path, keys, [ORDER], files)


def merged_rows(tables: Sequence[DataFrame], number: bool, sort_by_pres: bool, keep_na_pres: bool, by_path: bool) -> tuple[DataFrame, list[str]]:
    """The rows of ``merge`` in no order, and the columns that they are ordered by."""
    if not tables:
        raise ValueError("nothing to merge")
    names = [c for c in tables[0].columns if c != ORDER]
    for t in tables[1:]:
        if odd := {*t.columns} ^ {*tables[0].columns}:
            raise ValueError(f"tables differ in columns: {', '.join(sorted(odd))}")
    wide = {c for c in names if {"float", "double"} <= {dict(t.dtypes)[c] for t in tables}}
    out = None
    for k, t in enumerate(tables):
        t = with_order(t).withColumn(ORDER, F.struct(F.lit(0 if by_path else k).alias("k"), F.col(f"{ORDER}.f").alias("f"), F.col(f"{ORDER}.r").alias("r")))
        t = t.select(*(F.col(c).cast("double").alias(c) if c in wide else F.col(c) for c in names), ORDER)
        out = t if out is None else out.unionByName(t)
    if not keep_na_pres:
        out = drop_na_pres(out)
    if not number:
        return out, [ORDER]
    # rows that tie in all else are in the order of their numbers
    return renumber(out, sort_by_pres), [*KEY, *(["pres"] if sort_by_pres else []), ORDER, "observation_no"]
