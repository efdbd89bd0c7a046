"""Profile-by-level grids to observation rows: conversions, coordinates, deployments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .teos10 import with_pressure, z_from_p

NAN = float("nan")


def _missing(c: Column, fill: Column | None) -> Column:
    bare = c.isNull() | F.isnan(c)
    return bare if fill is None else bare | F.coalesce(c == fill, F.lit(False))


def with_made_pressure(df: DataFrame, deph: Column, latitude: Column, name: str = "__made") -> DataFrame:
    """Adds the pressure at each depth, for ``pressure_from_depth``."""
    return with_pressure(df, -deph.cast("double"), latitude, name)


def pressure_from_depth(pres: Column, pres_qc: Column, deph: Column, deph_qc: Column, made: Column, fill: Column | None = None) -> tuple[Column, Column, Column]:
    """pres, pres_qc and a mark (1 where pres was missing and is now ``made`` from depth). Where the
    conversion has no result pres is NaN and the mark 0."""
    wanted = _missing(pres, fill) & ~_missing(deph, None)
    made = made.cast("float")
    done = wanted & ~F.isnan(made)
    value = F.when(wanted, made).otherwise(F.when(_missing(pres, fill), F.lit(NAN).cast("float")).otherwise(pres))
    return value, F.when(wanted, deph_qc).otherwise(pres_qc), F.coalesce(done, F.lit(False)).cast("byte")


def depth_from_pressure(deph: Column, deph_qc: Column, pres: Column, pres_qc: Column, latitude: Column, fill: Column | None = None) -> tuple[Column, Column, Column]:
    """deph, deph_qc and a mark (1 where deph was missing and is now computed from pressure)."""
    wanted = _missing(deph, fill) & ~_missing(pres, None)
    made = F.when(wanted, -z_from_p(pres.cast("double"), latitude)).cast("float")
    value = F.when(wanted, made).otherwise(F.when(_missing(deph, fill), F.lit(NAN).cast("float")).otherwise(deph))
    return value, F.when(wanted, pres_qc).otherwise(deph_qc), F.coalesce(wanted, F.lit(False)).cast("byte")


def filled_from(first: Column, other: Column) -> Column:
    """The first coordinate, or the other where it is missing."""
    return F.coalesce(F.nanvl(first, other), other, F.lit(NAN))


def deployed(times: DataFrame, deployments: DataFrame, time: str = "t", start: str = "start", value: str = "value", position: str = "position", file: str | None = None, span: int = 4096) -> DataFrame:
    """``times`` with the ``value`` of the latest deployment that started at or before each time.

    Starts below 0 act as 0; of equal starts the one with the larger ``position`` wins; before the
    first deployment the value is NaN. With ``file``, a column of both, each file has deployments of
    its own. Times and starts are sorted together in spans of ``span`` steps; a span that begins
    under way takes the last deployment of an earlier span. So nothing is broadcast, and one
    task never holds more than a span of a file. ``times`` keeps its other columns.
    """
    own = F.col(file) if file else F.lit(0)
    within = lambda c: F.floor(F.col(c) / span).alias("__span")
    runs = deployments.select(own.alias("__file"), F.greatest(F.col(start), F.lit(0)).cast("double").alias("__at"), F.struct(F.col(position).cast("long").alias("p"), F.col(value).alias("v")).alias("__run"))
    runs = runs.groupBy("__file", "__at").agg(F.max("__run").alias("__run")).select("__file", within("__at"), "__at", "__run")
    steps = times.select(own.alias("__file"), F.col(time).cast("double").alias("__at"), F.struct(*(F.col(f"`{c}`") for c in times.columns)).alias("__row")).select("__file", within("__at"), "__at", "__row")
    both = steps.unionByName(runs, allowMissingColumns=True)
    so_far = Window.partitionBy("__file", "__span").orderBy("__at", F.col("__row").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    steps = both.withColumn("__run", F.last("__run", True).over(so_far)).where("__row is not null")
    # a row per span: the last deployment of all spans before
    ends = both.groupBy("__file", "__span").agg(F.max_by("__run", F.when(F.col("__run").isNotNull(), F.col("__at"))).alias("__run"))
    before = Window.partitionBy("__file").orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(F.col("__file").alias("__f"), F.col("__span").alias("__s"), F.last("__run", True).over(before).alias("__before"))
    out = steps.join(ends, F.col("__file").eqNullSafe(F.col("__f")) & F.col("__span").eqNullSafe(F.col("__s"))).withColumn("__run", F.coalesce("__run", "__before"))
    return out.select(*(F.col(f"__row.`{c}`") for c in times.columns if c != value), F.when(F.col("__run").isNotNull(), F.col("__run.v")).otherwise(F.lit(NAN)).alias(value))


def deployed_in(starts: Column, values: Column, time: Column) -> Column:
    """As ``deployed``, for deployments that are arrays in the same row."""
    runs = F.array_sort(F.transform(F.arrays_zip(starts.alias("s"), values.alias("v")), lambda r, k: F.struct(F.greatest(r["s"], F.lit(0)).alias("s"), k.alias("p"), r["v"].alias("v"))))
    known = F.filter(runs, lambda r: r["s"] <= time)
    return F.when(F.size(known) > 0, F.element_at(known, -1)["v"]).otherwise(F.lit(NAN))
