"""Row filters and the whole-profile filter."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.missing import MEASURES, is_missing, require

ID = ("platform_code", "profile_no")


@dataclass(frozen=True)
class Box:
    min_lon: float
    max_lon: float
    min_lat: float
    max_lat: float

    def __post_init__(self):
        if self.min_lon > self.max_lon:
            raise ValueError(f"min longitude {self.min_lon} is above max longitude {self.max_lon}")
        if self.min_lat > self.max_lat:
            raise ValueError(f"min latitude {self.min_lat} is above max latitude {self.max_lat}")

    def inside(self) -> Column:
        """Inclusive on all sides. A NaN position is outside; a null one is neither in nor out."""
        lon, lat = F.col("longitude").cast("double"), F.col("latitude").cast("double")
        return _not_nan(lon) & _not_nan(lat) & (lon >= self.min_lon) & (lon <= self.max_lon) & (lat >= self.min_lat) & (lat <= self.max_lat)


def _not_nan(c: Column) -> Column:
    """False for NaN, null for null."""
    return F.when(c.isNotNull(), ~F.isnan(c))


def filter_box(df: DataFrame, box: Box, mode: str = "include") -> DataFrame:
    """Rows inside the box, or (``exclude``) outside it. Rows whose position is null leave either way
    unless another bound already puts them outside."""
    require(df.columns, "longitude", "latitude")
    if mode not in ("include", "exclude"):
        raise ValueError(f"mode {mode!r}; known are include and exclude")
    return df.where(box.inside() if mode == "include" else ~box.inside())


def filter_region(df: DataFrame, include: Box, exclude: Sequence[Box] = ()) -> DataFrame:
    """One pass for a region: inside one box and outside others."""
    require(df.columns, "longitude", "latitude")
    keep = include.inside()
    for box in exclude:
        keep = keep & ~box.inside()
    return df.where(keep)


def drop_qc(df: DataFrame) -> DataFrame:
    """Rows whose time and position flags are good ('1') or absent ('')."""
    require(df.columns, "time_qc", "position_qc")
    return df.where(F.col("time_qc").isin("1", "") & F.col("position_qc").isin("1", ""))


def drop_na_pres(df: DataFrame) -> DataFrame:
    require(df.columns, "pres")
    return df.where(F.col("pres").isNotNull() & ~F.isnan("pres"))


def drop_na(df: DataFrame, measures: Sequence[str] = MEASURES) -> DataFrame:
    """All rows of the profiles that have at least one valid value of each measure. Rows with a null
    platform or number never stay."""
    require(df.columns, *ID, *measures)
    have = df.groupBy(*ID).agg(*(F.max((~is_missing(m)).cast("int")).alias(f"__{m}") for m in measures))
    keep = have.where(F.lit(True) if not measures else sum((F.col(f"__{m}") for m in measures), F.lit(0)) == len(measures)).select(*ID)
    return df.join(keep, list(ID), "left_semi")


def clean(df: DataFrame, include: Box | None = None, exclude: Sequence[Box] = ()) -> DataFrame:
    """Flags, then measures, then region: the order of the pipeline."""
    df = drop_na(drop_qc(df))
    return df if include is None else filter_region(df, include, exclude)


__all__ = ["Box", "clean", "drop_na", "drop_na_pres", "drop_qc", "filter_box", "filter_region"]
