"""Parquet tables of observations."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, *paths: str | Path, pattern: str | None = None) -> DataFrame:
    reader = spark.read.option("recursiveFileLookup", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.parquet(*map(str, paths))


def stem() -> Column:
    """The name of the row's file without its last extension."""
    return F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "")


def write(df: DataFrame, path: str | Path, mode: str = "overwrite") -> None:
    """A Parquet table; one without rows keeps its schema."""
    df.write.mode(mode).parquet(str(path))
