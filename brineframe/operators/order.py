"""An explicit row order, for everything that means 'first'."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ORDER = "__order"


def with_order(df: DataFrame) -> DataFrame:
    """Adds ``__order``: file path and row number for tables read from Parquet, so that it survives any
    repartitioning; for others the row's place in the current partitions."""
    if ORDER in df.columns:
        return df
    try:
        out = df.withColumn(ORDER, F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("r")))
        out.schema
        return out
    except AnalysisException:
        return df.withColumn(ORDER, F.struct(F.lit("").alias("f"), F.monotonically_increasing_id().alias("r")))
