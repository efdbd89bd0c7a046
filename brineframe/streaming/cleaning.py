"""Row filters on a stream of observations.

The row predicates need no state, so they run on a stream unchanged. Filters of whole
profiles need all rows of a profile: a profile's rows arrive in one file, so they run
per micro-batch.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.cleaning import Box, drop_na, drop_na_pres, drop_qc, filter_region


def clean_rows(stream: DataFrame, include: Box | None = None, exclude: Sequence[Box] = (), keep_na_pres: bool = True) -> DataFrame:
    out = drop_qc(stream)
    if include is not None:
        out = filter_region(out, include, exclude)
    return out if keep_na_pres else drop_na_pres(out)


def clean_files(stream: DataFrame, dest: str, checkpoint: str, include: Box | None = None, exclude: Sequence[Box] = ()) -> StreamingQuery:
    """Cleans files as they arrive, profiles without measures included, into a Parquet table. A batch
    that is run again replaces what it wrote before."""

    def write(batch: DataFrame, number: int) -> None:
        drop_na(clean_rows(batch, include, exclude)).write.mode("overwrite").parquet(f"{dest}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
