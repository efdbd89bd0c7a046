"""Reports as lines that executors make and write: nothing of a row comes to the driver.

A report's lines are ranges of its order (``sources.ordered``), so a line has a number. ``write_lines_of`` joins the files of
all ranges to one, byte by byte in their order.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cells import cell, json_cell, shortest
from ..session import work_path
from ..sources.ordered import ROW, OrderedTable

#: Bytes that are copied at once.
CHUNK = 1 << 20


def tsv_line(df: DataFrame) -> Column:
    return F.concat_ws("\t", *(cell(F.col(f.name), f.dataType) for f in df.schema.fields))


def json_record(df: DataFrame) -> Column:
    fields = [F.concat(F.lit(f"{json.dumps(f.name, ensure_ascii=False)}:"), json_cell(F.col(f.name), f.dataType)) for f in df.schema.fields]
    return F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}"))


def duplicates_line() -> Column:
    """A line of the duplicates table; its numbers are not rounded."""
    ts = F.col("profile_timestamp")
    stamp = F.when(F.date_format(ts, "SSSSSS") == "000000", F.date_format(ts, "yyyy-MM-dd HH:mm:ss")).otherwise(F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSS"))
    parts = [F.col("dup_group").cast("string"), F.col("platform_code"), F.col("profile_no").cast("string"), shortest(F.col("profile_time")), F.coalesce(stamp, F.lit("")), shortest(F.col("longitude")), shortest(F.col("latitude")), F.col("n_obs").cast("string")]
    return F.concat_ws("\t", *parts)


def lines_of(df: DataFrame, text: Column, keys: Sequence[str], files: int | None = None) -> OrderedTable:
    """A table of one column, the lines of ``df`` in the order of ``keys``."""
    rows = df.select(*(F.col(k).alias(f"__{k}") for k in keys), text.alias("text"))
    return OrderedTable.write(rows, work_path(df.sparkSession, "lines"), [f"__{k}" for k in keys], [f"__{k}" for k in keys], files)


def numbered_lines(df: DataFrame, text: Column, keys: Sequence[str], head: str | None = None, files: int | None = None) -> DataFrame:
    """line (from 0 for ``head``, else from 1) and text of a report."""
    spark = df.sparkSession
    body = lines_of(df, text, keys, files).numbered().select(F.col(ROW).alias("line"), "text")
    return body if head is None else spark.createDataFrame([(0, head)], "line long, text string").unionByName(body)


def write_lines_of(df: DataFrame, text: Column, keys: Sequence[str], dest: str, head: str | None = None, files: int | None = None) -> None:
    """Writes a report to one text file. Its lines are made and written by executors; the driver copies bytes of their files, in
    order, through Hadoop's file system. The file is there when it is whole."""
    spark = df.sparkSession
    table = lines_of(df, text, keys, files)
    folder = work_path(spark, "text")
    hadoop = spark._jvm.org.apache.hadoop.fs
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    to = hadoop.Path(dest)
    store = to.getFileSystem(conf)
    draft = hadoop.Path(f"{dest}.{uuid.uuid4().hex}.draft")
    out = store.create(draft, True)
    try:
        if head is not None:
            out.write(bytearray(f"{head}\n".encode()))
        for r in table.manifest().orderBy("number").collect():
            # a file of the order is one of text, from one task
            part = f"{folder}/{r['number']}"
            spark.read.parquet(f"{table.path}/{r['file']}").select("text", F.col("_metadata.row_index").alias("k")).coalesce(1).sortWithinPartitions("k").select("text").write.text(part)
            source = hadoop.Path(part).getFileSystem(conf)
            for x in source.globStatus(hadoop.Path(f"{part}/part-*")):
                stream = source.open(x.getPath())
                spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, CHUNK, False)
                stream.close()
    finally:
        out.close()
    store.delete(to, False)
    store.rename(draft, to)
