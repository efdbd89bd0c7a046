"""Tables whose order is written down: files are ranges of the order, each sorted, with a manifest of their limits.

The manifest has a row per file: its name, its number in the order, its rows, the rows before it, and its first and last key.
A row's number is the rows before its file and its place in it, so nothing is sorted to read rows by number, and a page of
the table opens only the files that hold it. The manifest is checked when it is written: no file begins before the one before it
ends. It is written last; a table without it was not finished.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from math import ceil

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..session import stored

#: The column of row numbers, from 1.
ROW = "__row"
#: Rows of a file: what one task sorts.
FILE_ROWS = 500_000


class OrderedTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def write(cls, df: DataFrame, path: str, keys: Sequence[str], drop: Sequence[str] = (), files: int | None = None) -> OrderedTable:
        """Writes a table in the order of ``keys``, which should tell all rows apart (ties have no stated order). Columns ``drop`` are
        part of the order, not of the table. By default a file for each FILE_ROWS rows. What makes the rows runs once: they are
        written as they come, then counted and dealt out by ranges."""
        spark, own = df.sparkSession, cls(df.sparkSession, path)
        df = stored(df, "unordered")
        files = files or max(1, ceil(df.count() / FILE_ROWS))
        name = f"rows-{uuid.uuid4().hex}"
        rows = df.repartitionByRange(files, *keys).sortWithinPartitions(*keys)
        rows.select(F.struct(*keys).alias("__key"), *(c for c in df.columns if c not in drop)).write.parquet(f"{own.path}/{name}")
        limits = spark.read.parquet(f"{own.path}/{name}").groupBy(F.col("_metadata.file_name").alias("file"))
        limits = limits.agg(F.count(F.lit(1)).alias("rows"), F.min_by("__key", F.col("_metadata.row_index")).alias("first"), F.max_by("__key", F.col("_metadata.row_index")).alias("last"), F.min("__key").alias("low"), F.max("__key").alias("high"))
        # a row per file; they are put in order and added up on the driver
        found = limits.orderBy("first", "last").withColumn("ends", F.struct(F.col("first") == F.col("low"), F.col("last") == F.col("high")))
        table = found.select(F.concat(F.lit(f"{name}/"), "file").alias("file"), "rows", "first", "last", "ends").collect()
        before, out = 0, []
        for k, r in enumerate(table):
            if not all(r["ends"]):
                raise ValueError(f"{r['file']} is not sorted")
            out.append((r["file"], k, r["rows"], before, r["first"], r["last"]))
            before += r["rows"]
        key = limits.schema["first"].dataType.simpleString()
        manifest = spark.createDataFrame(out, f"file string, number int, rows long, before long, first {key}, last {key}")
        following = manifest.select((F.col("number") - 1).alias("number"), F.col("first").alias("next"))
        if manifest.join(following, "number").where("last > next").head(1):
            raise ValueError(f"files of {path} overlap")
        manifest.coalesce(1).write.mode("overwrite").parquet(f"{own.path}/_order")
        return own

    def manifest(self) -> DataFrame:
        """file, number, rows, before, first, last; a row per file."""
        return self.spark.read.parquet(f"{self.path}/_order")

    def _read(self, manifest: DataFrame) -> DataFrame:
        """Rows of some files with their numbers."""
        own = manifest.select("file", "before").collect()
        if not own:
            raise ValueError(f"{self.path} has no such rows")
        rows = self.spark.read.parquet(*(f"{self.path}/{r['file']}" for r in own))
        names = [c for c in rows.columns if c != "__key"]
        rows = rows.withColumns({"__file": F.col("_metadata.file_name"), "__place": F.col("_metadata.row_index")})
        before = manifest.select(F.substring_index("file", "/", -1).alias("__file"), "before")
        return rows.join(before, "__file").select(*names, (F.col("before") + F.col("__place") + 1).alias(ROW))

    def numbered(self) -> DataFrame:
        """All rows with their numbers, in any order. Nothing is sorted."""
        return self._read(self.manifest())

    def rows(self, first: int, last: int) -> DataFrame:
        """The rows with numbers from ``first`` to ``last``, from the files that hold them."""
        return self._read(self.manifest().where((F.col("before") < last) & (F.col("before") + F.col("rows") >= first))).where(F.col(ROW).between(first, last))

    def iterate(self) -> Iterator[Row]:
        """All rows in order, a file at a time, without a sort; each file's rows come through the driver one partition at a time."""
        for r in self.manifest().orderBy("number").collect():
            # one partition for the file, whatever its size: its rows come in their order
            rows = self.spark.read.parquet(f"{self.path}/{r['file']}").drop("__key")
            yield from rows.withColumn(ROW, F.col("_metadata.row_index") + r["before"] + 1).coalesce(1).sortWithinPartitions(ROW).toLocalIterator()
