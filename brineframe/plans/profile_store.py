"""Profiles of a product, kept up file by file, so that a new file costs that file alone.

For each file the store holds what its rows say about each profile, as partial rows that merge: the first row's attributes with its
order, counts, extremes and sums. Reports, duplicate groups and comparisons are made of the merged rows; they open no file
of the product. ``update`` looks at the list of files and reads those that are new or have changed; what a file said
before, or a file that is gone, no longer counts from then on.

State (a ``Ledger``): ``files`` (file, size, modified; size null: gone) and ``partials`` by file, both by batch. Of each file
the last batch counts.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import KeyOptions
from ..functions.missing import MEASURES
from ..functions.times import days_to_ms, timestamp_ms
from ..operators.compare import CompareOptions, compare_reduced, reduced_of
from ..operators.duplicates import duplicate_groups, profiles_of
from ..operators.order import ORDER
from ..session import prepare
from ..sources.ledger import Batch, Ledger
from .report import GEO, merged_profiles, partial_profiles, report_of

#: Attributes of a profile's first row that are kept.
FIRSTS = ["time_qc", "position_qc", "profile_time", "profile_timestamp", "longitude", "latitude"]
FILES = "file string, size long, modified long"


class ProfileStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.log = prepare(spark), Ledger(spark, path)

    def _listed(self, files: Sequence[str]) -> DataFrame:
        """The files below some paths as the file system has them: file, size, modified. Their contents aren't read."""
        conf = self.spark._jsparkSession.sessionState().newHadoopConf()
        rows, left = [], [self.spark._jvm.org.apache.hadoop.fs.Path(f) for f in files]
        while left:
            at = left.pop()
            for x in at.getFileSystem(conf).listStatus(at):
                name = x.getPath().getName()
                if x.isDirectory():
                    left.append(x.getPath())
                elif not name.startswith(("_", ".")):
                    rows.append((re.sub("^file:/+", "file:/", x.getPath().toUri().toString()), x.getLen(), x.getModificationTime()))
        return self.spark.createDataFrame(rows, FILES)

    def _state(self, files: DataFrame) -> DataFrame:
        """The last batch of each file that is not gone: file, size, modified, seq."""
        last = files.groupBy("file").agg(F.max_by(F.struct("size", "modified", "seq"), "seq").alias("x"))
        return last.select("file", "x.*").where("size is not null")

    def update(self, files: Sequence[str]) -> tuple[int, int]:
        """Brings the store to the Parquet files below some paths, which are all of the product. Returns the number of files
        read and of files that are gone. Two updates at the same time follow one another."""
        now, done = self._listed(files), []

        def work(batch: Batch) -> None:
            known = self._state(batch.read("files", FILES))
            both = now.alias("n").join(known.alias("k"), "file", "full")
            new = [tuple(r) for r in both.where("n.size is not null and (k.size is null or n.size <> k.size or n.modified <> k.modified)").select("file", "n.size", "n.modified").collect()]
            gone = [(r["file"], None, None) for r in both.where("n.size is null").select("file").collect()]
            done[:] = [len(new), len(gone)]
            batch.write("files", self.spark.createDataFrame(new + gone, FILES).coalesce(1))
            if new:
                batch.write("partials", self._partials([f for f, _, _ in new]))

        state = self._state(self.log.read("files", FILES))
        if now.join(state, ["file", "size", "modified"], "left_anti").head(1) or state.join(now, "file", "left_anti").head(1):
            self.log.apply(uuid.uuid4().hex, work)
        return tuple(done) or (0, 0)

    def _partials(self, files: list[str]) -> DataFrame:
        rows = self.spark.read.parquet(*files)
        for c, kind in (("profile_time", "double"), ("profile_timestamp", "timestamp_ntz")):
            if c not in rows.columns:
                rows = rows.withColumn(c, F.lit(None).cast(kind))
        # types of the store, whatever a file has
        kinds = {"platform_code": "string", "profile_no": "long", "time_qc": "string", "position_qc": "string", "profile_time": "double", "profile_timestamp": "timestamp_ntz"}
        kinds |= {c: "double" for c in (*GEO, *MEASURES)}
        rows = rows.withColumn(ORDER, F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("r"))).withColumn("file", F.regexp_replace("_metadata.file_path", "^file:/+", "file:/"))
        return partial_profiles(rows.select("file", ORDER, *(F.col(c).cast(k).alias(c) for c, k in kinds.items())), FIRSTS, ("file",))

    def _kept(self) -> DataFrame:
        """The partial rows that count."""
        batches = self.log.commits()
        live = self._state(self.log.read("files", FILES, of=batches)).select("file", "seq")
        schema = self._partials_schema()
        return self.log.read("partials", schema, of=batches).join(live, ["file", "seq"], "left_semi")

    def _partials_schema(self) -> str:
        sums = ", ".join(f"na_{m} long, {m}_min double, {m}_max double, __{m}_sum double, __{m}_n long" for m in MEASURES)
        ends = ", ".join(f"{c}_{e} double" for c in GEO for e in ("min", "max"))
        first = "struct<time_qc: string, position_qc: string, profile_time: double, profile_timestamp: timestamp_ntz, longitude: double, latitude: double>"
        return f"file string, platform_code string, profile_no long, f {first}, o struct<f: string, r: long>, n_obs long, {ends}, {sums}"

    def profiles(self) -> DataFrame:
        """One row per profile of the product."""
        return merged_profiles(self._kept())

    def report(self, level: str = "platform") -> DataFrame:
        """The report of the product, as ``report`` makes it of the whole table."""
        return report_of(self.profiles(), level)

    def _first(self, time: Column) -> Column:
        return F.struct("o", time.alias("ms"), F.col("f.longitude").alias("lon"), F.col("f.latitude").alias("lat"))

    def duplicates(self, options: KeyOptions = KeyOptions()) -> DataFrame:
        """The profiles that share a key, in groups, as ``duplicate_groups`` finds them in the whole table."""
        first = F.struct("o", F.col("f.profile_time").alias("time"), timestamp_ms(F.col("f.profile_timestamp")).alias("ms"), F.col("f.longitude").alias("lon"), F.col("f.latitude").alias("lat"))
        return duplicate_groups(profiles_of(self._kept().select("platform_code", "profile_no", first.alias("f"), "n_obs"), options))

    def compared(self, other: ProfileStore, own_label: str, other_label: str, options: CompareOptions = CompareOptions(time_col="profile_timestamp")) -> DataFrame:
        """``compare`` of two products, from their stores alone. The time column is profile_time or profile_timestamp."""
        sides = []
        for store in (self, other):
            ms = {"profile_time": days_to_ms(F.col("f.profile_time")), "profile_timestamp": timestamp_ms(F.col("f.profile_timestamp"))}[options.time_col]
            pc, pn = F.coalesce("platform_code", F.lit("")).alias("pc"), F.coalesce("profile_no", F.lit(0)).alias("pn")
            sides.append(reduced_of(store._kept().select(pc, pn, self._first(ms).alias("f"), "n_obs"), options))
        return compare_reduced(*sides, own_label, other_label)
