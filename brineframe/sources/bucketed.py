"""Observations stored by profile, so that only the first step of a pipeline moves them.

The table is bucketed and sorted by what tells profiles apart (``__pc``, ``__pn``: platform and number, nulls as '' and 0).
Reductions to profiles and joins of profiles with their rows then take the buckets as they are. What still is shuffled are
profiles: a row each, where those of different platforms meet by key. Each step writes a table of the same buckets from
the tasks that read them.

The rows' first order goes with them (``__order``), so 'first' means the same as before.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import KeyOptions
from ..functions.missing import MEASURES, is_missing, require
from ..operators.cleaning import Box, drop_qc, filter_region
from ..operators.duplicates import NEEDED, duplicate_groups, duplicates_but_one, duplicates_report, first_row, identity, profiles_of
from ..operators.order import with_order
from ..plans.report import GEO, partial_profiles, report_of

#: Columns by which rows are dealt out.
BY = ("__pc", "__pn")
#: Rows of a bucket.
BUCKET_ROWS = 20_000_000


class ProfileBuckets:
    """The table ``name`` of the session's catalog."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name = spark, name

    @classmethod
    def create(cls, df: DataFrame, name: str, path: str, buckets: int | None = None) -> ProfileBuckets:
        """Stores rows by profile, in files below ``path``: the one step that shuffles them. By default a bucket for each BUCKET_ROWS rows,
        and one for each partition of a shuffle at least, so that Spark has no reason to deal them out anew."""
        require(df.columns, *NEEDED)
        spark = df.sparkSession
        buckets = buckets or max(int(spark.conf.get("spark.sql.shuffle.partitions")), df.count() // BUCKET_ROWS)
        pc, pn = identity()
        if "profile_time" not in df.columns:
            df = df.withColumn("profile_time", F.lit(float("nan")))
        rows = with_order(df).withColumns(dict(zip(BY, (pc, pn))))
        return cls(spark, name)._stored(rows.repartition(buckets, *BY), buckets, path)

    def _stored(self, rows: DataFrame, buckets: int, path: str) -> ProfileBuckets:
        rows.sortWithinPartitions(*BY).write.mode("overwrite").bucketBy(buckets, *BY).sortBy(*BY).option("path", path).saveAsTable(self.name)
        return self

    def _buckets(self) -> int:
        found = {r["col_name"]: r["data_type"] for r in self.spark.sql(f"describe extended {self.name}").collect()}
        return int(found["Num Buckets"])

    def rows(self) -> DataFrame:
        """All rows, with the columns that are ours."""
        return self.spark.table(self.name)

    def table(self) -> DataFrame:
        """All rows as they were given."""
        return self.rows().drop(*BY, "__order")

    def _next(self, rows: DataFrame, name: str, path: str) -> ProfileBuckets:
        """The rows of a step as a table of the same buckets; each task writes those that it read."""
        return ProfileBuckets(self.spark, name)._stored(rows, self._buckets(), path)

    def clean_rows(self, include: Box | None = None, exclude: Sequence[Box] = ()) -> DataFrame:
        good = drop_qc(self.rows())
        have = good.where("platform_code is not null and profile_no is not null").groupBy(*BY).agg(*(F.max((~is_missing(m)).cast("int")).alias(m) for m in MEASURES))
        keep = have.where(" + ".join(MEASURES) + f" = {len(MEASURES)}").select(*BY)
        # a null platform or number never stays, though it shares its identity with '' or 0
        out = good.where("platform_code is not null and profile_no is not null").join(keep, list(BY), "left_semi")
        return out if include is None else filter_region(out, include, exclude)

    def clean(self, name: str, path: str, include: Box | None = None, exclude: Sequence[Box] = ()) -> ProfileBuckets:
        """``operators.cleaning.clean`` of the table. Nothing is shuffled."""
        return self._next(self.clean_rows(include, exclude), name, path)

    def profiles(self, options: KeyOptions = KeyOptions()) -> DataFrame:
        """``operators.duplicates.profiles`` of the table. Nothing is shuffled."""
        rows = self.rows().select(*BY, first_row().alias("f"), F.lit(1).alias("n_obs"))
        return profiles_of(rows, options, tuple(map(F.col, BY)))

    def marked_rows(self, groups: DataFrame) -> DataFrame:
        marks = groups.select(F.col("pc").alias("__pc"), F.col("pn").alias("__pn"), F.lit(True).alias("__dup"))
        rows = self.rows().drop("is_dup").join(marks.hint("merge"), list(BY), "left")
        return rows.withColumn("is_dup", F.coalesce("__dup", F.lit(False))).drop("__dup")

    def mark(self, name: str, path: str, options: KeyOptions = KeyOptions()) -> tuple[ProfileBuckets, DataFrame]:
        """``mark_duplicates`` of the table, and the duplicates report. Profiles are shuffled, rows are not."""
        groups = duplicate_groups(self.profiles(options))
        return self._next(self.marked_rows(groups), name, path), duplicates_report(groups)

    def dedup_rows(self, options: KeyOptions = KeyOptions()) -> DataFrame:
        out = self.rows().join(duplicates_but_one(self.profiles(options)).hint("merge"), list(BY), "left_anti")
        return out.withColumn("is_dup", F.lit(False)) if "is_dup" in out.columns else out

    def dedup(self, name: str, path: str, options: KeyOptions = KeyOptions()) -> ProfileBuckets:
        """``drop_duplicate_profiles`` of the table. Profiles are shuffled, rows are not."""
        return self._next(self.dedup_rows(options), name, path)

    def profile_rows(self) -> DataFrame:
        """A row per profile for reports. Nothing is shuffled."""
        rows = self.rows()
        return partial_profiles(rows, ["time_qc", "position_qc", *(["is_dup"] if "is_dup" in rows.columns else []), "profile_timestamp", *GEO], BY).drop(*BY)

    def report(self, level: str = "platform") -> DataFrame:
        """The report of the table. Profiles are shuffled, rows are not."""
        return report_of(self.profile_rows(), level)

    def drop(self) -> None:
        """Takes the table out of the catalog; its files stay."""
        self.spark.sql(f"drop table if exists {self.name}")
