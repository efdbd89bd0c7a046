"""Profiles that share a date and a rounded position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.keys import KeyOptions, cast_key
from ..functions.missing import require
from ..functions.times import timestamp_ms
from ..session import stored
from .order import ORDER, with_order

NEEDED = ("platform_code", "profile_no", "profile_timestamp", "longitude", "latitude")


def profiles(df: DataFrame, options: KeyOptions = KeyOptions()) -> DataFrame:
    """One row per profile: pc, pn, key, profile_time, ms, longitude, latitude, n_obs, seen.

    The attributes are those of the profile's first row. A null platform counts as '' and a null
    number as 0. Everything after this works on profiles, not observations.
    """
    require(df.columns, *NEEDED)
    df = with_order(df)
    if "profile_time" not in df.columns:
        df = df.withColumn("profile_time", F.lit(float("nan")))
    return profiles_of(df.select("platform_code", "profile_no", first_row().alias("f"), F.lit(1).alias("n_obs")), options)


def identity(platform: str = "platform_code", profile: str = "profile_no") -> tuple[Column, Column]:
    """What tells profiles apart: a null platform counts as '' and a null number as 0."""
    return F.coalesce(platform, F.lit("")), F.coalesce(F.col(profile).cast("long"), F.lit(0))


def first_row() -> Column:
    """The attributes of a row that count if it is its profile's first: f of ``profiles_of``."""
    return F.struct(
        F.col(ORDER).alias("o"), F.col("profile_time").cast("double").alias("time"), timestamp_ms(F.col("profile_timestamp")).alias("ms"),
        F.col("longitude").cast("double").alias("lon"), F.col("latitude").cast("double").alias("lat"),
    )


def profiles_of(parts: DataFrame, options: KeyOptions = KeyOptions(), own: tuple[Column, Column] | None = None) -> DataFrame:
    """``profiles`` from rows or partial rows: platform_code, profile_no, n_obs, and the first row's f (o, time, ms, lon, lat).
    ``own``: their ``identity``, where the rows have it as columns."""
    pc, pn = own or identity()
    out = parts.groupBy(pc.alias("pc"), pn.alias("pn")).agg(F.min_by("f", "f.o").alias("f"), F.sum("n_obs").alias("n_obs"), F.min("f.o").alias("seen"))
    return out.select("pc", "pn", cast_key(F.col("f.ms"), F.col("f.lon"), F.col("f.lat"), options).alias("key"), F.col("f.time").alias("profile_time"), F.col("f.ms").alias("ms"), F.col("f.lon").alias("longitude"), F.col("f.lat").alias("latitude"), "n_obs", "seen")


def duplicate_groups(own: DataFrame) -> DataFrame:
    """From ``profiles``: the profiles whose key occurs more than once, with dup_group numbered from 1
    in the order of the keys. Keys are numbered within their time, times within the first ten
    characters of their text (the date, by default); only the counts of those are summed up in one place.
    Profiles are made once and written, as they are read for their keys and for their attributes."""
    own = stored(own, "keyed-profiles")
    keys = own.where("key is not null").groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    keys = stored(keys.select(F.col("key").alias("k"), F.row_number().over(Window.partitionBy("key.t").orderBy("key.x", "key.y")).cast("long").alias("nth")), "repeated-keys")
    def earlier(*within: str) -> Column:
        window = Window.partitionBy(*within[:-1]).orderBy(within[-1]).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("n").over(window), F.lit(0))

    times = keys.groupBy(F.substring("k.t", 1, 10).alias("d"), F.col("k.t").alias("t")).agg(F.count(F.lit(1)).alias("n"))
    days = times.groupBy(F.col("d").alias("day")).agg(F.sum("n").alias("n")).select("day", earlier("day").alias("in_days"))
    times = times.select("d", "t", earlier("d", "t").alias("in_day")).join(days, F.col("d") == F.col("day")).select("t", (F.col("in_days") + F.col("in_day")).alias("before"))
    keys = keys.join(times, F.col("k.t") == F.col("t")).select("k", (F.col("before") + F.col("nth")).alias("dup_group"))
    return own.join(keys, F.col("key") == F.col("k")).drop("k")


def duplicates_report(groups: DataFrame) -> DataFrame:
    """The rows of the duplicates table, in its order."""
    return duplicates_rows(groups).orderBy("dup_group", "platform_code", "profile_no")


def duplicates_rows(groups: DataFrame) -> DataFrame:
    """The rows of the duplicates table, in no order."""
    return groups.select("dup_group", F.col("pc").alias("platform_code"), F.col("pn").alias("profile_no"), "profile_time", F.timestamp_millis("ms").cast("timestamp_ntz").alias("profile_timestamp"), "longitude", "latitude", "n_obs")


def _attach(df: DataFrame, some: DataFrame, how: str) -> DataFrame:
    on = (F.coalesce(F.col("platform_code"), F.lit("")) == F.col("__pc")) & (F.coalesce(F.col("profile_no").cast("long"), F.lit(0)) == F.col("__pn"))
    return df.join(some, on, how)


def mark_duplicates(df: DataFrame, options: KeyOptions = KeyOptions()) -> tuple[DataFrame, DataFrame]:
    """``df`` with a boolean is_dup (replaced if it was there), and the duplicates report."""
    groups = duplicate_groups(profiles(df, options))
    return marked_by(df, groups), duplicates_report(groups)


def marked_by(df: DataFrame, groups: DataFrame) -> DataFrame:
    """``df`` with is_dup, from its ``duplicate_groups``."""
    marks = groups.select(F.col("pc").alias("__pc"), F.col("pn").alias("__pn"), F.lit(True).alias("__dup"))
    return _attach(df.drop("is_dup"), marks, "left").withColumn("is_dup", F.coalesce("__dup", F.lit(False))).drop("__pc", "__pn", "__dup")


def drop_duplicate_profiles(df: DataFrame, options: KeyOptions = KeyOptions()) -> DataFrame:
    """Of each key the profile with most observations, of equal ones the first seen. Profiles without a
    key stay. is_dup, if there, is false afterwards."""
    kept = _attach(df, duplicates_but_one(profiles(df, options)), "left_anti")
    return kept.withColumn("is_dup", F.lit(False)) if "is_dup" in df.columns else kept


def duplicates_but_one(own: DataFrame) -> DataFrame:
    """From ``profiles``: __pc and __pn of those that are not the one that stays of their key."""
    best = Window.partitionBy("key").orderBy(F.desc("n_obs"), "seen")
    return own.where("key is not null").withColumn("r", F.row_number().over(best)).where("r > 1").select(F.col("pc").alias("__pc"), F.col("pn").alias("__pn"))


def group_sizes(report: DataFrame, cap: int = 10) -> DataFrame:
    """group_size (``cap`` + 1 stands for all larger ones), n_groups, n_profiles."""
    each = report.groupBy("dup_group").agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy(F.least("n", F.lit(cap + 1)).cast("long").alias("group_size")).agg(F.count(F.lit(1)).alias("n_groups"), F.sum("n").alias("n_profiles"))


def within_across(report: DataFrame) -> DataFrame:
    """kind (within: one platform; across: several), n_groups, n_profiles, n_obs, n_platforms."""
    each = report.groupBy("dup_group").agg(F.count_distinct("platform_code").alias("p"), F.count(F.lit(1)).alias("n"), F.sum("n_obs").alias("obs"))
    kind = F.when(F.col("p") <= 1, "within").otherwise("across")
    sums = each.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n_groups"), F.sum("n").alias("n_profiles"), F.sum("obs").alias("n_obs"))
    platforms = report.join(each.select("dup_group", kind.alias("__kind")), "dup_group").groupBy("__kind").agg(F.count_distinct("platform_code").alias("n_platforms"))
    return sums.join(platforms, F.col("kind") == F.col("__kind")).drop("__kind")
