"""Reports on an observation table at three levels, from one reduction to profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import KeyOptions
from ..functions.missing import MEASURES, is_missing, require, valid
from ..functions.times import timestamp_ms
from ..operators.duplicates import duplicate_groups, marked_by, profiles_of
from ..operators.order import ORDER, with_order
from ..session import stored

LEVELS = ("platform", "profile", "global")
GEO = ("longitude", "latitude")


def _sums(name: str) -> list[Column]:
    v = valid(name).cast("double")
    return [F.count_if(is_missing(name)).alias(f"na_{name}"), F.min(valid(name)).alias(f"{name}_min"), F.max(valid(name)).alias(f"{name}_max"), F.sum(v).alias(f"__{name}_sum"), F.count(v).alias(f"__{name}_n")]


def _again(name: str) -> list[Column]:
    return [F.sum(f"na_{name}").alias(f"na_{name}"), F.min(f"{name}_min").alias(f"{name}_min"), F.max(f"{name}_max").alias(f"{name}_max"), F.sum(f"__{name}_sum").alias(f"__{name}_sum"), F.sum(f"__{name}_n").alias(f"__{name}_n")]


def _mean(name: str) -> Column:
    return F.when(F.col(f"__{name}_n") > 0, F.col(f"__{name}_sum") / F.when(F.col(f"__{name}_n") > 0, F.col(f"__{name}_n"))).alias(f"{name}_mean")


def _measures() -> list[Column | str]:
    return [x for m in MEASURES for x in (f"na_{m}", f"{m}_min", f"{m}_max", _mean(m))]


def profile_table(df: DataFrame, positions: bool = True) -> DataFrame:
    """One row per profile: its size, first flags and attributes, extremes, and sums of its measures.
    Every level is a further aggregation of this."""
    dup = ["is_dup"] if "is_dup" in df.columns else []
    firsts = ["time_qc", "position_qc", *dup, *([c for c in ("profile_timestamp", *GEO) if c in df.columns] if positions else [])]
    return partial_profiles(df, firsts)


def partial_profiles(df: DataFrame, firsts: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """What the rows at hand say about each profile (and each value of ``by``): ``f``, the columns ``firsts`` of its first row, whose
    order is ``o``; counts, extremes and sums. Such rows are merged by ``merged_profiles``."""
    require(df.columns, "platform_code", "profile_no", "time_qc", "position_qc", *MEASURES, *GEO)
    rows = with_order(df)
    first = F.min_by(F.struct(*firsts), F.col(ORDER)).alias("f")
    ends = [x for c in GEO for x in (F.min(valid(c)).alias(f"{c}_min"), F.max(valid(c)).alias(f"{c}_max"))]
    return rows.groupBy(*by, "platform_code", "profile_no").agg(first, F.min(ORDER).alias("o"), F.count(F.lit(1)).alias("n_obs"), *ends, *(x for m in MEASURES for x in _sums(m)))


def merged_profiles(parts: DataFrame) -> DataFrame:
    """One row per profile from the partial rows of disjoint parts of a table: the same as ``partial_profiles`` of it all."""
    ends = [x for c in GEO for x in (F.min(f"{c}_min").alias(f"{c}_min"), F.max(f"{c}_max").alias(f"{c}_max"))]
    return parts.groupBy("platform_code", "profile_no").agg(F.min_by("f", "o").alias("f"), F.min("o").alias("o"), F.sum("n_obs").alias("n_obs"), *ends, *(x for m in MEASURES for x in _again(m)))


def _rolled(own: DataFrame, dup: bool) -> list[Column]:
    good = lambda c: F.count_if(F.col(f"f.{c}") == "1").alias(f"{c}_good")
    out = [F.count(F.lit(1)).alias("n_profiles"), F.sum("n_obs").alias("n_obs"), good("time_qc"), good("position_qc")]
    if dup:
        out.append(F.count_if(F.col("f.is_dup")).alias("dup_profiles"))
    out += [x for c in GEO for x in (F.min(f"{c}_min").alias(f"{c}_min"), F.max(f"{c}_max").alias(f"{c}_max"))]
    return out + [x for m in MEASURES for x in _again(m)]


def report(df: DataFrame, level: str = "platform") -> DataFrame:
    """Counts, good flags, missing values, extremes and means. ``level``: global (one row), platform or
    profile, each sorted by its key. Duplicated profiles are counted if the table has is_dup."""
    if level not in LEVELS:
        raise ValueError(f"level {level!r}; known are {', '.join(LEVELS)}")
    if level == "profile" and "profile_timestamp" not in df.columns:
        raise ValueError("missing columns profile_timestamp")
    return report_of(profile_table(df), level)


def report_of(own: DataFrame, level: str = "platform") -> DataFrame:
    """The report of a table of profiles."""
    out = report_rows(own, level)
    return {"platform": lambda: out.orderBy("platform_code"), "profile": lambda: out.orderBy("platform_code", "profile_no"), "global": lambda: out}[level]()


def report_rows(own: DataFrame, level: str = "platform") -> DataFrame:
    """The rows of ``report_of`` in no order, for what deals them out by an order of its own."""
    dup = "is_dup" in own.schema["f"].dataType.names
    counts = ["n_profiles", "n_obs", "time_qc_good", "position_qc_good", *(["dup_profiles"] if dup else [])]
    ends = [f"{c}_{e}" for c in GEO for e in ("min", "max")]
    if level == "profile":
        heads = [F.col("f.profile_timestamp").alias("profile_timestamp"), F.col("f.longitude").alias("longitude"), F.col("f.latitude").alias("latitude"), F.col("n_obs"), F.col("f.time_qc").alias("time_qc"), F.col("f.position_qc").alias("position_qc")]
        heads += [F.col("f.is_dup").alias("is_dup")] if dup else []
        return own.select("platform_code", "profile_no", *heads, *_measures())
    # platforms are rolled up either way: the global row is an aggregation of theirs
    per_platform = own.groupBy("platform_code").agg(*_rolled(own, dup))
    if level == "platform":
        return per_platform.select("platform_code", *counts, *ends, *_measures())
    whole = per_platform.agg(
        F.count("platform_code").alias("n_platforms"),
        *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counts),
        *(x for c in GEO for x in (F.min(f"{c}_min").alias(f"{c}_min"), F.max(f"{c}_max").alias(f"{c}_max"))),
        *(F.coalesce(x, F.lit(0)).alias(f"na_{m}") if k == 0 else x for m in MEASURES for k, x in enumerate(_again(m))),
    )
    return whole.select("n_platforms", *counts, *ends, *_measures())


def marked_report(df: DataFrame, level: str = "platform", options: KeyOptions = KeyOptions()) -> DataFrame:
    """``report`` of the table that ``mark_duplicates`` makes. A mark is a profile's, so rows are reduced to profiles once,
    and these are grouped, marked and rolled up."""
    if "profile_time" not in df.columns:
        df = df.withColumn("profile_time", F.lit(float("nan")))
    own = stored(partial_profiles(df, ["time_qc", "position_qc", "profile_time", "profile_timestamp", *GEO]), "profiles-to-mark")
    first = F.struct("o", F.col("f.profile_time").cast("double").alias("time"), timestamp_ms(F.col("f.profile_timestamp")).alias("ms"), F.col("f.longitude").cast("double").alias("lon"), F.col("f.latitude").cast("double").alias("lat"))
    groups = duplicate_groups(profiles_of(own.select("platform_code", "profile_no", first.alias("f"), "n_obs"), options))
    marked = marked_by(own, groups)
    return report_of(marked.withColumn("f", F.col("f").withField("is_dup", F.col("is_dup"))).drop("is_dup"), level)


def all_levels(df: DataFrame) -> DataFrame:
    """Platform rows and the global row in one plan, by grouping sets; ``level`` tells them apart."""
    dup = "is_dup" in df.columns
    own = profile_table(df).withColumn("platform", F.col("platform_code"))
    out = own.rollup("platform").agg(F.grouping("platform").alias("g"), F.count_distinct("platform_code").alias("n_platforms"), *_rolled(own, dup))
    return out.select(F.when(F.col("g") == 1, "global").otherwise("platform").alias("level"), F.col("platform").alias("platform_code"), "n_platforms", "n_profiles", "n_obs", "time_qc_good", "position_qc_good", *(["dup_profiles"] if dup else []), *_measures())
