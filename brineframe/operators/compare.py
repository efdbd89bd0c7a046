"""How far two products hold the same profiles."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import KeyOptions, cast_key
from ..functions.times import days_to_ms, timestamp_ms
from .order import ORDER, with_order

COLUMNS = [
    "reference", "compared", "ref_platforms", "common_platforms", "platform_cov_pct", "ref_profiles", "ref_unkeyed_profiles",
    "matched_profiles", "profile_cov_pct", "same_nobs", "diff_nobs", "nobs_agree_pct", "ref_observations", "matched_observations",
]


@dataclass(frozen=True)
class CompareOptions:
    key: KeyOptions = field(default_factory=KeyOptions)
    platform_col: str = "platform_code"
    profile_col: str = "profile_no"
    time_col: str = "profile_time"
    lon_col: str = "longitude"
    lat_col: str = "latitude"
    use_platform: bool = True


def _reduced(df: DataFrame, o: CompareOptions) -> DataFrame:
    """A row per profile: pc, key, n_obs."""
    needed = (o.platform_col, o.profile_col, o.time_col, o.lon_col, o.lat_col)
    lacking = [c for c in needed if c not in df.columns]
    if lacking:
        raise ValueError(f"column(s) not found: {', '.join(lacking)}; available: {', '.join(df.columns)}")
    kind = df.schema[o.time_col].dataType.typeName()
    if kind in ("timestamp", "timestamp_ntz", "date"):
        ms = timestamp_ms(F.col(o.time_col).cast("timestamp"))
    elif kind in ("double", "float"):
        ms = days_to_ms(F.col(o.time_col))
    else:
        raise ValueError(f"time column {o.time_col!r} is a {kind}; it must be a timestamp or a number of days")
    df = with_order(df).select(
        F.coalesce(F.col(o.platform_col), F.lit("")).alias("pc"), F.coalesce(F.col(o.profile_col).cast("long"), F.lit(0)).alias("pn"),
        F.struct(F.col(ORDER).alias("o"), ms.alias("ms"), F.col(o.lon_col).cast("double").alias("lon"), F.col(o.lat_col).cast("double").alias("lat")).alias("row"),
    )
    return reduced_of(df.select("pc", "pn", F.col("row").alias("f"), F.lit(1).alias("n_obs")), o)


def reduced_of(parts: DataFrame, o: CompareOptions) -> DataFrame:
    """A row per profile: pc, key, n_obs, from rows or partial rows: pc, pn, n_obs, and the first row's f (o, ms, lon, lat)."""
    own = parts.groupBy("pc", "pn").agg(F.min_by("f", "f.o").alias("f"), F.sum("n_obs").alias("n_obs"))
    key = cast_key(F.col("f.ms"), F.col("f.lon"), F.col("f.lat"), o.key)
    if o.use_platform:
        key = F.when(key.isNotNull(), F.struct(F.col("pc").alias("p"), key.alias("k")))
    return own.select("pc", key.alias("key"), "n_obs")


def _pct(n: Column, d: Column) -> Column:
    """Two decimals, half away from zero; NaN of nothing."""
    part = F.when(d > 0, F.floor(n / F.when(d > 0, d) * 10_000.0 + 0.5) / 100.0)
    return F.coalesce(part, F.lit(float("nan")))


def _direction(reference: str, compared: str, own: DataFrame, other: DataFrame) -> DataFrame:
    index = other.where("key is not null").groupBy(F.col("key").alias("k")).agg(F.collect_set("n_obs").alias("counts"))
    met = own.join(index, F.col("key") == F.col("k"), "left")
    hit = F.col("k").isNotNull()
    totals = met.agg(
        F.count(F.lit(1)).alias("ref_profiles"), F.count_if(F.col("key").isNull()).alias("ref_unkeyed_profiles"),
        F.count_if(hit).alias("matched_profiles"), F.count_if(hit & F.array_contains("counts", F.col("n_obs"))).alias("same_nobs"),
        F.coalesce(F.sum("n_obs"), F.lit(0)).alias("ref_observations"), F.coalesce(F.sum(F.when(hit, F.col("n_obs"))), F.lit(0)).alias("matched_observations"),
    )
    here, there = own.select("pc").distinct(), other.select(F.col("pc").alias("q")).distinct()
    platforms = here.join(there, F.col("pc") == F.col("q"), "left").agg(F.count(F.lit(1)).alias("ref_platforms"), F.count("q").alias("common_platforms"))
    out = totals.crossJoin(platforms).withColumn("reference", F.lit(reference)).withColumn("compared", F.lit(compared))  # one row each
    out = out.withColumn("diff_nobs", F.col("matched_profiles") - F.col("same_nobs"))
    out = out.withColumn("platform_cov_pct", _pct(F.col("common_platforms"), F.col("ref_platforms"))).withColumn("profile_cov_pct", _pct(F.col("matched_profiles"), F.col("ref_profiles")))
    return out.withColumn("nobs_agree_pct", _pct(F.col("same_nobs"), F.col("matched_profiles"))).select(*COLUMNS)


def compare(a: DataFrame, b: DataFrame, label_a: str, label_b: str, options: CompareOptions = CompareOptions()) -> DataFrame:
    """Two rows: ``b`` as the reference, then ``a``. A profile matches if the other product holds its key;
    it agrees if one of the other's profiles with that key has as many observations."""
    return compare_reduced(_reduced(a, options), _reduced(b, options), label_a, label_b)


def compare_reduced(pa: DataFrame, pb: DataFrame, label_a: str, label_b: str) -> DataFrame:
    """``compare`` of two tables of profiles as ``reduced_of`` makes them."""
    return _direction(label_b, label_a, pb, pa).unionByName(_direction(label_a, label_b, pa, pb))
