"""Registered queries on the benchmark tables, each with SQL that must give the same rows."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import grids, qc, times
from .functions.keys import ROUND_MODES, KeyOptions, scaled, time_key
from .operators import cleaning, duplicates, merging
from .operators.cleaning import Box
from .operators.compare import CompareOptions, compare

from .plans import report as reports
from .plans.distinct import Dictionary, bitmaps, counted
from .plans.profile_store import ProfileStore
from .plans.driver_view import DUCKDB, observations
from .plans.regions import Region
from .plans.lines import duplicates_line, json_record, numbered_lines, tsv_line
from .session import prepare, stored, work_path
from .sources import netcdf
from .sources.bucketed import ProfileBuckets
from .sources.cdf import classic_bytes
from .sources.ordered import ROW
from .sources.outputs import opened
from .sources.presets import PRESETS
from .sources.spatial import SpatialTable

COLUMNS = ["platform_code", "profile_no", "profile_timestamp", "longitude", "latitude", "time_qc", "position_qc", "temp", "psal", "pres"]
LIST = ", ".join(COLUMNS)
WITH = f"with obs as ({DUCKDB})"
BOX = Box(-1.0, 1.0, 51.0, 52.0)
IN_BOX = "not isnan(longitude) and not isnan(latitude) and longitude >= -1 and longitude <= 1 and latitude >= 51 and latitude <= 52"
REGION = Region(Box(-3.0, 3.0, 50.0, 52.5), (Box(-1.0, 1.0, 51.0, 52.0), Box(2.0, 3.0, 50.0, 50.5)))
IN_REGION = f"""not isnan(longitude) and not isnan(latitude) and longitude between -3 and 3 and latitude between 50 and 52.5
 and not ({IN_BOX}) and not (longitude between 2 and 3 and latitude between 50 and 50.5)"""
QC_OK = "time_qc in ('1', '') and position_qc in ('1', '')"
HAS = "platform_code, profile_no from {t} group by platform_code, profile_no having " + " and ".join(f"max(case when {m} is null or isnan({m}) then 0 else 1 end) = 1" for m in ("temp", "psal", "pres"))
#: Profiles with their key, from which the duplicate queries start. {k} rounds a coordinate.
PROFILES = """, prof as (select platform_code as pc, profile_no as pn, count(*) as n_obs, min(__order) as seen, min(profile_timestamp) as ts, min(profile_time) as days,
 min(longitude) as longitude, min(latitude) as latitude from obs group by platform_code, profile_no),
keyed as (select *, strftime(ts, '%Y-%m-%d') as t, cast(round(longitude * 1000.0) as bigint) as x, cast(round(case when isnan(latitude) then null else latitude end * 1000.0) as bigint) as y from prof),
dup as (select t, x, y, row_number() over (order by t, x, y) as dup_group from keyed where y is not null group by t, x, y having count(*) > 1),
grp as (select k.*, d.dup_group from keyed k join dup d on k.t = d.t and k.x = d.x and k.y = d.y)"""
DUPS = WITH + PROFILES


def _obs(f: Callable[[DataFrame], DataFrame], columns: list[str] | None = COLUMNS) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = f(observations(spark, sf_dir))
        return out.select(*columns) if columns else out

    return run


def _rounded(df: DataFrame) -> DataFrame:
    """Means to six decimals, so that the order of a sum doesn't show; what adds up to a tie goes up."""
    return df.select(*(F.round(F.col(c) + 1e-9, 6).alias(c) if c.endswith("_mean") else F.col(c) for c in df.columns))


def _measures(own: str = "{c}") -> str:
    """SQL aggregates of the measures of table rows."""
    out = []
    for m in ("temp", "psal", "pres"):
        v = f"case when not isnan({m}) then {m} end"
        out.append(f"count(*) filter ({m} is null or isnan({m})) as na_{m}, min({v}) as {m}_min, max({v}) as {m}_max, round(avg({v}) + 1e-9, 6) as {m}_mean")
    return ", ".join(out)


def _cell(column: str) -> str:
    """SQL text of a cell of a report: four decimals without trailing zeros, nothing where there is no number."""
    if not column.endswith(("_min", "_max")):
        return f"cast({column} as varchar)"
    return f"coalesce(rtrim(rtrim(printf('%.4f', cast({column} as double)), '0'), '.'), '')"



def _profile_cell(column: str) -> str:
    """SQL text of a cell of the report by profile."""
    if column == "profile_timestamp":
        return "strftime(profile_timestamp, '%Y-%m-%dT%H:%M:%SZ')"
    if column in ("longitude", "latitude") or column.endswith(("_min", "_max")):
        return f"case when {column} is null or isnan({column}) then '' else rtrim(rtrim(printf('%.4f', cast({column} as double)), '0'), '.') end"
    return f"coalesce(cast({column} as varchar), '')"


def _json_cell(column: str) -> str:
    own = _profile_cell(column)
    if column in ("platform_code", "time_qc", "profile_timestamp"):
        return f"""'"{column}":"' || {own} || '"'"""
    return f"""'"{column}":' || coalesce(nullif({own}, ''), 'null')"""


def _shortest(column: str) -> str:
    return f"case when isnan({column}) then 'NaN' else regexp_replace(cast({column} as varchar), '\\.0$', '') end"


GEO = ", ".join(f"min(case when not isnan({c}) then {c} end) as {c}_min, max(case when not isnan({c}) then {c} end) as {c}_max" for c in ("longitude", "latitude"))


def _later(obs: DataFrame, which: Column, days: int) -> DataFrame:
    """All rows of a table, some of them so many days later."""
    shift = lambda c, by: F.when(which, F.col(c) + by).otherwise(F.col(c)).alias(c)
    moved = {"profile_timestamp": F.make_interval(days=F.lit(days)), "profile_time": F.lit(days)}
    return obs.select(*(shift(c, moved[c]) if c in moved else F.col(c) for c in obs.columns))


def _compare(use_platform: bool, time_col: str, key: KeyOptions = KeyOptions()):
    """Two products of all rows: in one a third of the casts is a day early; in the other half of them are a day late, and
    levels without pressure of one cast in five are there twice."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        obs = observations(spark, sf_dir)
        no = F.col("profile_no")
        one = _later(obs, no % 3 == 0, -1)
        other = _later(obs.unionByName(obs.where("profile_no % 5 = 0 and pres is null")), no % 2 == 1, 1)
        return compare(one, other, "a", "b", CompareOptions(key=key, use_platform=use_platform, time_col=time_col))

    return run


def _later_sql(rows: str, which: str, days: int) -> str:
    return f"""(select * replace (case when {which} then profile_timestamp + interval ({days}) day else profile_timestamp end as profile_timestamp,
 case when {which} then profile_time + {days} else profile_time end as profile_time) from {rows})"""


def _compare_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A product against all of itself with some platforms renamed, some casts a day later and some levels gone."""
    obs = observations(spark, sf_dir)
    return compare(obs, _other_product(obs), "a", "b", CompareOptions(time_col="profile_timestamp"))


def _other_product(obs: DataFrame) -> DataFrame:
    no = F.col("profile_no")
    return obs.where("profile_no % 5 <> 0 or pres is not null").withColumns({
        "platform_code": F.when(no % 7 == 0, F.concat(F.lit("X"), "platform_code")).otherwise(F.col("platform_code")),
        "profile_timestamp": F.when(no % 4 == 0, F.col("profile_timestamp") + F.expr("interval 1 day")).otherwise(F.col("profile_timestamp")),
    })


WHOLE = """(select * replace (case when profile_no % 7 = 0 then concat('X', platform_code) else platform_code end as platform_code,
 case when profile_no % 4 = 0 then profile_timestamp + interval 1 day else profile_timestamp end as profile_timestamp) from obs where profile_no % 5 <> 0 or pres is not null)"""


def _compare_sql(use_platform: bool, time: str, a: str = _later_sql("obs", "profile_no % 3 = 0", -1), b: str = _later_sql("(from obs union all from obs where profile_no % 5 = 0 and pres is null)", "profile_no % 2 = 1", 1)) -> str:
    key = "t, x, y" + (", pc" if use_platform else "")
    on = " and ".join(f"r.{c.strip()} = o.{c.strip()}" for c in key.split(","))

    def side(name: str, rows: str) -> str:
        return f"""{name} as (select platform_code as pc, count(*) as n, {time} as t, cast(round(min(longitude) * 1000.0) as bigint) as x,
 cast(round(min(case when isnan(latitude) then null else latitude end) * 1000.0) as bigint) as y from {rows} group by platform_code, profile_no)"""

    def way(r: str, o: str) -> str:
        usable = "t is not null and x is not null and y is not null"
        return f"""select '{r}' as reference, '{o}' as compared, p.rp as ref_platforms, p.cp as common_platforms, pc(p.cp, p.rp) as platform_cov_pct, s.np as ref_profiles, s.un as ref_unkeyed_profiles,
 s.m as matched_profiles, pc(s.m, s.np) as profile_cov_pct, s.same as same_nobs, s.m - s.same as diff_nobs, pc(s.same, s.m) as nobs_agree_pct, s.obs as ref_observations, s.mobs as matched_observations
from (select count(*) as np, count(*) filter (not ({usable})) as un, count(*) filter (hit) as m, count(*) filter (hit and same) as same, cast(sum(n) as bigint) as obs, cast(coalesce(sum(n) filter (hit), 0) as bigint) as mobs
 from (select r.*, exists (select 1 from {o} o where {on}) as hit, exists (select 1 from {o} o where {on} and r.n = o.n) as same from {r} r)) s,
(select count(distinct pc) as rp, count(distinct pc) filter (pc in (select pc from {o})) as cp from {r}) p"""

    text = WITH + ", " + side("a", a) + ", " + side("b", b) + "\n" + way("b", "a") + "\nunion all\n" + way("a", "b")
    return re.sub(r"pc\(([\w.]+), ([\w.]+)\)", r"case when \2 = 0 then cast('NaN' as double) else floor(\1 / \2 * 10000.0 + 0.5) / 100.0 end", text)


def _spatial(spark: SparkSession, sf_dir: str) -> SpatialTable:
    """All observations laid out by position, in two batches."""
    table = SpatialTable(spark, work_path(spark, "by-position"))
    obs = stored(observations(spark, sf_dir).select(*COLUMNS), "observations")
    for k in (0, 1):
        table.append(obs.where(f"profile_no % 2 = {k}"))
    return table


def _kept(spark: SparkSession, rows: DataFrame) -> ProfileStore:
    """A store of the profiles of a product that came in two deliveries, profiles split between them."""
    product, store = work_path(spark, "product"), ProfileStore(spark, work_path(spark, "profiles"))
    late = F.pmod(F.xxhash64("psal", "pres", "temp"), F.lit(3)) == 0
    # both deliveries are written by one job; the store is told of the second after the first
    rows.withColumn("delivery", F.when(late, "second").otherwise("first")).write.partitionBy("delivery").parquet(product)
    first, second = (f"{product}/delivery={name}" for name in ("first", "second"))
    store.update([first])
    store.update([first, second])
    return store


def _report_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_kept(spark, observations(spark, sf_dir).drop("__order")).report("platform"))


def _dups_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.duplicates_report(_kept(spark, observations(spark, sf_dir).drop("__order")).duplicates())


def _compare_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = observations(spark, sf_dir).drop("__order")
    return _kept(spark, obs).compared(_kept(spark, _other_product(obs)), "a", "b")


def _bucketed(spark: SparkSession, sf_dir: str) -> ProfileBuckets:
    """All observations stored by profile, then cleaned without a shuffle."""
    table = lambda step: (f"brineframe_{step}_{uuid.uuid4().hex}", work_path(spark, step))
    return ProfileBuckets.create(observations(spark, sf_dir), *table("stored")).clean(*table("cleaned"))


def _bucketed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = _bucketed(spark, sf_dir)
    marked, _ = cleaned.mark(f"brineframe_marked_{uuid.uuid4().hex}", work_path(spark, "marked"))
    left = marked.dedup(f"brineframe_left_{uuid.uuid4().hex}", work_path(spark, "left"))
    return left.table().select(*COLUMNS)


def _bucketed_marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked, _ = _bucketed(spark, sf_dir).mark(f"brineframe_marked_{uuid.uuid4().hex}", work_path(spark, "marked"))
    return marked.table().select("platform_code", "profile_no", "temp", "is_dup")


def _ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A merge read back with row numbers from its manifest."""
    obs = observations(spark, sf_dir)
    table = merging.merge_ordered([obs.where(f"profile_no % 2 = {k}") for k in (0, 1)], work_path(spark, "merged"))
    return table.numbered().select("platform_code", "profile_no", "observation_no", "pres", F.col(ROW).alias("row"))


def _distinct_platforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Different platforms of all observations, of each month, and of duplicate profiles by kind, all from bitmaps: those of two parts of
    the table, merged, and those of duplicate groups. A kind's are the OR of its groups'."""
    obs, words = observations(spark, sf_dir), Dictionary(spark, work_path(spark, "platforms"))
    month = obs.select("platform_code", F.date_format("profile_timestamp", "yyyy-MM").alias("month"), "profile_no")
    sets = None
    for k in (0, 1):
        part = month.where(f"profile_no % 2 = {k}")
        words.add(part, "platform_code")
        own = stored(bitmaps(part, ["month"], "platform_code", words.words()), "platform-sets")
        sets = own if sets is None else sets.unionByName(own)
    groups = stored(bitmaps(_dups(spark, sf_dir), ["dup_group"], "platform_code", words.words()), "group-sets")
    kind = counted(groups, ["dup_group"]).select("dup_group", F.when(F.col("n") <= 1, "within").otherwise("across").alias("kind"))
    kinds = counted(groups.join(kind, "dup_group"), ["kind"], "n_platforms").select(F.lit("duplicates").alias("what"), F.col("kind").alias("value"), "n_platforms")
    months = counted(sets, ["month"], "n_platforms").select(F.lit("month").alias("what"), F.col("month").alias("value"), "n_platforms")
    whole = counted(sets, (), "n_platforms").select(F.lit("all").alias("what"), F.lit("").alias("value"), "n_platforms")
    return whole.unionByName(months).unionByName(kinds)


def _round_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select((F.col("l_extendedprice") / 7 - 3000).alias("v")).distinct()
    return part.select("v", *(scaled(F.col("v"), KeyOptions(decimals=3, round_mode=m)).alias(f"k_{m}") for m in ROUND_MODES))


def _times(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = observations(spark, sf_dir).select("profile_time").distinct()
    return obs.select("profile_time", times.days_to_timestamp(F.col("profile_time")).alias("stamp"), F.coalesce(times.days_to_ms(F.col("profile_time")), F.lit(0)).alias("ms"), times.days_to_ms(F.col("profile_time")).isNull().alias("unknown"))


def _time_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(times.timestamp_ms(F.col("o_orderdate")).alias("ms"), "o_orderkey")
    key = lambda f: time_key(F.col("ms"), KeyOptions(time_format=f))
    return orders.select("o_orderkey", key("%Y-%m-%d").alias("day"), key("%Y%m%dT%H:%M:%S").alias("second"), key("year %Y, day %j").alias("words"))


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels with pressure or depth missing in turn."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    nan = F.lit(float("nan"))
    return lines.select(
        "l_orderkey", "l_linenumber", ((F.col("l_partkey") % 90).cast("double")).alias("lat"),
        F.when(F.col("l_orderkey") % 3 == 0, nan).otherwise(F.col("l_extendedprice") / 25).cast("float").alias("pres"), F.lit("1").alias("pres_qc"),
        F.when(F.col("l_orderkey") % 3 == 1, nan).otherwise(F.col("l_extendedprice") / 26).cast("float").alias("deph"), F.lit("2").alias("deph_qc"),
    )


GRID_SQL = """with g as (select l_orderkey, l_linenumber, cast(l_partkey % 90 as double) as lat,
 cast(case when l_orderkey % 3 = 0 then cast('NaN' as double) else l_extendedprice / 25 end as float) as pres,
 cast(case when l_orderkey % 3 = 1 then cast('NaN' as double) else l_extendedprice / 26 end as float) as deph from lineitem),
s as (select *, power(sin(radians(lat)), 2) as s2 from g), q as (select *, 9.780327 * (1 + (5.2792e-3 + 2.32e-5 * s2) * s2) as gr from s)"""


#: Coefficients of the published polynomials of specific volume and dynamic height, as SQL has them.
SQL_HEIGHT = (9.726613854843870e-4, -2.252956605630465e-5, 2.376909655387404e-6, -1.664294869986011e-7, -5.988108894465758e-9, -2.1078768810e-9, 2.8019291329e-10)
SQL_VOLUME = (9.726613854843870e-4, -4.505913211160929e-5, 7.130728965927127e-6, -6.657179479768312e-7, -2.994054447232880e-8, -1.2647261286e-8, 1.9613503930e-9)


def _horner(x: str, coefficients: tuple[float, ...]) -> str:
    out = repr(coefficients[-1])
    for c in coefficients[-2::-1]:
        out = f"({c!r}::double + {x} * {out})"
    return out


def _h(p: str) -> str:
    return f"(1e8 * ({p} * 1e-4) * {_horner(f'({p} * 1e-4)', SQL_HEIGHT)})"


def _v(p: str) -> str:
    return _horner(f"({p} * 1e-4)", SQL_VOLUME)


def _to_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _grid(spark, sf_dir)
    value, flag, mark = grids.depth_from_pressure(F.col("deph"), F.col("deph_qc"), F.col("pres"), F.col("pres_qc"), F.col("lat"))
    return g.select("l_orderkey", "l_linenumber", F.round(value.cast("double"), 1).alias("deph"), flag.alias("deph_qc"), mark.cast("int").alias("deph_conv"))


def _to_pressure(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _grid(spark, sf_dir)
    g = grids.with_made_pressure(g, F.col("deph"), F.col("lat"), "made")
    value, flag, mark = grids.pressure_from_depth(F.col("pres"), F.col("pres_qc"), F.col("deph"), F.col("deph_qc"), F.col("made"))
    return g.select("l_orderkey", "l_linenumber", F.round(value.cast("double"), 1).alias("pres"), flag.alias("pres_qc"), mark.cast("int").alias("pres_conv"))


def _deployed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as time steps, suppliers as deployments."""
    steps = spark.read.parquet(f"{sf_dir}/customer.parquet").select((F.col("c_custkey") % 400).alias("t")).distinct()
    runs = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(((F.col("s_suppkey") * 37) % 300 - 5).alias("start"), F.col("s_acctbal").alias("value"), F.col("s_suppkey").alias("position"))
    return grids.deployed(steps, runs)


def _deployed_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer as a time step, every supplier as a deployment, nations as files."""
    steps = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", F.col("c_nationkey").alias("nation"), (F.col("c_custkey") % 400).alias("t"))
    runs = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_nationkey").alias("nation"), ((F.col("s_suppkey") * 37) % 300 - 5).alias("start"), F.col("s_acctbal").alias("value"), F.col("s_suppkey").alias("position"))
    return grids.deployed(steps, runs, file="nation")


def _nation_file(folder: str):
    """Writes the suppliers of a nation as casts of four levels to a NetCDF file, with missing values and odd flags."""

    def write(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("s_suppkey")
        s, k, fill = rows["s_suppkey"].to_numpy()[:, None], np.arange(4)[None], np.float32(9.96921e36)
        grid, line, own = ("TIME", "DEPTH"), ("TIME",), {"_FillValue": fill}
        real = lambda values, missing: np.where(missing, fill, values + 0 * (s + k)).astype(np.float32)
        variables = {
            "TIME": (line, 20000.0 + s[:, 0] / 8, {}), "LONGITUDE": (line, (s[:, 0] % 360 - 180).astype(np.float32), {}), "LATITUDE": (line, (s[:, 0] % 80).astype(np.float32), {}),
            "TIME_QC": (line, (s[:, 0] % 12).astype(np.int8), {}), "POSITION_QC": (line, (s[:, 0] % 3).astype(np.int8), {}),
            "TEMP": (grid, real(s % 100 + k * 0.5, (s + k) % 3 == 0), own), "PSAL": (grid, real(30.0 + k, (s + k) % 4 == 0), own), "PRES": (grid, real(10.0 * k + 1, (s + 2 * k) % 5 == 0), own),
            "TEMP_QC": (grid, ((s + k) % 14 - 2).astype(np.int8), {}), "PRES_QC": (grid, (k + 0 * s).astype(np.int8), {}),
        }
        nation = int(rows["s_nationkey"].iloc[0])
        return _put(folder, f"AR_PR_CT_{nation}.nc", {"TIME": len(s), "DEPTH": 4}, variables, {"platform_code": f"N{nation}"})

    return write


def _put(folder: str, name: str, *parts) -> pd.DataFrame:
    own, where = opened(folder)
    own.create_dir(where, recursive=True)
    with own.open_output_stream(f"{where}/{name}") as out:
        out.write(classic_bytes(*parts))
    return pd.DataFrame({"path": [f"{folder}/{name}"]})


def _coordinate_file(folder: str):
    """Writes the suppliers of a nation as casts of two levels whose platform has positions of its own: those of each cast for even
    nations, of two deployments for the others. Either position is missing now and then."""

    def write(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("s_suppkey")
        s, nation = rows["s_suppkey"].to_numpy(), int(rows["s_nationkey"].iloc[0])
        line, grid, nan = ("TIME",), ("TIME", "DEPTH"), np.float32("nan")
        real = lambda values, missing: np.where(missing, nan, values).astype(np.float32)
        variables = {
            "TIME": (line, 20000.0 + s, {}), "LONGITUDE": (line, real(s % 90, s % 4 == 0), {}), "LATITUDE": (line, real(s % 60, s % 5 == 0), {}),
            "TEMP": (grid, np.stack([s % 50, s % 50 + 1], 1).astype(np.float32), {}),
        }
        sizes = {"TIME": len(s), "DEPTH": 2}
        if nation % 2 == 0:
            variables |= {"PRECISE_LONGITUDE": (line, real(s % 90 + 0.5, s % 3 == 0), {}), "PRECISE_LATITUDE": (line, real(s % 60 + 0.25, s % 7 == 0), {})}
        else:
            sizes["DEPLOYMENT"] = 2
            two = ("DEPLOYMENT",)
            variables |= {"DEPLOYMENT": (two, np.array([0, 3], np.int32), {}), "DEPLOY_LONGITUDE": (two, np.array([nation, nation + 0.5], np.float32), {}), "DEPLOY_LATITUDE": (two, np.array([nation / 2, nation / 2 + 1], np.float32), {})}
        return _put(folder, f"BO_PR_CT_{nation}.nc", sizes, variables, {"platform_code": f"N{nation}"})

    return write


def _cora_nation(folder: str):
    """Writes the suppliers of a nation as a reanalysis file: a platform per cast, three levels, depth where there is pressure."""

    def write(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("s_suppkey")
        s, k, fill = rows["s_suppkey"].to_numpy()[:, None], np.arange(3)[None], np.float32(99999.0)
        one, grid, own = ("N_PROF",), ("N_PROF", "N_LEVELS"), {"_FillValue": fill}
        real = lambda values, missing: np.where(missing, fill, values + 0 * (s + k)).astype(np.float32)
        names = np.array([list(f" S{v}".ljust(8, "\0")) for v in s[:, 0] % 40], "S1")
        deep = (s + k) % 4 == 1
        variables = {
            "PLATFORM_NUMBER": (("N_PROF", "STRING8"), names, {}), "TIME": (one, 10000.0 + s[:, 0] / 4, {}), "LONGITUDE": (one, s[:, 0] % 180 * 1.0, {}), "LATITUDE": (one, s[:, 0] % 70 * 1.0, {}),
            "TIME_QC": (one, (s[:, 0] % 11).astype(np.int8), {}), "POSITION_QC": (one, (s[:, 0] % 4).astype(np.int8), {}),
            "TEMP": (grid, real(s % 30 + k, (s + k) % 3 == 0), own), "TEMP_QC": (grid, ((s + 2 * k) % 13 - 1).astype(np.int8), {}), "PSAL": (grid, real(34.5 + k, (s * k) % 5 == 1), own),
            "PRES": (grid, real(5.0 + 10 * k, deep), own), "DEPH": (grid, real(4.5 + 10 * k, deep), own), "DEPH_QC": (grid, (k + 1 + 0 * s).astype(np.int8), {}),
        }
        return _put(folder, f"CO_{int(rows['s_nationkey'].iloc[0])}.nc", {"N_PROF": len(s), "N_LEVELS": 3, "STRING8": 8}, variables)

    return write


def _nation_files(spark: SparkSession, sf_dir: str, writer=None) -> list[str]:
    """NetCDF files of all suppliers, a file for each nation, written by the workers into the shared folder."""
    folder = re.sub("^file:/+", "/", work_path(prepare(spark), "netcdf"))
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", "s_nationkey")
    return sorted(r["path"] for r in rows.groupBy("s_nationkey").applyInPandas((writer or _nation_file)(folder), "path string").collect())


def _coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions of casts and of their platforms, each filled from the other."""
    rows = netcdf.convert(spark, _nation_files(spark, sf_dir, _coordinate_file), PRESETS["nrt_bo"])
    return rows.select("filename", "profile_no", "observation_no", "longitude", "latitude", "profile_longitude", "profile_latitude", "temp")


def _cora(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = netcdf.convert(spark, _nation_files(spark, sf_dir, _cora_nation), PRESETS["cora"])
    return rows.select("filename", "platform_code", "profile_no", "profile_time", "observation_no", "longitude", "latitude", "time_qc", "position_qc", "temp", "temp_qc", "psal", "pres", "pres_conv", "deph", "deph_qc", "deph_conv")


def _netcdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of all nations converted again. The shared folder must be a path of the file system: NetCDF is read by path."""
    return netcdf.convert(spark, _nation_files(spark, sf_dir), PRESETS["nrt_ar"]).select(*NETCDF)


def _batch_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of all nations, each converted to a file of its own in one job, read back with the name of the file and the
    place of the row in it."""
    folder = re.sub("^file:/+", "/", work_path(spark, "converted"))
    results = {f: f"{folder}/{f.rsplit('/', 1)[1][:-3]}.parquet" for f in _nation_files(spark, sf_dir)}
    if failed := netcdf.convert_each(spark, results, PRESETS["nrt_ar"]):
        raise RuntimeError("\n".join(failed))
    rows = spark.read.parquet(*results.values())
    return rows.select(*NETCDF, F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("place"))


NETCDF = ["platform_code", "profile_no", "profile_time", "profile_timestamp", "observation_no", "longitude", "latitude", "time_qc", "position_qc", "filename", "temp", "temp_qc", "psal", "psal_qc", "pres", "pres_qc", "pres_conv", "deph_conv"]


def _flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    raw = (F.col("p_partkey") % 14 - 2).cast("int")
    char = F.element_at(F.array(F.lit("1"), F.lit(" "), F.lit("A"), F.lit(None).cast("string")), (F.col("p_partkey") % 4 + 1).cast("int"))
    return p.select("p_partkey", qc.flag_from_int(raw).alias("i"), qc.flag_from_char(char).alias("c"), qc.packed_text(F.concat(F.lit(" P "), F.col("p_partkey").cast("string"), F.lit("  "))).alias("t"),
                    qc.float_or_nan(F.when(F.col("p_partkey") % 5 > 0, F.col("p_partkey") % 9), 3.0).cast("double").alias("f"))


def _filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = observations(spark, sf_dir).select("platform_code", "profile_no", "latitude", F.when(F.col("profile_no") % 5 > 0, F.col("longitude") + 50).otherwise(float("nan")).alias("other")).distinct()
    return obs.select("platform_code", "profile_no", grids.filled_from(F.col("latitude"), F.col("other")).alias("first"), grids.filled_from(F.col("other"), F.col("latitude")).alias("second"))


def _merged(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    obs = observations(spark, sf_dir)
    a, b = (obs.where(f"profile_no % 2 = {k}") for k in (0, 1))
    return merging.merge([a, b], **options)


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.mark_duplicates(observations(spark, sf_dir))[0].select("platform_code", "profile_no", "temp", "is_dup")


def _dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.mark_duplicates(observations(spark, sf_dir))[1]


def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(reports.all_levels(observations(spark, sf_dir)))


def _report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of a rendered report, with their numbers; cells and lines are made by column expressions."""
    df = reports.report_rows(reports.profile_table(observations(spark, sf_dir))).select(*CELLS)
    return numbered_lines(df, tsv_line(df), ["platform_code"], "\t".join(CELLS))


def _profile_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = reports.report_rows(reports.profile_table(observations(spark, sf_dir)), "profile").select(*PROFILE_CELLS)
    return numbered_lines(df, tsv_line(df), ["platform_code", "profile_no"], "\t".join(PROFILE_CELLS))


def _profile_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = reports.report_rows(reports.profile_table(observations(spark, sf_dir)), "profile").select(*PROFILE_CELLS, (F.col("n_obs") > 3).alias("long"), F.concat(F.lit('"\\\t'), "platform_code").alias("odd"))
    return numbered_lines(df, json_record(df), ["platform_code", "profile_no"])


def _dups_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = duplicates.duplicate_groups(duplicates.profiles(observations(spark, sf_dir)))
    return numbered_lines(duplicates.duplicates_rows(groups), duplicates_line(), ["dup_group", "platform_code", "profile_no"])


PROFILE_CELLS = ["platform_code", "profile_no", "profile_timestamp", "longitude", "latitude", "n_obs", "time_qc", "na_temp", "temp_min", "temp_max", "psal_min", "psal_max", "pres_min", "pres_max"]
CELLS = ["platform_code", "n_profiles", "n_obs", "time_qc_good", "position_qc_good", "longitude_min", "longitude_max", "latitude_min", "latitude_max", "na_temp", "temp_min", "temp_max", "na_psal", "psal_min", "psal_max", "na_pres", "pres_min", "pres_max"]


def _marked_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.marked_report(observations(spark, sf_dir)).select("platform_code", "n_profiles", "dup_profiles")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "filter_include": _obs(lambda d: cleaning.filter_box(d, BOX)),
    "filter_exclude": _obs(lambda d: cleaning.filter_box(d, BOX, "exclude")),
    "filter_multibox": _obs(lambda d: cleaning.filter_region(d, REGION.include, REGION.exclude)),
    "filter_by_zones": lambda s, d: _spatial(s, d).box(BOX).select(*COLUMNS),
    "region_by_zones": lambda s, d: _spatial(s, d).region(REGION.include, REGION.exclude).select(*COLUMNS),
    "dropqc": _obs(cleaning.drop_qc),
    "dropna": _obs(cleaning.drop_na),
    "drop_na_pres": _obs(cleaning.drop_na_pres),
    "clean_pipeline": _obs(lambda d: cleaning.clean(d, REGION.include, REGION.exclude)),
    "markdup_flags": _marked,
    "dups_report": _dups,
    "dedup": _obs(duplicates.drop_duplicate_profiles),
    "dup_group_sizes": lambda s, d: duplicates.group_sizes(_dups(s, d), cap=4),
    "dup_within_across": lambda s, d: duplicates.within_across(_dups(s, d)),
    "compare_ab": _compare(True, "profile_timestamp"),
    "compare_noplatform": _compare(False, "profile_timestamp"),
    "compare_days": _compare(True, "profile_time"),
    "compare_whole": _compare_whole,
    "compare_kept": _compare_kept,
    "dups_kept": _dups_kept,
    "report_kept": _report_kept,
    "bucketed_dedup": _bucketed_dedup,
    "bucketed_marked": _bucketed_marked,
    "bucketed_report": lambda s, d: _rounded(_bucketed(s, d).report("platform")),
    "report_global": _obs(lambda d: _rounded(reports.report(d, "global")), None),
    "report_platform": _obs(lambda d: _rounded(reports.report(d, "platform")), None),
    "report_profile": _obs(lambda d: _rounded(reports.report(d, "profile")), None),
    "report_levels": _levels,
    "report_lines": _report_lines,
    "report_lines_profiles": _profile_lines,
    "report_json_profiles": _profile_json,
    "dups_lines": _dups_lines,
    "report_marked": _marked_report,
    "distinct_platforms": _distinct_platforms,
    "concat_renumber": lambda s, d: _merged(s, d).select("platform_code", "profile_no", "observation_no", "pres"),
    "concat_no_pres_sort": lambda s, d: _merged(s, d, sort_by_pres=False, keep_na_pres=True).select("platform_code", "profile_no", "observation_no", "longitude", "profile_timestamp"),
    "concat_ordered": _ordered,
    "concat_norenumber": lambda s, d: _merged(s, d, number=False).select(*COLUMNS),
    "round_modes": _round_modes,
    "time_to_timestamp": _times,
    "time_keys": _time_keys,
    "depth_to_pressure": _to_pressure,
    "pressure_to_depth": _to_depth,
    "deploy_asof": _deployed,
    "deploy_asof_all": _deployed_all,
    "netcdf_nrt": _netcdf,
    "netcdf_cora": _cora,
    "netcdf_coordinates": _coordinates,
    "batch_convert": _batch_convert,
    "qc_flags": _flags,
    "coordinate_fill": _filled,
}

REPORT_COUNTS = "count(*) as n_profiles, cast(sum(n_obs) as bigint) as n_obs, count(*) filter (tq = '1') as time_qc_good, count(*) filter (pq = '1') as position_qc_good"
PROF_QC = ", p as (select platform_code, profile_no, count(*) as n_obs, min(time_qc) as tq, min(position_qc) as pq from obs group by platform_code, profile_no)"
STRING_KEY = "concat(cast(profile_timestamp as varchar), '|', cast(longitude as varchar), '|', cast(latitude as varchar))"
_P0 = "(-2.0 * z / ((1 - c1) + sqrt((1 - c1) * (1 - c1) + 8.84e-6 * z)))"

NETCDF_SQL = """with c as (select s_suppkey as s, s_nationkey as n, row_number() over (partition by s_nationkey order by s_suppkey) as profile_no from supplier),
l as (select *, unnest(range(0, 4)) as k from c),
v as (select *, (s + k) % 3 = 0 as no_temp, (s + k) % 4 = 0 as no_psal, (s + 2 * k) % 5 = 0 as no_pres, (s + k) % 14 - 2 as flag from l)
select concat('N', cast(n as varchar)) as platform_code, profile_no, 20000 + s / 8.0 as profile_time, timestamp '1950-01-01' + to_days(cast(20000 + s // 8 as integer)) + to_seconds(s % 8 * 10800) as profile_timestamp,
 k + 1 as observation_no, cast(s % 360 - 180 as double) as longitude, cast(s % 80 as double) as latitude, case when s % 12 < 10 then cast(s % 12 as varchar) else '' end as time_qc, cast(s % 3 as varchar) as position_qc,
 concat('AR_PR_CT_', cast(n as varchar)) as filename, case when no_temp then cast('NaN' as float) else cast(s % 100 + k * 0.5 as float) end as temp, case when flag between 0 and 9 then cast(flag as varchar) else '' end as temp_qc,
 case when no_psal then cast('NaN' as float) else cast(30 + k as float) end as psal, '' as psal_qc, case when no_pres then cast('NaN' as float) else cast(10 * k + 1 as float) end as pres, cast(k as varchar) as pres_qc,
 cast(0 as tinyint) as pres_conv, cast(case when no_pres then 0 else 1 end as tinyint) as deph_conv from v where not (no_temp and no_psal and no_pres)"""

DUPS_REPORT = f"{DUPS} select dup_group, pc as platform_code, pn as profile_no, days as profile_time, ts as profile_timestamp, longitude, latitude, n_obs from grp"
COMPARE_WHOLE = _compare_sql(True, "strftime(min(profile_timestamp), '%Y-%m-%d')", "obs", WHOLE)
REPORT_PLATFORM = f"{WITH}{PROF_QC}, a as (select platform_code, {REPORT_COUNTS} from p group by platform_code), b as (select platform_code, {GEO}, {_measures()} from obs group by platform_code) select * from a join b using (platform_code)"
PROFILE_SQL = f"""select platform_code, profile_no, min(profile_timestamp) as profile_timestamp, min(longitude) as longitude, min(latitude) as latitude, count(*) as n_obs, min(time_qc) as time_qc, {_measures()}
 from obs group by platform_code, profile_no"""
#: The observations that cleaning leaves, in place of all of them.
CLEANED = f"with every as ({DUCKDB}), good as (select * from every where {QC_OK}), obs as (select * from good where (platform_code, profile_no) in (select {HAS.format(t='good')}))"

ORACLES: dict[str, str] = {
    "filter_include": f"{WITH} select {LIST} from obs where {IN_BOX}",
    "filter_exclude": f"{WITH} select {LIST} from obs where not ({IN_BOX})",
    "filter_multibox": f"{WITH} select {LIST} from obs where {IN_REGION}",
    "filter_by_zones": f"{WITH} select {LIST} from obs where {IN_BOX}",
    "region_by_zones": f"{WITH} select {LIST} from obs where {IN_REGION}",
    "bucketed_dedup": f"""{CLEANED}{PROFILES}, r as (select pc, pn, row_number() over (partition by t, x, y order by n_obs desc, seen) as k from keyed where y is not null)
select {LIST} from obs where not exists (select 1 from r where pc = platform_code and pn = profile_no and k > 1)""",
    "bucketed_marked": f"{CLEANED}{PROFILES} select platform_code, profile_no, temp, exists (select 1 from grp where pc = platform_code and pn = profile_no) as is_dup from obs",
    "bucketed_report": REPORT_PLATFORM.replace(WITH, CLEANED, 1),
    "dropqc": f"{WITH} select {LIST} from obs where {QC_OK}",
    "dropna": f"{WITH} select {LIST} from obs where (platform_code, profile_no) in (select {HAS.format(t='obs')})",
    "drop_na_pres": f"{WITH} select {LIST} from obs where pres is not null and not isnan(pres)",
    "clean_pipeline": f"{WITH}, good as (select * from obs where {QC_OK}) select {LIST} from good where (platform_code, profile_no) in (select {HAS.format(t='good')}) and {IN_REGION}",
    "markdup_flags": f"{DUPS} select platform_code, profile_no, temp, exists (select 1 from grp where pc = platform_code and pn = profile_no) as is_dup from obs",
    "dups_report": DUPS_REPORT,
    "dups_kept": DUPS_REPORT,
    "dedup": f"""{DUPS}, r as (select pc, pn, row_number() over (partition by t, x, y order by n_obs desc, seen) as k from keyed where y is not null)
select {LIST} from obs where not exists (select 1 from r where pc = platform_code and pn = profile_no and k > 1)""",
    "dup_group_sizes": f"{DUPS} select least(n, 5) as group_size, count(*) as n_groups, cast(sum(n) as bigint) as n_profiles from (select count(*) as n from grp group by dup_group) group by 1",
    "dup_within_across": f"""{DUPS}, g as (select dup_group, case when count(distinct pc) <= 1 then 'within' else 'across' end as kind from grp group by dup_group)
select kind, count(distinct dup_group) as n_groups, count(*) as n_profiles, cast(sum(n_obs) as bigint) as n_obs, count(distinct pc) as n_platforms from grp join g using (dup_group) group by kind""",
    "compare_ab": _compare_sql(True, "strftime(min(profile_timestamp), '%Y-%m-%d')"),
    "compare_noplatform": _compare_sql(False, "strftime(min(profile_timestamp), '%Y-%m-%d')"),
    "compare_days": _compare_sql(True, "strftime(timestamp '1950-01-01' + to_milliseconds(cast(round(min(case when isnan(profile_time) then null else profile_time end) * 86400000.0) as bigint)), '%Y-%m-%d')"),
    "compare_whole": COMPARE_WHOLE,
    "compare_kept": COMPARE_WHOLE,
    "report_global": f"{WITH}{PROF_QC} select * from (select count(distinct platform_code) as n_platforms, {REPORT_COUNTS} from p), (select {GEO}, {_measures()} from obs)",
    "report_platform": REPORT_PLATFORM,
    "report_kept": REPORT_PLATFORM,
    "report_profile": f"""{WITH} select platform_code, profile_no, min(profile_timestamp) as profile_timestamp, min(longitude) as longitude, min(latitude) as latitude, count(*) as n_obs,
 min(time_qc) as time_qc, min(position_qc) as position_qc, {_measures()} from obs group by platform_code, profile_no""",
    "report_levels": f"""{WITH}{PROF_QC}, a as (select case when grouping(platform_code) = 1 then 'global' else 'platform' end as level, platform_code, count(distinct platform_code) as n_platforms, {REPORT_COUNTS} from p group by rollup (platform_code)),
b as (select platform_code, {_measures()} from obs group by rollup (platform_code)) select a.*, b.* exclude (platform_code) from a join b on a.platform_code is not distinct from b.platform_code""",
    "report_lines": f"""{WITH}{PROF_QC}, a as (select platform_code, {REPORT_COUNTS} from p group by platform_code), b as (select platform_code, {GEO}, {_measures()} from obs group by platform_code),
r as (select *, row_number() over (order by platform_code) as line from a join b using (platform_code))
select 0 as line, concat_ws(chr(9), {', '.join(f"'{c}'" for c in CELLS)}) as text union all
select line, concat_ws(chr(9), {', '.join(_cell(c) for c in CELLS)}) as text from r""",
    "distinct_platforms": f"""{DUPS}, g as (select dup_group, case when count(distinct pc) <= 1 then 'within' else 'across' end as kind from grp group by dup_group)
select 'all' as what, '' as value, count(distinct platform_code) as n_platforms from obs union all
select 'month', strftime(profile_timestamp, '%Y-%m'), count(distinct platform_code) from obs group by 2 union all
select 'duplicates', kind, count(distinct pc) from grp join g using (dup_group) group by kind""",
    "report_lines_profiles": f"""{WITH}, r as ({PROFILE_SQL}), o as (select *, row_number() over (order by platform_code, profile_no) as line from r)
select 0 as line, concat_ws(chr(9), {', '.join(f"'{c}'" for c in PROFILE_CELLS)}) as text union all select line, concat_ws(chr(9), {', '.join(_profile_cell(c) for c in PROFILE_CELLS)}) from o""",
    "report_json_profiles": f"""{WITH}, r as ({PROFILE_SQL}), o as (select *, row_number() over (order by platform_code, profile_no) as line from r)
select line, '{{' || concat_ws(',', {', '.join(_json_cell(c) for c in PROFILE_CELLS)}, '"long":' || cast(n_obs > 3 as varchar), '"odd":"\\"\\\\\\t' || platform_code || '"') || '}}' as text from o""",
    "dups_lines": f"""with d as ({DUPS_REPORT}), o as (select *, row_number() over (order by dup_group, platform_code, profile_no) as line from d)
select line, concat_ws(chr(9), cast(dup_group as varchar), platform_code, cast(profile_no as varchar), {_shortest('profile_time')}, strftime(profile_timestamp, '%Y-%m-%d %H:%M:%S'), {_shortest('longitude')}, {_shortest('latitude')}, cast(n_obs as varchar)) as text from o""",
    "report_marked": f"{DUPS} select k.pc as platform_code, count(*) as n_profiles, count(g.pn) as dup_profiles from keyed k left join grp g on k.pc = g.pc and k.pn = g.pn group by k.pc",
    "concat_renumber": f"""{WITH}, m as (select *, {STRING_KEY} as k from obs where pres is not null and not isnan(pres))
select platform_code, dense_rank() over (partition by platform_code order by k) as profile_no, row_number() over (partition by platform_code, k order by pres, __order) as observation_no, pres from m""",
    "concat_no_pres_sort": f"""{WITH}, m as (select *, {STRING_KEY} as k from obs)
select platform_code, dense_rank() over (partition by platform_code order by k) as profile_no, row_number() over (partition by platform_code, k order by __order) as observation_no, longitude, profile_timestamp from m""",
    "concat_ordered": f"""{WITH}, m as (select *, {STRING_KEY} as k, profile_no % 2 as part from obs where pres is not null and not isnan(pres)),
n as (select * replace (dense_rank() over (partition by platform_code order by k) as profile_no), row_number() over (partition by platform_code, k order by pres, part, __order) as observation_no from m)
select platform_code, profile_no, observation_no, pres, row_number() over (order by platform_code, profile_timestamp, longitude, latitude, pres, part, __order, observation_no) as row from n""",
    "concat_norenumber": f"{WITH} select {LIST} from obs where pres is not null and not isnan(pres)",
    "round_modes": """with d as (select distinct l_extendedprice / 7 - 3000 as v from lineitem)
select v, cast(round(v * 1000.0) as bigint) as k_round, cast(floor(v * 1000.0) as bigint) as k_floor, cast(ceil(v * 1000.0) as bigint) as k_ceil, cast(trunc(v * 1000.0) as bigint) as k_trunc from d""",
    "time_to_timestamp": f"""{WITH}, d as (select distinct profile_time from obs), f as (select *, case when isnan(profile_time) then 0 else profile_time end as v from d)
select profile_time, timestamp '1950-01-01' + to_days(cast(trunc(v) as integer)) + to_seconds(cast(trunc((v - trunc(v)) * 86400.0) as bigint)) as stamp,
 case when isnan(profile_time) then 0 else cast(round(v * 86400000.0) as bigint) - 631152000000 end as ms, isnan(profile_time) as unknown from f""",
    "time_keys": "select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as day, strftime(o_orderdate, '%Y%m%dT%H:%M:%S') as second, strftime(o_orderdate, 'year %Y, day %j') as words from orders",
    "pressure_to_depth": f"""{GRID_SQL}, z as (select *, {_h('cast(pres as double)')} as hh from q)
select l_orderkey, l_linenumber, round(cast(case when isnan(deph) and not isnan(pres) then cast(2.0 * hh / (gr + sqrt(gr * gr + 2.0 * 2.26e-7 * gr * hh)) as float) else deph end as double), 1) as deph,
 case when isnan(deph) and not isnan(pres) then '1' else '2' end as deph_qc, case when isnan(deph) and not isnan(pres) then 1 else 0 end as deph_conv from z""",
    "depth_to_pressure": f"""{GRID_SQL}, z as (select *, -cast(deph as double) as z, 5.25e-3 * s2 + 5.92e-3 as c1 from q), p as (select *, case when not isnan(z) then {_P0} else z end as p0 from z),
f as (select *, {_h('p0')} + gr * (z - 0.5 * 2.26e-7 * z * z) as f0 from p), h as (select *, p0 - f0 / (1e4 * {_v('p0')}) as p1 from f), e as (select *, p0 - f0 / (1e4 * {_v('(0.5 * (p0 + p1))')}) as r from h)
select l_orderkey, l_linenumber, round(cast(case when isnan(pres) and not isnan(deph) then cast(r as float) else pres end as double), 1) as pres,
 case when isnan(pres) and not isnan(deph) then '2' else '1' end as pres_qc, case when isnan(pres) and not isnan(deph) then 1 else 0 end as pres_conv from e""",
    "deploy_asof": """with t as (select distinct c_custkey % 400 as t from customer), r as (select greatest((s_suppkey * 37) % 300 - 5, 0) as start, s_acctbal as value, s_suppkey as position from supplier)
select t, coalesce((select value from r where start <= t order by start desc, position desc limit 1), cast('NaN' as double)) as value from t""",
    "deploy_asof_all": """with r as (select s_nationkey as nation, greatest((s_suppkey * 37) % 300 - 5, 0) as start, s_acctbal as value, s_suppkey as position from supplier),
c as (select c_custkey, c_nationkey as nation, c_custkey % 400 as t from customer),
m as (select c_custkey, arg_max(value, start * 1000000000 + position) as value from c join r on r.nation = c.nation and start <= t group by c_custkey)
select c.c_custkey, c.nation, c.t, coalesce(m.value, cast('NaN' as double)) as value from c left join m using (c_custkey)""",
    "netcdf_nrt": NETCDF_SQL,
    "netcdf_cora": """with c as (select s_suppkey as s, s_nationkey as n, row_number() over (partition by s_nationkey order by s_suppkey) as profile_no from supplier),
l as (select *, unnest(range(0, 3)) as k from c),
v as (select *, (s + k) % 3 = 0 as no_temp, (s * k) % 5 = 1 as no_psal, (s + k) % 4 = 1 as no_pres, (s + 2 * k) % 13 - 1 as flag from l)
select concat('CO_', cast(n as varchar)) as filename, concat('S', cast(s % 40 as varchar)) as platform_code, profile_no, 10000 + s / 4.0 as profile_time, k + 1 as observation_no, cast(s % 180 as double) as longitude, cast(s % 70 as double) as latitude,
 case when s % 11 < 10 then cast(s % 11 as varchar) else '' end as time_qc, cast(s % 4 as varchar) as position_qc, case when no_temp then cast('NaN' as float) else cast(s % 30 + k as float) end as temp,
 case when flag between 0 and 9 then cast(flag as varchar) else '' end as temp_qc, case when no_psal then cast('NaN' as float) else cast(34.5 + k as float) end as psal,
 case when no_pres then cast('NaN' as float) else cast(5 + 10 * k as float) end as pres, cast(0 as tinyint) as pres_conv, case when no_pres then cast('NaN' as float) else cast(4.5 + 10 * k as float) end as deph, cast(k + 1 as varchar) as deph_qc,
 cast(0 as tinyint) as deph_conv from v where not (no_temp and no_psal and no_pres)""",
    "netcdf_coordinates": """with c as (select s_suppkey as s, s_nationkey as n, row_number() over (partition by s_nationkey order by s_suppkey) as profile_no from supplier),
r as (select *, case when s % 4 = 0 then null else cast(s % 90 as double) end as lon, case when s % 5 = 0 then null else cast(s % 60 as double) end as lat,
 case when n % 2 = 1 then n + case when profile_no > 3 then 0.5 else 0 end when s % 3 = 0 then null else s % 90 + 0.5 end as plon, case when n % 2 = 1 then n / 2.0 + case when profile_no > 3 then 1 else 0 end when s % 7 = 0 then null else s % 60 + 0.25 end as plat from c),
l as (select *, unnest(range(0, 2)) as k from r)
select concat('BO_PR_CT_', cast(n as varchar)) as filename, profile_no, k + 1 as observation_no, cast(coalesce(lon, plon, cast('NaN' as double)) as double) as longitude, cast(coalesce(lat, plat, cast('NaN' as double)) as double) as latitude,
 cast(coalesce(plon, lon, cast('NaN' as double)) as double) as profile_longitude, cast(coalesce(plat, lat, cast('NaN' as double)) as double) as profile_latitude, cast(s % 50 + k as float) as temp from l""",
    "batch_convert": f"select *, concat(filename, '.parquet') as file, row_number() over (partition by filename order by profile_no, observation_no) - 1 as place from ({NETCDF_SQL})",
    "qc_flags": """select p_partkey, case when p_partkey % 14 - 2 between 0 and 9 then cast(p_partkey % 14 - 2 as varchar) else '' end as i,
 case p_partkey % 4 when 0 then '1' when 2 then 'A' else '' end as c, 'P' || cast(p_partkey as varchar) as t,
 case when p_partkey % 5 = 0 or p_partkey % 9 = 3 then cast('NaN' as double) else cast(p_partkey % 9 as double) end as f from part""",
    "coordinate_fill": f"""{WITH}, d as (select distinct platform_code, profile_no, latitude, case when profile_no % 5 > 0 then longitude + 50 else cast('NaN' as double) end as other from obs)
select platform_code, profile_no, case when isnan(latitude) then other else latitude end as first, case when isnan(other) then latitude else other end as second from d""",
}
