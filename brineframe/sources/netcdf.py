"""NetCDF grids as a Spark data source of profile rows, and their conversion to observations.

The source decodes; everything that has a meaning (flags, fill values, coordinates,
conversions, dropping empty levels) is column expressions on its rows:
one row per profile, variables as arrays over the levels.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from math import ceil
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..functions.grids import depth_from_pressure, deployed_in, filled_from, pressure_from_depth, with_made_pressure
from ..functions.qc import flag_from_char, flag_from_int, float_or_nan, packed_text
from ..functions.times import days_to_timestamp
from ..session import prepare, work_path
from .cdf import open_grid
from .files import largest_first
from .outputs import TARGET, note, noted, write_each
from .presets import CoraLayout, NrtLayout

GRIDS = ("TEMP", "PSAL", "PRES", "DEPH")
#: Bytes of a file for which a partition is made, and profile rows of a batch.
SLICE_BYTES, BATCH = 64 << 20, 1024
SCHEMA = (
    "path string, stem string, target string, n long, levels int, platform_attr string, platform_chars string, time double, lon double, lat double, has_precise boolean, has_deploy boolean, plon double, plat double,"
    " deploy_start array<int>, deploy_lon array<float>, deploy_lat array<float>, time_qc int, position_qc int, has_deph boolean,"
    + ", ".join(f"{g.lower()} array<float>, {g.lower()}_fill float, {g.lower()}_flag array<int>, {g.lower()}_char array<string>" for g in GRIDS)
)
_ARROW = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "float": pa.float32(), "boolean": pa.bool_()}
#: The same as Arrow types, which workers need.
ARROW = {c: pa.list_(_ARROW[t[6:-1]]) if t.startswith("array<") else _ARROW[t] for c, t in (x.split() for x in SCHEMA.split(","))}
OBSERVATIONS = (
    "platform_code", "profile_no", "profile_time", "profile_timestamp", "observation_no", "longitude", "latitude", "profile_longitude", "profile_latitude", "time_qc", "position_qc", "filename",
    "temp", "temp_qc", "psal", "psal_qc", "pres", "pres_qc", "pres_conv", "deph", "deph_qc", "deph_conv",
)


class _Slice(InputPartition):
    """One of several equal parts of a file's profiles, and where the file's result goes."""

    def __init__(self, path: str, part: int, parts: int, target: str | None = None):
        self.path, self.part, self.parts, self.target = path, part, parts, target


def _axes(kind: str) -> tuple[str, str]:
    return ("TIME", "DEPTH") if kind == "nrt" else ("N_PROF", "N_LEVELS")


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.kind = options.get("layout", "nrt")
        self.time_var = options.get("time_var", "TIME")
        files = json.loads(options["files"]) if "files" in options else [options["path"]]
        #: With targets, each file is read in one go, so that its result can be written in its order.
        self.whole = any(isinstance(f, list) for f in files)
        self.paths = dict(f if isinstance(f, list) else (f, None) for f in files)
        self.failures = options.get("failures")

    def partitions(self):
        out = []
        for path in largest_first(self.paths):  # no file is opened here
            parts = 1 if self.whole else max(1, ceil(Path(path).stat().st_size / SLICE_BYTES))
            out += [_Slice(path, k, parts, self.paths[path]) for k in range(parts)]
        return out or [_Slice("", 0, 1)]

    def read(self, part: _Slice) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        try:
            own = open_grid(part.path)
            total = own.dimensions[_axes(self.kind)[0]]
            start, stop = (total * k // part.parts for k in (part.part, part.part + 1))
            for a in range(start, stop, BATCH):
                yield self._batch(part.path, own, a, min(a + BATCH, stop), part.target)
        except Exception as e:  # noqa: BLE001  (noted; the other files go on)
            if not self.failures:
                raise
            note(self.failures, part.path, part.target, e)

    def _batch(self, path: str, own, start: int, stop: int, target: str | None = None) -> pa.RecordBatch:
        rows, levels = _axes(self.kind)
        n, depth = stop - start, own.dimensions[levels]
        kinds = ARROW

        def flat(values: np.ndarray, kind: pa.DataType) -> pa.Array:
            return pa.array(np.ascontiguousarray(values, values.dtype.newbyteorder("="))).cast(kind)

        def one(value, kind: pa.DataType) -> pa.Array:
            return pa.array([value] * n, kind)

        def line(name: str, kind: pa.DataType, missing=None) -> pa.Array:
            """A value per profile: read, repeated from a scalar, or missing."""
            if name not in own.variables:
                return one(missing, kind)
            if own.variables[name].dims[:1] != (rows,):
                return one(own.read(name).ravel()[0].item(), kind)
            return flat(own.read(name, start, stop).reshape(n, -1)[:, 0], kind)

        def grid(name: str, kind: pa.ListType) -> pa.Array:
            if name not in own.variables:
                return pa.nulls(n, kind)
            if own.variables[name].dims[:1] != (rows,):
                values = np.repeat(own.read(name).ravel()[:1], n * depth)
            else:
                values = own.read(name, start, stop).ravel()
            ends = np.arange(n + 1, dtype=np.int32) * (len(values) // n)
            return pa.ListArray.from_arrays(pa.array(ends), flat(values, kind.value_type))

        def chars(name: str) -> list:
            if name not in own.variables:
                return [None] * n
            raw = own.read(name, start, stop).reshape(n, -1)
            return [[(c or b"\0").decode("latin-1") for c in r] for r in raw.tolist()]

        def is_char(name: str) -> bool:
            return name in own.variables and own.variables[name].kind == 2

        nan, real = float("nan"), kinds["time"]
        precise = {"PRECISE_LONGITUDE", "PRECISE_LATITUDE"} <= own.variables.keys()
        deploy = {"DEPLOY_LONGITUDE", "DEPLOY_LATITUDE", "DEPLOYMENT"} <= own.variables.keys()
        attr = own.attributes.get("platform_code")
        out = {
            "path": one(path, pa.string()), "stem": one(Path(path).stem, pa.string()), "target": one(target, pa.string()), "n": pa.array(np.arange(start, stop)), "levels": one(depth, pa.int32()), "platform_attr": one(None if attr is None else str(attr), pa.string()),
            "platform_chars": pa.array(["".join(r) for r in chars("PLATFORM_NUMBER")] if "PLATFORM_NUMBER" in own.variables else [None] * n, pa.string()),
            "time": line(self.time_var, real, nan), "lon": line("LONGITUDE", real, nan), "lat": line("LATITUDE", real, nan), "has_precise": one(precise, pa.bool_()), "has_deploy": one(deploy, pa.bool_()),
            "plon": line("PRECISE_LONGITUDE", real) if precise else one(None, real), "plat": line("PRECISE_LATITUDE", real) if precise else one(None, real), "has_deph": one("DEPH" in own.variables, pa.bool_()),
        }
        for c, v in (("deploy_start", "DEPLOYMENT"), ("deploy_lon", "DEPLOY_LONGITUDE"), ("deploy_lat", "DEPLOY_LATITUDE")):
            out[c] = one(own.read(v).ravel().tolist() if deploy else None, kinds[c])
        for c, v in (("time_qc", "TIME_QC"), ("position_qc", "POSITION_QC")):
            out[c] = one(None, pa.int32()) if is_char(v) else line(v, pa.int32())
        for g in GRIDS:
            c, fill = g.lower(), own.variables[g].attributes.get("_FillValue") if g in own.variables else None
            out[c], out[f"{c}_fill"] = grid(g, kinds[c]), one(None if fill is None else float(fill), pa.float32())
            text = is_char(f"{g}_QC")
            out[f"{c}_flag"] = pa.nulls(n, kinds[f"{c}_flag"]) if text else grid(f"{g}_QC", kinds[f"{c}_flag"])
            out[f"{c}_char"] = pa.array(chars(f"{g}_QC") if text else [None] * n, kinds[f"{c}_char"])
        return pa.RecordBatch.from_arrays([out[c].cast(kinds[c]) for c in kinds], list(kinds))


class NetcdfProfiles(DataSource):
    """``spark.read.format("netcdf_profiles")``: options ``path`` or ``files`` (a JSON list, of paths or of pairs with the
    result's path), ``layout`` (nrt, cora), ``time_var``, ``failures`` (a shared folder where files that can't be read are noted)."""

    @classmethod
    def name(cls) -> str:
        return "netcdf_profiles"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(dict(self.options))


def _decoded(kind: str, time_var: str, targets: dict[str, str], failures: str | None):
    """Profile rows of files that come as bytes."""
    reader = _Reader({"layout": kind, "time_var": time_var, "files": "[]"})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                target = targets.get(path.rsplit("/", 1)[-1])
                try:
                    own = open_grid(path, content.as_buffer().to_pybytes())
                    total = own.dimensions[_axes(kind)[0]]
                    for a in range(0, total, BATCH):
                        yield reader._batch(path, own, a, min(a + BATCH, total), target)
                except Exception as e:  # noqa: BLE001  (noted; the other files go on)
                    if not failures:
                        raise
                    note(failures, path, target, e)

    return run


def is_remote(path: str) -> bool:
    """Whether a path is a URI of a store that only Spark's readers open."""
    return re.match(r"^[a-z][a-z0-9+.-]*:/", path) is not None and not path.startswith("file:")


def read_remote_profiles(spark: SparkSession, files: list[str] | dict[str, str], layout: NrtLayout | CoraLayout, failures: str | None = None) -> DataFrame:
    """``read_profiles`` of files that are read through Spark, from any store that it knows. A file comes whole to the task that decodes
    it, so it may have 2 GB at most, and takes about three times its size there."""
    cora = isinstance(layout, CoraLayout)
    results = {f.rsplit("/", 1)[-1]: t for f, t in files.items()} if isinstance(files, dict) else {}
    if len(results) < len(files) and isinstance(files, dict):
        raise ValueError("files of one batch have names of their own")
    whole = prepare(spark).read.format("binaryFile").load(list(files)).select("path", "content")
    return whole.mapInArrow(_decoded("cora" if cora else "nrt", layout.time_var if cora else "TIME", results, failures), SCHEMA)


def read_profiles(spark: SparkSession, files: list[str] | dict[str, str], layout: NrtLayout | CoraLayout, failures: str | None = None) -> DataFrame:
    """``files`` that map paths to results are read in one go each, with the result in ``target``."""
    prepare(spark)
    if any(is_remote(str(f)) for f in files):
        return read_remote_profiles(spark, files, layout, failures)
    spark.dataSource.register(NetcdfProfiles)
    cora = isinstance(layout, CoraLayout)
    listed = [[str(f), str(t)] for f, t in files.items()] if isinstance(files, dict) else [str(f) for f in files]
    reader = spark.read.format("netcdf_profiles").option("files", json.dumps(listed)).option("layout", "cora" if cora else "nrt")
    reader = reader.option("failures", failures) if failures else reader
    return reader.option("time_var", layout.time_var if cora else "TIME").load()


def observations(profiles: DataFrame, layout: NrtLayout | CoraLayout, extra: tuple[str, ...] = ()) -> DataFrame:
    """One row per level of a profile that has any value, in the fixed column order, then columns of the profiles (``extra``).

    Numbers are places in the grid and are not closed up when levels are dropped. Coordinates are
    double for either layout. Depth that is neither read nor computed is NaN.
    """
    nan = F.lit(float("nan"))
    cora = isinstance(layout, CoraLayout)
    p = profiles
    lon, lat = F.coalesce("lon", nan), F.coalesce("lat", nan)
    if cora:
        platform = packed_text(F.coalesce("platform_chars", F.lit("")))
        time_qc, position_qc = (flag_from_int(F.col(c)) if layout.has_time_qc else F.lit("") for c in ("time_qc", "position_qc"))
        plon, plat, used_lat = nan, nan, lat
        deph_there = F.lit(layout.has_deph_source)
    else:
        platform = F.coalesce("platform_attr", F.lit(""))
        time_qc, position_qc = flag_from_int(F.col("time_qc")), flag_from_int(F.col("position_qc"))
        deph_there = F.lit(layout.has_deph_source) | F.col("has_deph")
        if layout.has_profile_coords:
            own = lambda c, d: F.when(F.col("has_precise"), F.col(c).cast("double")).when(F.col("has_deploy"), deployed_in(F.col("deploy_start"), F.col(d), F.col("n")).cast("double")).otherwise(nan)
            plon, plat = F.coalesce(own("plon", "deploy_lon"), nan), F.coalesce(own("plat", "deploy_lat"), nan)
            lon, plon, lat, plat = filled_from(lon, plon), filled_from(plon, lon), filled_from(lat, plat), filled_from(plat, lat)
            used_lat = plat
        else:
            plon, plat, used_lat = nan, nan, lat
    p = p.select(
        platform.alias("platform_code"), (F.col("n") + 1).alias("profile_no"), F.coalesce("time", nan).alias("profile_time"), lon.alias("longitude"), lat.alias("latitude"),
        plon.alias("profile_longitude"), plat.alias("profile_latitude"), time_qc.alias("time_qc"), position_qc.alias("position_qc"), F.col("stem").alias("filename"), used_lat.alias("__lat"), deph_there.alias("__sourced"),
        *extra, *(f"{g.lower()}_fill" for g in GRIDS), F.sequence(F.lit(0), F.col("levels") - 1).alias("__levels"), "levels",
        *(c for g in GRIDS for c in (g.lower(), f"{g.lower()}_flag", f"{g.lower()}_char")),
    )
    names = [c for g in GRIDS for c in (g.lower(), f"{g.lower()}_flag", f"{g.lower()}_char")]
    p = p.where("levels > 0").select("*", F.explode("__levels").alias("__k"))
    at = lambda c: F.get(F.col(c), F.col("__k"))
    flag = (lambda g: flag_from_char(at(f"{g}_char"))) if cora and layout.qc_type == "Char" else (lambda g: flag_from_int(at(f"{g}_flag")))
    values = {g: float_or_nan(at(g), F.col(f"{g}_fill")) for g in ("temp", "psal", "pres", "deph")}
    values = {g: F.when(F.col(f"{g}_fill").isNull(), float_or_nan(at(g), None)).otherwise(v) for g, v in values.items()}
    flags = {g: flag(g) for g in values}
    values["deph"] = F.when(F.col("__sourced"), values["deph"]).otherwise(nan.cast("float"))
    flags["deph"] = F.when(F.col("__sourced"), flags["deph"]).otherwise(F.lit(""))
    p = p.select("*", *(values[g].alias(f"__{g}") for g in values), *(flags[g].alias(f"__{g}_qc") for g in values)).drop(*names)
    # a level stays if it has a value, or a depth that gives a pressure (or, for nrt, a depth at all)
    has = lambda c: ~F.isnan(c)
    deep = has("__deph") & (F.lit(not cora) & F.col("__sourced") | (F.col("__deph") >= -5) & has("__lat"))
    p = p.where(has("__temp") | has("__psal") | has("__pres") | deep)
    p = with_made_pressure(p, F.col("__deph"), F.col("__lat"))
    pres, pres_qc, pres_conv = pressure_from_depth(F.col("__pres"), F.col("__pres_qc"), F.col("__deph"), F.col("__deph_qc"), F.col("__made"))
    deph, deph_qc, deph_conv = depth_from_pressure(F.col("__deph"), F.col("__deph_qc"), F.col("__pres"), F.col("__pres_qc"), F.col("__lat"))
    out = p.select(
        *extra, "platform_code", "profile_no", "profile_time", days_to_timestamp(F.col("profile_time")).alias("profile_timestamp"), (F.col("__k") + 1).cast("long").alias("observation_no"),
        "longitude", "latitude", "profile_longitude", "profile_latitude", "time_qc", "position_qc", "filename",
        F.col("__temp").alias("temp"), F.col("__temp_qc").alias("temp_qc"), F.col("__psal").alias("psal"), F.col("__psal_qc").alias("psal_qc"),
        pres.alias("pres"), pres_qc.alias("pres_qc"), pres_conv.alias("pres_conv"), deph.alias("deph"), deph_qc.alias("deph_qc"), deph_conv.alias("deph_conv"),
    )
    return out.select(*OBSERVATIONS, *extra)


def convert(spark: SparkSession, files: list[str], layout: NrtLayout | CoraLayout) -> DataFrame:
    return observations(read_profiles(spark, files, layout), layout)


def convert_each(spark: SparkSession, results: dict[str, str], layout: NrtLayout | CoraLayout) -> list[str]:
    """Converts every file of ``results`` to the file that it maps to, in one job without a shuffle; a file without
    observations becomes an empty table. What can't be read is left out and returned, with the reason; all other files are
    written. None is until all are done."""
    failures = work_path(spark, "failures")
    rows = observations(read_profiles(spark, results, layout, failures), layout, ("target",)).withColumnRenamed("target", TARGET)
    write_each(rows, list(map(str, results.values())), ordered=True, failures=failures)
    return [f"{x['source']}: {x['reason']}" for x in noted(failures)]


def header(path: str | Path, kind: str = "nrt") -> dict:
    """Attributes, dimensions and variables of one file, under its stem."""
    from ..plans.headers import NRT_ATTRIBUTES

    own = open_grid(path)
    names = NRT_ATTRIBUTES if kind == "nrt" else ()
    return {
        Path(path).stem: {
            "global_attributes": {a: str(own.attributes.get(a, "")) for a in names},
            "dimensions": dict(own.dimensions),
            "variables": {n: {"data_type": v.type_name, "dimensions": list(v.dims)} for n, v in own.variables.items()},
        }
    }


def headers(spark: SparkSession, files: list[str], kind: str = "nrt") -> DataFrame:
    """Header documents of many files, read on the executors: path, doc (JSON)."""
    prepare(spark)

    def read(batches):
        import pandas as pd

        for batch in batches:
            yield pd.DataFrame({"path": batch["path"], "doc": [json.dumps(header(p, kind), sort_keys=True) for p in batch["path"]]})

    paths = spark.createDataFrame([(p,) for p in largest_first(files)], "path string")
    return paths.repartition(max(1, min(len(files), spark.sparkContext.defaultParallelism))).mapInPandas(read, "path string, doc string")


__all__ = ["NetcdfProfiles", "convert", "convert_each", "header", "headers", "observations", "read_profiles"]
