"""Command line: ``python -m brineframe ...``. Conversions give one Parquet file for each source; other tables are folders as
Spark writes them, or single files with ``--one-file``."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Sequence
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import SparkSession

from .functions.keys import ROUND_MODES, KeyOptions
from .operators.cleaning import Box, drop_na, drop_qc, filter_box
from .operators.compare import CompareOptions, compare
from .operators.duplicates import drop_duplicate_profiles, duplicate_groups, duplicates_report, marked_by, profiles
from .operators.merging import merge
from .plans import headers as docs
from .plans.pages import page
from .plans.lines import duplicates_line, tsv_line, write_lines_of
from .plans.regions import REGIONS, Pipeline
from .plans.render import FORMATS, emit, rendered, write_report
from .plans.report import LEVELS, report
from .session import stored
from .sources import files as listing
from .sources import netcdf
from .sources.outputs import write_one
from .sources.spatial import SpatialTable, is_spatial
from .sources.presets import PATTERNS, PRESETS, NrtLayout, layout


ONE_FILE = "one Parquet file, written by one task, instead of a folder of files"


@dataclass(frozen=True)
class Done:
    """What a call did: command, variant, number of files it worked on."""

    module: str
    target: str
    count: int = 1


def session() -> SparkSession:
    return SparkSession.builder.appName("brineframe").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _switch(p: argparse.ArgumentParser, name: str) -> None:
    """--name and --no-name; the last one given counts, neither leaves the preset alone."""
    dest = name.replace("-", "_")
    p.add_argument(f"--{name}", dest=dest, action="store_const", const=True, default=None)
    p.add_argument(f"--no-{name}", dest=dest, action="store_const", const=False)


def _layout_arguments(p: argparse.ArgumentParser, preset: str) -> None:
    p.add_argument("-c", "--config")
    _switch(p, "deph-source")
    if isinstance(PRESETS[preset], NrtLayout):
        _switch(p, "profile-coords")
    else:
        p.add_argument("--time-var")
        p.add_argument("--qc-type", choices=["int", "char"])
        _switch(p, "time-qc")
    p.add_argument("--pattern")


def _layout(a: argparse.Namespace):
    flags = {"has_deph_source": a.deph_source, "pattern": a.pattern}
    if isinstance(PRESETS[a.preset], NrtLayout):
        flags["has_profile_coords"] = a.profile_coords
    else:
        flags |= {"time_var": a.time_var, "qc_type": a.qc_type and a.qc_type.capitalize(), "has_time_qc": a.time_qc}
    return layout(a.preset, a.config, **flags)


def _key_arguments(p: argparse.ArgumentParser) -> None:
    p.add_argument("--time-format", default="%Y-%m-%d", help="strftime format of the time in the key")
    p.add_argument("--decimals", type=int, default=3)
    p.add_argument("--round-mode", choices=ROUND_MODES, default="round")


def _key(a: argparse.Namespace) -> KeyOptions:
    return KeyOptions(a.time_format, a.decimals, a.round_mode)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="brineframe", description="CTD profiles on Spark")
    commands = top.add_subparsers(dest="command", required=True)

    def variants(name: str, help: str):
        return commands.add_parser(name, help=help).add_subparsers(dest="variant", required=True)

    convert = variants("convert", "a NetCDF file to a table")
    for preset in PRESETS:
        p = convert.add_parser(preset)
        _layout_arguments(p, preset)
        p.add_argument("src")
        p.add_argument("dest")
        p.set_defaults(preset=preset)
    batch = variants("batch", "all NetCDF files below a folder")
    kinds = batch.add_parser("convert").add_subparsers(dest="preset", required=True)
    for preset in PRESETS:
        p = kinds.add_parser(preset)
        _layout_arguments(p, preset)
        p.add_argument("-o", "--output-dir")
        p.add_argument("-t", "--threads", type=int, help="accepted and not needed: one job converts all files")
        p.add_argument("src_dir")
    kinds = batch.add_parser("header").add_subparsers(dest="preset", required=True)
    for kind in ("nrt", "cora"):
        p = kinds.add_parser(kind)
        p.add_argument("-o", "--output-dir")
        p.add_argument("-t", "--threads", type=int)
        p.add_argument("--pattern", default="*.nc")
        p.add_argument("src_dir")
    header = variants("header", "metadata of a NetCDF file as YAML")
    for kind in ("nrt", "cora"):
        p = header.add_parser(kind)
        p.add_argument("src")
        p.add_argument("dest")
    concat = variants("concat", "many files as one")
    p = concat.add_parser("convert")
    p.add_argument("--pattern", default="*.parquet")
    p.add_argument("--no-renumber", action="store_true")
    p.add_argument("--no-pres-sort", action="store_true")
    p.add_argument("--keep-na-pres", action="store_true")
    p.add_argument("-t", "--threads", type=int, help="accepted and not needed: Spark decides")
    p.add_argument("--one-file", action="store_true", help=ONE_FILE)
    p.add_argument("src_dir")
    p.add_argument("output")
    p = concat.add_parser("header")
    p.add_argument("--pattern", default="*.yaml")
    p.add_argument("src_dir")
    p.add_argument("output")
    reports = variants("report", "summaries")
    p = reports.add_parser("parquet")
    p.add_argument("--level", choices=LEVELS, default="platform")
    p.add_argument("--format", choices=FORMATS, default="tsv")
    p.add_argument("src")
    p.add_argument("dest", nargs="?")
    p = reports.add_parser("yaml")
    p.add_argument("--format", choices=FORMATS, default="tsv")
    p.add_argument("src")
    p.add_argument("dest", nargs="?")
    p = reports.add_parser("summary")
    p.add_argument("stem")
    p.add_argument("--report-dir", default="report")
    p.add_argument("--out-dir", default="output")
    p.add_argument("--format", choices=["md", "html"], default="md")
    p.add_argument("--title")
    p.add_argument("--note", action="append", default=[])
    p.add_argument("-o", "--output")
    p = commands.add_parser("filter", help="profiles inside or outside a box")
    p.add_argument("--mode", choices=["include", "exclude"], default="include")
    for c in ("min-lon", "max-lon", "min-lat", "max-lat"):
        p.add_argument(f"--{c}", type=float, required=True)
    p.add_argument("--one-file", action="store_true", help=ONE_FILE)
    p.add_argument("src")
    p.add_argument("dest")
    for name, text in (("dropna", "profiles without any value of a measure go"), ("dropqc", "rows with bad flags go"), ("dedup", "one profile of each key stays")):
        p = commands.add_parser(name, help=text)
        if name == "dedup":
            _key_arguments(p)
        p.add_argument("--one-file", action="store_true", help=ONE_FILE)
        p.add_argument("src")
        p.add_argument("dest")
    p = commands.add_parser("region", help="all stages of a region over its products, with reports and summary pages")
    p.add_argument("name", choices=sorted(REGIONS))
    p.add_argument("--root", default=".", help="where output, report and summary are")
    _key_arguments(p)
    p.add_argument("products", nargs="+", metavar="STEM=TABLE")
    p = commands.add_parser("arrange", help="a table laid out by position, which filter reads in part; rows are added if it is there")
    p.add_argument("src")
    p.add_argument("dest")
    p = commands.add_parser("markdup", help="mark profiles that share a key")
    p.add_argument("--one-file", action="store_true", help=ONE_FILE)
    _key_arguments(p)
    for c in ("src", "dest", "dups"):
        p.add_argument(c)
    p = commands.add_parser("compare", help="what two tables hold of each other")
    _key_arguments(p)
    for c, d in (("platform", "platform_code"), ("time", "profile_time"), ("lon", "longitude"), ("lat", "latitude")):
        p.add_argument(f"--{c}-col", default=d)
    p.add_argument("--no-platform-key", action="store_true")
    p.add_argument("--format", choices=FORMATS, default="tsv")
    p.add_argument("a")
    p.add_argument("b")
    p.add_argument("dest", nargs="?")
    return top


def _nothing(pattern: str, folder: str) -> int:
    print(f"no files matching {pattern!r} below {folder}; nothing to do", file=sys.stderr)
    return 0


def _converted(spark: SparkSession, pairs: list[tuple[Path, Path]], own) -> int:
    """All files in one job; what failed is reported together, after the others are written."""
    if failed := netcdf.convert_each(spark, {str(s.absolute()): str(t.absolute()) for s, t in pairs}, own):
        raise RuntimeError(f"{len(failed)} of {len(pairs)} files failed:\n" + "\n".join(f"  {x}" for x in failed))
    return len(pairs)


def _local(path: str) -> str:
    """A path of this machine, or a URI, for Hadoop's file systems."""
    return path if "://" in path else f"file://{Path(path).absolute()}"


def dispatch(argv: Sequence[str], spark: SparkSession | None = None) -> Done:
    """Runs one command; errors are raised."""
    a = parser().parse_args(argv)
    read = lambda p: (spark or session()).read.parquet(p)

    def write(df, path) -> None:
        write_one(df, str(Path(path).absolute())) if getattr(a, "one_file", False) else df.write.mode("overwrite").parquet(str(path))

    if a.command == "convert":
        _converted(spark or session(), [(Path(a.src), Path(a.dest))], _layout(a))
        return Done("convert", a.preset)
    if a.command == "batch" and a.variant == "convert":
        own = _layout(a)
        pattern = own.pattern or PATTERNS[a.preset]
        found = listing.listed(a.src_dir, pattern)
        if not found:
            return Done("batch", a.preset, _nothing(pattern, a.src_dir))
        pairs = listing.targets(found, a.output_dir, "parquet")
        return Done("batch", a.preset, _converted(spark or session(), pairs, own))
    if a.command == "batch":
        found = listing.listed(a.src_dir, a.pattern)
        if not found:
            return Done("batch", f"header_{a.preset}", _nothing(a.pattern, a.src_dir))
        pairs = dict(listing.targets(found, a.output_dir, "yaml"))
        for t in pairs.values():
            t.parent.mkdir(parents=True, exist_ok=True)
        for r in netcdf.headers(spark or session(), [str(f) for f in found], a.preset).toLocalIterator():
            docs.dump(json.loads(r["doc"]), pairs[Path(r["path"])])
        return Done("batch", f"header_{a.preset}", len(pairs))
    if a.command == "header":
        docs.dump(netcdf.header(a.src, a.variant), a.dest)
        return Done("header", a.variant)
    if a.command == "concat" and a.variant == "convert":
        # a table that Spark wrote is a folder of part files; its order is that of the paths
        folders = sorted({p.parent if p.name.startswith("part-") else p for p in listing.listed(a.src_dir, "*.parquet")})
        folders = [p for p in folders if listing.fnmatchcase(p.name, a.pattern)]
        if not folders:
            return Done("concat", "convert", _nothing(a.pattern, a.src_dir))
        # one scan for all files of a schema
        kinds: dict[str, list[str]] = {}
        for p in folders:
            kinds.setdefault(listing.schema_of(p), []).append(str(p))
        tables = [(spark or session()).read.parquet(*own) for own in kinds.values()]
        write(merge(tables, not a.no_renumber, not a.no_pres_sort, a.keep_na_pres, by_path=True), a.output)
        return Done("concat", "convert", len(folders))
    if a.command == "concat":
        found = listing.listed(a.src_dir, a.pattern)
        if not found:
            return Done("concat", "header", _nothing(a.pattern, a.src_dir))
        docs.dump(docs.merge((str(f), docs.load(f)) for f in found), a.output)
        return Done("concat", "header", len(found))
    if a.command == "report":
        if a.variant == "parquet":
            rows = report(read(a.src), a.level)
            if a.format == "tsv" and a.dest and a.level != "global":
                keys = ["platform_code"] + ["profile_no"] * (a.level == "profile")
                write_lines_of(rows, tsv_line(rows), keys, _local(a.dest), "\t".join(rows.columns))
            else:
                write_report(rows, a.format, a.dest)
        elif a.variant == "yaml":
            emit(rendered(*docs.coverage_rows(docs.load(a.src)), a.format), a.dest)
        else:
            emit(page(a.stem, a.report_dir, a.out_dir, a.format, a.title, a.note), a.output)
        return Done("report", a.variant)
    if a.command == "filter":
        box = Box(a.min_lon, a.max_lon, a.min_lat, a.max_lat)
        live = spark or session()
        write(SpatialTable(live, a.src).box(box, a.mode) if is_spatial(live, a.src) else filter_box(read(a.src), box, a.mode), a.dest)
        return Done("filter", "area")
    if a.command == "region":
        pairs = dict(x.split("=", 1) if "=" in x else (Path(x).stem, x) for x in a.products)
        if len(pairs) < len(a.products):
            raise ValueError("products have stems of their own")
        Pipeline(spark or session(), a.name, a.root, _key(a)).run({stem: read(path) for stem, path in pairs.items()})
        return Done("region", a.name, len(pairs))
    if a.command == "arrange":
        SpatialTable(spark or session(), a.dest).append(read(a.src))
        return Done("arrange", "position")
    if a.command in ("dropna", "dropqc"):
        write((drop_na if a.command == "dropna" else drop_qc)(read(a.src)), a.dest)
        return Done(a.command, "profile")
    if a.command == "dedup":
        write(drop_duplicate_profiles(read(a.src), _key(a)), a.dest)
        return Done("dedup", "profile")
    if a.command == "markdup":
        # groups are found once: the table and the marks are made of the same stored rows
        df = read(a.src)
        groups = stored(duplicate_groups(profiles(df, _key(a))), "duplicate-groups")
        dups = duplicates_report(groups)
        write_lines_of(dups, duplicates_line(), ["dup_group", "platform_code", "profile_no"], _local(a.dups), "\t".join(dups.columns))
        write(marked_by(df, groups), a.dest)
        return Done("markdup", "profile")
    options = CompareOptions(_key(a), a.platform_col, "profile_no", a.time_col, a.lon_col, a.lat_col, not a.no_platform_key)
    write_report(compare(read(a.a), read(a.b), Path(a.a).stem, Path(a.b).stem, options), a.format, a.dest)
    return Done("compare", "parquet")


def main(argv: Sequence[str] | None = None) -> int:
    try:
        dispatch(sys.argv[1:] if argv is None else argv)
    except (ValueError, OSError, RuntimeError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0
