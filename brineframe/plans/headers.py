"""Header documents: what the source files hold, merged and summarised."""

from __future__ import annotations

from collections.abc import Iterable
from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The variables that every product is expected to have.
CORE = ("TEMP", "PSAL", "PRES", "DEPH")
FLAGS = {"has_temp": "TEMP", "has_psal": "PSAL", "has_pres": "PRES", "has_deph": "DEPH", "has_time_qc": "TIME_QC", "has_position_qc": "POSITION_QC"}
NRT_ATTRIBUTES = ("title", "platform_code", "platform_name", "time_coverage_start", "data_mode")
SCHEMA = "map<string,struct<global_attributes:map<string,string>,dimensions:map<string,bigint>,variables:map<string,struct<data_type:string,dimensions:array<string>>>>>"


def load(path: str | Path) -> dict:
    try:
        doc = yaml.safe_load(Path(path).read_text())
    except OSError as e:
        raise OSError(f"cannot read {path}: {e}") from e
    except yaml.YAMLError as e:
        raise ValueError(f"cannot parse {path}: {e}") from e
    if not isinstance(doc, dict):
        raise ValueError(f"{path}: expected a mapping at the top")
    return doc


def dump(doc: dict, path: str | Path) -> None:
    """Keys are sorted, so equal documents make equal files."""
    Path(path).write_text(yaml.safe_dump(doc, sort_keys=True, allow_unicode=True))


def merge(docs: Iterable[tuple[str, dict]]) -> dict:
    """One document from several; a file that two of them hold is an error."""
    out, origin, clashes = {}, {}, []
    for name, doc in docs:
        for key, value in doc.items():
            if key in out:
                clashes.append(f"  {key!r} in {origin[key]} and {name}")
            out[key], origin[key] = value, name
    if clashes:
        raise ValueError("duplicate files in headers:\n" + "\n".join(clashes))
    return out


def extra_parameters(variables: dict | None) -> list[str]:
    """Float variables on (TIME, DEPTH) that are neither core nor flags, sorted."""
    return sorted(
        name
        for name, v in (variables or {}).items()
        if isinstance(name, str) and not name.endswith("_QC") and name not in CORE and isinstance(v, dict) and str(v.get("data_type", "")).startswith("Float") and list(v.get("dimensions") or []) == ["TIME", "DEPTH"]
    )


def coverage_rows(doc: dict) -> tuple[list[str], list[list]]:
    """Names and rows of the report on a header document: one row per file."""
    rows = []
    for key, value in doc.items():
        variables = (value or {}).get("variables") if isinstance(value, dict) else None
        rows.append([key if isinstance(key, str) else "", *((variables or {}).get(v) is not None or v in (variables or {}) for v in FLAGS.values()), ";".join(extra_parameters(variables))])
    return ["filename", *FLAGS, "extra_params"], rows


def coverage(headers: DataFrame) -> DataFrame:
    """The same report for many documents at once: ``headers`` has a column doc of type ``SCHEMA``."""
    each = headers.select(F.explode("doc").alias("filename", "h"))
    extra = F.filter(
        F.map_entries("h.variables"),
        lambda e: ~e["key"].endswith("_QC") & ~e["key"].isin(*CORE) & e["value"]["data_type"].startswith("Float") & (e["value"]["dimensions"] == F.array(F.lit("TIME"), F.lit("DEPTH"))),
    )
    names = F.array_sort(F.transform(extra, lambda e: e["key"]))
    flags = [F.coalesce(F.map_contains_key("h.variables", v), F.lit(False)).alias(c) for c, v in FLAGS.items()]
    return each.select("filename", *flags, F.coalesce(F.array_join(names, ";"), F.lit("")).alias("extra_params"))


def read_headers(spark: SparkSession, path: str, pattern: str = "*.yaml") -> DataFrame:
    """Header documents under a folder, a row each, parsed on the executors."""
    import json

    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path, wholetext=True)

    def parse(batches):
        import pandas as pd

        for batch in batches:
            yield pd.DataFrame({"js": [json.dumps(yaml.safe_load(x), default=str) for x in batch["value"]]})

    return files.mapInPandas(parse, "js string").select(F.from_json("js", SCHEMA).alias("doc"))
