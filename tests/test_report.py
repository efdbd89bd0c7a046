from __future__ import annotations

import datetime as dt
import json
import math

import pytest
from data import DUP, NAN, REPORT, dup_rows, report_rows

from brineframe.operators.duplicates import mark_duplicates
from brineframe.plans.render import as_json, cell, number, plain, rendered, text, tsv, write_report
from brineframe.plans.report import all_levels, report


@pytest.mark.parametrize("parts", [1, 3, 17])
def test_levels(spark, parts):
    df = spark.createDataFrame(report_rows(), REPORT).repartition(parts)
    b, a = report(df, "platform").collect()
    assert (a["platform_code"], a["n_profiles"], a["n_obs"], a["time_qc_good"], a["position_qc_good"], a["na_temp"], a["temp_min"], a["temp_max"], a["temp_mean"]) == ("G", 2, 5, 1, 2, 2, 1.5, 7.5, 4.0)
    assert (a["longitude_min"], a["longitude_max"], a["latitude_min"], a["latitude_max"]) == (-12.5, -9.0, 66.0, 67.5)
    assert (b["time_qc_good"], b["position_qc_good"], b["na_temp"], b["temp_min"], b["temp_max"], b["temp_mean"]) == (1, 0, 1, None, None, None)
    (g,) = report(df, "global").collect()
    assert (g["n_platforms"], g["n_profiles"], g["n_obs"], g["na_temp"]) == (2, 3, 6, 3) and math.isclose(g["psal_mean"], 206.5 / 6)
    p = report(df, "profile")
    assert p.columns[:8] == ["platform_code", "profile_no", "profile_timestamp", "longitude", "latitude", "n_obs", "time_qc", "position_qc"]
    assert [(r["platform_code"], r["profile_no"], r["n_obs"]) for r in p.collect()] == [("C", 2, 1), ("G", 5, 2), ("G", 9, 3)]
    both = {r["platform_code"]: r["n_obs"] for r in all_levels(df).collect()}
    assert both == {None: 6, "G": 5, "C": 1}


def test_columns(spark):
    df = spark.createDataFrame(report_rows(), REPORT)
    measures = [f"{x}" for m in ("temp", "psal", "pres") for x in (f"na_{m}", f"{m}_min", f"{m}_max", f"{m}_mean")]
    geo = ["longitude_min", "longitude_max", "latitude_min", "latitude_max"]
    assert report(df, "platform").columns == ["platform_code", "n_profiles", "n_obs", "time_qc_good", "position_qc_good", *geo, *measures]
    assert report(df, "global").columns == ["n_platforms", "n_profiles", "n_obs", "time_qc_good", "position_qc_good", *geo, *measures]
    with pytest.raises(ValueError):
        report(df, "region")


def test_duplicates_are_counted(spark):
    marked, _ = mark_duplicates(spark.createDataFrame(dup_rows(), DUP))
    assert report(marked, "global").first()["dup_profiles"] == 5
    assert {r["platform_code"]: r["dup_profiles"] for r in report(marked).collect()} == {"V": 2, "W": 1, "X": 0, "Y": 2, "Z": 0}
    assert report(marked, "profile").columns[8] == "is_dup"


def test_empty_table(spark):
    df = spark.createDataFrame([], REPORT)
    assert report(df).count() == 0 and report(df, "profile").count() == 0
    g = report(df, "global").first()
    assert g["n_platforms"] == g["n_obs"] == g["na_temp"] == 0 and g["temp_mean"] is None


def test_cells():
    assert [number(x) for x in (1.0, 2.5, 0.33333, -0.00001, 1e6, NAN, 100.0)] == ["1", "2.5", "0.3333", "-0", "1000000", "", "100"]
    assert [cell(x) for x in (None, True, False, 3, "x", dt.datetime(2020, 1, 2, 3, 4, 5))] == ["", "true", "false", "3", "x", "2020-01-02T03:04:05Z"]
    assert [plain(x) for x in (22712.0, -7.2502, 1e-5, 1e17, NAN)] == ["22712", "-7.2502", "0.00001", "100000000000000000", "NaN"]


def test_formats(spark, tmp_path, capsys):
    assert tsv(["a", "b"], [[1, NAN]]) == "a\tb\n1\t\n"
    assert text(["long_name", "b"], [[1, 2.5]]) == "long_name  1\nb          2.5\n"
    assert text(["a", "bb"], [["x", 1], ["yyy", 2]]) == "a    bb\n---  --\nx    1 \nyyy  2 \n"
    out = as_json(["a", "b", "c"], [["q\"\n", NAN, None], ["é", 1.25, True]])
    assert out.endswith("]\n") and json.loads(out) == [{"a": 'q"\n', "b": None, "c": None}, {"a": "é", "b": 1.25, "c": True}]
    assert as_json(["a"], []) == "[]\n"
    with pytest.raises(ValueError):
        rendered(["a"], [], "xml")
    df = report(spark.createDataFrame(report_rows(), REPORT), "global")
    write_report(df, "tsv", tmp_path / "r.tsv")
    write_report(df, "tsv")
    assert capsys.readouterr().out == (tmp_path / "r.tsv").read_text()
    with pytest.raises(OSError):
        write_report(df, "tsv", tmp_path / "none" / "r.tsv")


def test_means_are_of_valid_values(spark):
    rows = [("A", 1, v, 1.0, 1.0, "1", "1", 1.0, 1.0, None) for v in (1.0, NAN, None, 2.0)]
    r = report(spark.createDataFrame(rows, REPORT)).first()
    assert r["na_temp"] == 2 and math.isclose(r["temp_mean"], 1.5)
