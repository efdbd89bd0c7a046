from __future__ import annotations

import json

import pytest
import yaml

from brineframe.plans import headers
from brineframe.plans.pages import blocks, escaped, html, page, whole

VAR = {"data_type": "Float(F32)", "dimensions": ["TIME", "DEPTH"]}
DOC = {
    "FILE_A": {"global_attributes": {}, "dimensions": {"TIME": 1}, "variables": {"TEMP": VAR, "PSAL": VAR, "PRES": VAR}},
    "FILE_B": {"variables": {"TEMP": VAR, "TUR3": VAR, "DOXY": VAR, "DOXY_QC": VAR, "TIME_QC": VAR, "POSITION_QC": VAR, "NAME": {"data_type": "Char", "dimensions": ["TIME", "DEPTH"]}, "FLAT": {"data_type": "Float(F32)", "dimensions": ["TIME"]}}},
    "FILE_C": None,
}


def test_header_report(spark):
    names, rows = headers.coverage_rows(DOC)
    assert names == ["filename", "has_temp", "has_psal", "has_pres", "has_deph", "has_time_qc", "has_position_qc", "extra_params"]
    assert rows == [["FILE_A", True, True, True, False, False, False, ""], ["FILE_B", True, False, False, False, True, True, "DOXY;TUR3"], ["FILE_C", *[False] * 6, ""]]
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(json.dumps({k: v for k, v in DOC.items() if v}),)], "js string").select(F.from_json("js", headers.SCHEMA).alias("doc"))
    assert sorted(map(list, headers.coverage(df).collect())) == rows[:2]


def test_header_documents(spark, tmp_path):
    (tmp_path / "in").mkdir()
    headers.dump({"b": {"variables": {}}, "a": {"variables": {"TEMP": VAR}}}, tmp_path / "in" / "one.yaml")
    assert list(yaml.safe_load((tmp_path / "in" / "one.yaml").read_text())) == ["a", "b"]
    one = headers.load(tmp_path / "in" / "one.yaml")
    assert headers.merge([("x", one), ("y", {"c": {}})]).keys() == {"a", "b", "c"}
    with pytest.raises(ValueError, match="'a' in x and y"):
        headers.merge([("x", one), ("y", {"a": {}})])
    (tmp_path / "list.yaml").write_text("- 1\n")
    (tmp_path / "bad.yaml").write_text("a: [")
    for bad in ("list.yaml", "bad.yaml"):
        with pytest.raises(ValueError):
            headers.load(tmp_path / bad)
    with pytest.raises(OSError):
        headers.load(tmp_path / "none.yaml")
    assert headers.coverage(headers.read_headers(spark, str(tmp_path / "in"))).where("has_temp").count() == 1


def put(root, path, header, *rows):
    (root / path).parent.mkdir(parents=True, exist_ok=True)
    (root / path).write_text("\n".join("\t".join(map(str, r)) for r in [header, *rows]) + "\n")


COUNTS = ["platform_code", "n_profiles", "n_obs", "time_qc_good"]


@pytest.fixture
def tree(tmp_path):
    r = tmp_path / "report"
    put(r, "header/s.yaml.tsv", ["filename", "has_temp", "has_psal", "extra_params"], ["a", "true", "true", "FLU2"], ["b", "true", "false", "DOXY;FLU2"])
    geo = ["longitude_min", "longitude_max", "latitude_min", "latitude_max"]
    put(r, "convert/s.parquet.tsv", COUNTS + geo, ["A", 150, 1500, 0, -10, 20, 50, 60.5], ["B", 50, 1000, 0, -12.25, "", 49, 61])
    put(r, "clean/dropqc/s.parquet.tsv", COUNTS, ["A", 100, 1200, 0])
    put(r, "clean/filter/s.parquet.tsv", COUNTS + geo, ["A", 80, 800, 0, -5, 5, 51, ""])
    put(r, "dedup/markdup/s.parquet.tsv", [*COUNTS, "dup_profiles"], ["A", 80, 800, 0, 12])
    put(r, "dedup/dedup/s.parquet.tsv", COUNTS, ["A", 73, 700, 0])
    dups = [(g, p, n, 1) for g, ps in enumerate(["AA", "AB", "CCC", "D" * 12]) for n, p in enumerate(ps)]
    put(tmp_path / "output", "dedup/markdup/s.dups.tsv", ["dup_group", "platform_code", "profile_no", "n_obs"], *dups)
    names = ["reference", "compared", "ref_platforms", "common_platforms", "platform_cov_pct", "ref_profiles", "ref_unkeyed_profiles", "matched_profiles", "profile_cov_pct", "same_nobs", "diff_nobs", "nobs_agree_pct", "ref_observations"]
    put(r, "compare/x.tsv", names, ["s", "z", 4, 1, 999, 200, 3, 100, 999, 25, 75, 999, 5000], ["z", "s", 1, 1, 999, 1, 0, 1, 999, 1, 0, 999, 1])
    put(r, "compare/y.tsv", names, ["s", "b", 4, 2, 999, 200, 3, 50, 999, 50, 0, 999, 5000])
    return tmp_path


def build(tree, **more):
    return page("s", tree / "report", tree / "output", **more)


def test_markdown(tree):
    out = build(tree, notes=["first", "second"])
    for line in (
        "# Summary: s", "> first", "> second", "## File summary", "| Files | 2 |  |", "| with PSAL | 1 | 50.0% |", "| with TIME_QC | 0 | 0.0% |", "| Extra parameters | DOXY, FLU2 |  |", "## Conversion", "| Profiles | 200 |",
        "### Drop bad QC", "| Profiles | 100 | 50.0% | 50.0% |", "### Filter by region", "| Profiles | 80 | 40.0% | 60.0% |", "| Longitude min | -5.000 | -12.250 |", "| Latitude max |  | 61.000 |", "## Deduplication",
        "| Duplicate profiles | 12 | 6.0% |  | 80 | 15.0% |  |", "| Profiles | 73 | 36.5% | 63.5% | 80 | 91.2% | 8.8% |", "**Duplicates within a platform**", "| Duplicate profiles | 17 | 89.5% |", "| Duplicate profiles | 2 | 10.5% |",
        "| 2 | 2 | 4 | 21.1% |", "| 3 | 1 | 3 | 15.8% |", "| 11+ | 1 | 12 | 63.2% |", "## Comparison", "| Profiles without a key | 3 |", "| b | 2 | 50.0% | 50 | 25.0% | 50 | 0 | 100.0% |", "| z | 1 | 25.0% | 100 | 50.0% | 25 | 75 | 25.0% |",
        "| Observations | 2,500 |", "| --- | --- |",
    ):
        assert line in out, line
    assert "999" not in out and out.index("| b |") < out.index("| z |") and "Drop all-NA" not in out
    titles = [what for kind, what in blocks("s", tree / "report", tree / "output") if isinstance(kind, int)]
    assert titles == ["File summary", "Conversion", "Cleaning", "Drop bad QC", "Filter by region", "Deduplication", "Mark duplicates", "Remove duplicates", "Comparison"]


def test_without_reports(tmp_path):
    assert "No section source files were found" in page("none", tmp_path, tmp_path)
    assert "No section source files were found" in page("none", tmp_path, tmp_path, "html")


def test_baseline_is_the_earliest_stage(tmp_path):
    put(tmp_path, "dedup/dedup/s.parquet.tsv", COUNTS, ["A", 5, 50, 0])
    out = page("s", tmp_path, tmp_path)
    assert "| Profiles | 5 | 100.0% | 0.0% |" in out and "Cleaned" not in out


def test_html(tree):
    out = build(tree, fmt="html", title="a < b & c", notes=["x > y"])
    assert "<h1>a &lt; b &amp; c</h1>" in out and "x &gt; y" in out and "<h3>Drop bad QC</h3>" in out and "<td>91.2%</td>" in out and out.count("<table>") == out.count("</table>")
    assert escaped('"<&>"') == '"&lt;&amp;&gt;"' and html("t", [], []).startswith("<!DOCTYPE html>")
    with pytest.raises(ValueError):
        build(tree, fmt="pdf")


def test_counts_are_read_leniently():
    assert [whole(x) for x in ("12", " 3.6 ", "", "x", None, "-4", "nan")] == [12, 4, 0, 0, 0, 0, 0]
