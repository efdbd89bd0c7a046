from __future__ import annotations

import pytest
from data import COMPARE, DUP, NA, QC, REPORT, compare_a, compare_b, dup_rows, na_rows, qc_rows, report_rows
from test_sources import cora_file, nrt_file

from brineframe.cli import dispatch
from brineframe.plans.regions import Pipeline


def put(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(path))
    return str(path)


def test_convert_and_batch(spark, tmp_path):
    nrt_file(tmp_path / "AR_PR_CT_1.nc")
    cora_file(tmp_path / "c.nc")
    assert dispatch(["convert", "nrt_ar", str(tmp_path / "AR_PR_CT_1.nc"), str(tmp_path / "one.parquet")], spark).target == "nrt_ar"
    assert spark.read.parquet(str(tmp_path / "one.parquet")).count() == 9
    dispatch(["convert", "cora", "--no-deph-source", str(tmp_path / "c.nc"), str(tmp_path / "two.parquet")], spark)
    assert spark.read.parquet(str(tmp_path / "two.parquet")).where("deph_conv = 0 and not isnan(deph)").count() == 0
    (tmp_path / "in").mkdir()
    nrt_file(tmp_path / "in" / "AR_PR_CT_2.nc")
    assert dispatch(["batch", "convert", "nrt_ar", "-o", str(tmp_path / "out"), str(tmp_path)], spark).count == 2
    assert spark.read.parquet(str(tmp_path / "out" / "AR_PR_CT_2.parquet")).count() == 9
    assert dispatch(["batch", "convert", "nrt_gl", str(tmp_path)], spark).count == 0
    (tmp_path / "in" / "AR_PR_CT_3.nc").write_bytes(b"broken")
    with pytest.raises(RuntimeError, match="1 of 3 files failed"):
        dispatch(["batch", "convert", "nrt_ar", "-o", str(tmp_path / "out2"), str(tmp_path)], spark)
    with pytest.raises(ValueError, match="duplicate"):
        nrt_file(tmp_path / "in" / "AR_PR_CT_1.nc")
        dispatch(["batch", "convert", "nrt_ar", "-o", str(tmp_path / "out3"), str(tmp_path)], spark)


def test_headers(spark, tmp_path, capsys):
    nrt_file(tmp_path / "a.nc")
    nrt_file(tmp_path / "b.nc")
    dispatch(["header", "nrt", str(tmp_path / "a.nc"), str(tmp_path / "a.yml")], spark)
    assert dispatch(["batch", "header", "nrt", "-o", str(tmp_path / "h"), str(tmp_path)], spark).count == 2
    assert dispatch(["concat", "header", str(tmp_path / "h"), str(tmp_path / "all.yaml")], spark).count == 2
    dispatch(["report", "yaml", str(tmp_path / "all.yaml")], spark)
    assert capsys.readouterr().out.splitlines()[1].split("\t")[:3] == ["a", "true", "true"]
    with pytest.raises(ValueError, match="duplicate"):
        dispatch(["header", "nrt", str(tmp_path / "a.nc"), str(tmp_path / "h" / "again.yaml")], spark)
        dispatch(["concat", "header", str(tmp_path / "h"), str(tmp_path / "none.yaml")], spark)


def test_cleaning_and_reports(spark, tmp_path, capsys):
    qc, na, dup, rep = (put(spark, tmp_path / n, r, s) for n, r, s in (("qc", qc_rows(), QC), ("na", na_rows(), NA), ("dup.parquet", dup_rows(), DUP), ("rep", report_rows(), REPORT)))
    for command, src, n in (("dropqc", qc, 9), ("dropna", na, 5), ("dedup", dup, 11)):
        dispatch([command, src, str(tmp_path / f"{command}.out")], spark)
        assert spark.read.parquet(str(tmp_path / f"{command}.out")).count() == n
    dispatch(["filter", "--min-lon", "-8", "--max-lon", "0", "--min-lat", "58", "--max-lat", "59", dup, str(tmp_path / "f")], spark)
    assert spark.read.parquet(str(tmp_path / "f")).count() == 5
    dispatch(["markdup", "--decimals", "3", dup, str(tmp_path / "m"), str(tmp_path / "m.tsv")], spark)
    assert len((tmp_path / "m.tsv").read_text().splitlines()) == 6
    dispatch(["report", "parquet", "--level", "global", "--format", "text", rep], spark)
    assert "n_platforms" in capsys.readouterr().out
    with pytest.raises(ValueError):
        dispatch(["filter", "--min-lon", "5", "--max-lon", "-5", "--min-lat", "0", "--max-lat", "1", dup, str(tmp_path / "g")], spark)
    with pytest.raises(SystemExit):
        dispatch(["unknown"], spark)


def test_compare_and_concat(spark, tmp_path, capsys):
    a, b = put(spark, tmp_path / "t" / "a.parquet", compare_a(), COMPARE), put(spark, tmp_path / "t" / "b.parquet", compare_b(), COMPARE)
    dispatch(["compare", a, b], spark)
    assert capsys.readouterr().out.splitlines()[1].split("\t")[:5] == ["b", "a", "2", "1", "50"]
    dispatch(["compare", "--no-platform-key", a, b, str(tmp_path / "c.tsv")], spark)
    assert (tmp_path / "c.tsv").read_text().splitlines()[1].split("\t")[7] == "3"
    assert dispatch(["concat", "convert", str(tmp_path / "t"), str(tmp_path / "all.parquet")], spark).count == 2
    assert spark.read.parquet(str(tmp_path / "all.parquet")).count() == 30
    c = put(spark, tmp_path / "t" / "c.parquet", compare_b(), COMPARE.replace("longitude double", "longitude float"))
    assert dispatch(["concat", "convert", "--no-renumber", str(tmp_path / "t"), str(tmp_path / "three.parquet")], spark).count == 3
    merged = spark.read.parquet(str(tmp_path / "three.parquet"))
    assert merged.count() == 30 + spark.read.parquet(c).count() and dict(merged.dtypes)["longitude"] == "double"
    assert dispatch(["concat", "convert", "--pattern", "zz*", str(tmp_path / "t"), str(tmp_path / "none")], spark).count == 0


def test_pipeline(spark, tmp_path):
    def product(casts):
        from data import day

        return spark.createDataFrame([(p, n, k, 25567.0, day("2020-01-01"), lon, lat, 1.0, 2.0, 3.0, "1", q, "1") for p, n, size, lon, lat, q in casts for k in range(size)], DUP)

    a = product([("A", 1, 2, 10.0, 70.0, "1"), ("B", 1, 3, 10.0, 70.0, "1"), ("C", 1, 1, 10.0, 50.0, "1"), ("D", 1, 1, 11.0, 71.0, "4")])
    b = product([("B", 1, 3, 10.0, 70.0, "1")])
    pages = Pipeline(spark, "arctic", tmp_path).run({"one": a, "two": b})
    assert "| Profiles | 4 |" in pages["one"] and "| Profiles | 3 | 75.0% | 25.0% |" in pages["one"] and "| Profiles | 1 | 25.0% | 75.0% | 2 | 50.0% | 50.0% |" in pages["one"]
    assert "| two | 1 | 100.0% | 1 | 100.0% | 1 | 0 | 100.0% |" in pages["one"]
    assert Pipeline(spark, "baltic", tmp_path).run({}) == {}
    b.write.parquet(str(tmp_path / "b.parquet"))
    assert dispatch(["region", "arctic", "--root", str(tmp_path / "again"), f"two={tmp_path / 'b.parquet'}"], spark).count == 1
    assert "| Profiles | 1 |" in (tmp_path / "again" / "summary" / "two.md").read_text()
    with pytest.raises(ValueError, match="stems"):
        dispatch(["region", "arctic", "x=1", "x=2"], spark)
