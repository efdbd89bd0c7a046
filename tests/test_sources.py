from __future__ import annotations

import math
from pathlib import Path

import numpy as np
import pytest

from brineframe.sources import netcdf
from brineframe.sources.cdf import ClassicFile, write_classic
from brineframe.sources.files import largest_first, listed, targets
from brineframe.sources.presets import PRESETS, layout

FILL = np.float32(9.96921e36)


def nrt_file(path, deph=False, profile=None, n=3, depth=4, platform="PL1"):
    """Three casts of four levels; the last level of each is empty, and pressure is missing at level 2."""
    f = lambda a: np.asarray(a, np.float32)
    temp = np.arange(n * depth, dtype=np.float32).reshape(n, depth) + 1
    psal, pres = temp + 30, np.tile(f([5, FILL, 15, FILL]), (n, 1))
    temp[:, 3] = psal[:, 3] = FILL
    grid, line = ("TIME", "DEPTH"), ("TIME",)
    flags = np.tile(np.array([1, 4, -128, 9], np.int8), (n, 1))
    fill = {"_FillValue": FILL}
    variables = {
        "TIME": (line, np.array([0.0, 25567.25, np.nan])[:n], {}), "LONGITUDE": (line, f([10, 20, np.nan])[:n], {}), "LATITUDE": (line, f([60, 61, 62])[:n], {}),
        "TIME_QC": (line, np.array([1, 0, -1], np.int8)[:n], {}), "POSITION_QC": (line, np.array([1, 10, 9], np.int8)[:n], {}),
        "TEMP": (grid, temp, fill), "PSAL": (grid, psal, fill), "PRES": (grid, pres, fill), "TEMP_QC": (grid, flags, {}), "PRES_QC": (grid, flags, {}),
    }
    if deph:
        variables["DEPH"] = (grid, np.tile(f([FILL, 10, 20, FILL]), (n, 1)), fill)
        variables["DEPH_QC"] = (grid, np.tile(np.array([0, 2, 3, 0], np.int8), (n, 1)), {})
    if profile == "precise":
        variables |= {"PRECISE_LONGITUDE": (line, f([11, np.nan, 13])[:n], {}), "PRECISE_LATITUDE": (line, f([59, 58, np.nan])[:n], {})}
    dims = {"TIME": n, "DEPTH": depth}
    if profile == "deploy":
        dims["DEPLOYMENT"] = 2
        variables |= {"DEPLOYMENT": (("DEPLOYMENT",), np.array([0, 2], np.int32), {}), "DEPLOY_LONGITUDE": (("DEPLOYMENT",), f([1, 2]), {}), "DEPLOY_LATITUDE": (("DEPLOYMENT",), f([51, 52]), {})}
    write_classic(path, dims, variables, {"platform_code": platform, "title": "casts", "data_mode": "R"})


def cora_file(path, legacy=False):
    chars = np.array([list("AB 1\0\0"), list("CD\0\0\0\0")], "S1")
    row, grid = ("N_PROF",), ("N_PROF", "N_LEVELS")
    temp = np.array([[1, 2], [3, FILL]], np.float32)
    flags = np.array([[b"1", b"A"], [b" ", b"\0"]], "S1") if legacy else np.array([[1, 2], [11, 0]], np.int8)
    fill = {"_FillValue": FILL}
    variables = {
        "PLATFORM_NUMBER": (("N_PROF", "STRING32"), chars, {}), "JULD" if legacy else "TIME": (row, np.array([1.5, 2.0]), {}), "LONGITUDE": (row, np.array([1.0, 2.0]), {}), "LATITUDE": (row, np.array([40.0, 41.0]), {}),
        "TEMP": (grid, temp, fill), "TEMP_QC": (grid, flags, {}), "PRES": (grid, np.array([[10, FILL], [FILL, FILL]], np.float32), fill),
    }
    if not legacy:
        variables |= {"TIME_QC": (row, np.array([1, 2], np.int8), {}), "POSITION_QC": (row, np.array([3, 4], np.int8), {}), "DEPH": (grid, np.array([[FILL, 20], [30, 40]], np.float32), fill)}
    write_classic(path, {"N_PROF": 2, "N_LEVELS": 2, "STRING32": 6}, variables)


def test_classic_files_read_back(tmp_path):
    nrt_file(tmp_path / "a.nc")
    f = ClassicFile(tmp_path / "a.nc")
    assert f.dimensions == {"TIME": 3, "DEPTH": 4} and f.attributes["platform_code"] == "PL1"
    assert f.variables["TEMP"].type_name == "Float(F32)" and f.variables["TEMP"].dims == ("TIME", "DEPTH")
    assert f.read("TEMP", 1, 3)[:, 0].tolist() == [5.0, 9.0] and f.read("TIME_QC").tolist() == [1, 0, -1]
    (tmp_path / "b.nc").write_bytes(b"\x89HDF\r\n\x1a\n")
    with pytest.raises(ValueError):
        ClassicFile(tmp_path / "b.nc")


def test_record_variables(tmp_path):
    """Rows of several record variables alternate in the file, each padded to four bytes."""
    import struct

    text = lambda s: struct.pack(">i", len(s)) + s.encode() + b"\0" * (-len(s) % 4)
    head = b"CDF\x01" + struct.pack(">i", 3) + struct.pack(">ii", 10, 1) + text("t") + struct.pack(">i", 0) + struct.pack(">ii", 0, 0) + struct.pack(">ii", 11, 2)
    var = lambda name, kind, size, begin: text(name) + struct.pack(">ii", 1, 0) + struct.pack(">ii", 0, 0) + struct.pack(">iii", kind, size, begin)
    begin = len(head) + 2 * len(var("a", 3, 4, 0))
    body = b"".join(struct.pack(">hxx", k) + struct.pack(">d", k / 2) for k in range(3))
    (tmp_path / "r.nc").write_bytes(head + var("a", 3, 4, begin) + var("b", 6, 8, begin + 4) + body)
    f = ClassicFile(tmp_path / "r.nc")
    assert f.dimensions == {"t": 3} and f.read("a").tolist() == [0, 1, 2] and f.read("b", 1, 3).tolist() == [0.5, 1.0]


def test_nrt(spark, tmp_path):
    nrt_file(tmp_path / "X_1.nc")
    df = netcdf.convert(spark, [str(tmp_path / "X_1.nc")], PRESETS["nrt_ar"])
    assert tuple(df.columns) == netcdf.OBSERVATIONS
    rows = df.orderBy("profile_no", "observation_no").collect()
    assert [(r["profile_no"], r["observation_no"]) for r in rows] == [(p, o) for p in (1, 2, 3) for o in (1, 2, 3)]
    a, b, c = rows[:3]
    assert (a["platform_code"], a["filename"], a["time_qc"], a["position_qc"], a["temp"], a["temp_qc"], a["pres"], a["pres_qc"], a["pres_conv"]) == ("PL1", "X_1", "1", "1", 1.0, "1", 5.0, "1", 0)
    assert a["deph"] == pytest.approx(4.96, abs=0.05) and a["deph_conv"] == 1 and a["deph_qc"] == "1"
    assert math.isnan(b["pres"]) and math.isnan(b["deph"]) and b["temp_qc"] == "4" and c["temp_qc"] == "" and b["psal_qc"] == ""
    assert str(rows[3]["profile_timestamp"]) == "2020-01-01 06:00:00" and rows[3]["position_qc"] == "" and rows[6]["position_qc"] == "9"
    assert math.isnan(rows[6]["longitude"]) and math.isnan(rows[6]["profile_time"]) and str(rows[6]["profile_timestamp"]) == "1950-01-01 00:00:00"
    assert math.isnan(a["profile_longitude"])


def test_nrt_with_depth(spark, tmp_path):
    nrt_file(tmp_path / "a.nc", deph=True)
    for preset in ("nrt_gl", "nrt_ar"):  # depth is found without being announced
        rows = netcdf.convert(spark, [str(tmp_path / "a.nc")], PRESETS[preset]).orderBy("profile_no", "observation_no").collect()
        assert rows[1]["pres"] == pytest.approx(10.08, abs=0.05) and (rows[1]["pres_qc"], rows[1]["pres_conv"], rows[1]["deph"], rows[1]["deph_conv"]) == ("2", 1, 10.0, 0)
        assert (rows[0]["deph_conv"], rows[0]["deph_qc"], rows[2]["deph"]) == (1, "1", 20.0)


@pytest.mark.parametrize("profile, want", [("precise", [(10, 60, 11, 59), (20, 61, 20, 58), (13, 62, 13, 62)]), ("deploy", [(10, 60, 1, 51), (20, 61, 1, 51), (2, 62, 2, 52)]), (None, [(10, 60, 10, 60), (20, 61, 20, 61), (NAN := float("nan"), 62, NAN, 62)])])
def test_profile_coordinates(spark, tmp_path, profile, want):
    nrt_file(tmp_path / "a.nc", profile=profile)
    df = netcdf.convert(spark, [str(tmp_path / "a.nc")], PRESETS["nrt_bo"]).where("observation_no = 1").orderBy("profile_no")
    got = [tuple(r) for r in df.select("longitude", "latitude", "profile_longitude", "profile_latitude").collect()]
    assert repr(got) == repr([tuple(map(float, w)) for w in want])


def test_cora(spark, tmp_path):
    cora_file(tmp_path / "c.nc")
    rows = netcdf.convert(spark, [str(tmp_path / "c.nc")], PRESETS["cora"]).orderBy("profile_no", "observation_no").collect()
    assert [(r["platform_code"], r["profile_no"], r["observation_no"]) for r in rows] == [("AB1", 1, 1), ("AB1", 1, 2), ("CD", 2, 1), ("CD", 2, 2)]
    assert [r["temp_qc"] for r in rows] == ["1", "2", "", "0"] and [r["time_qc"] for r in rows] == ["1", "1", "2", "2"]
    assert rows[1]["pres_conv"] == 1 and rows[0]["deph_conv"] == 1 and rows[3]["pres"] > 40 and math.isnan(rows[3]["temp"]) and math.isnan(rows[0]["psal"])


def test_cora_legacy(spark, tmp_path):
    cora_file(tmp_path / "c.nc", legacy=True)
    rows = netcdf.convert(spark, [str(tmp_path / "c.nc")], PRESETS["cora_legacy"]).orderBy("profile_no", "observation_no").collect()
    assert [(r["profile_no"], r["observation_no"], r["temp_qc"]) for r in rows] == [(1, 1, "1"), (1, 2, "A"), (2, 1, "")]
    assert str(rows[0]["profile_timestamp"]) == "1950-01-02 12:00:00" and rows[0]["time_qc"] == "" and math.isnan(rows[1]["deph"])


def test_slices_do_not_matter(spark, tmp_path, monkeypatch):
    nrt_file(tmp_path / "a.nc", deph=True, profile="deploy")
    nrt_file(tmp_path / "b.nc", platform="PL2")
    files = [str(tmp_path / f) for f in ("a.nc", "b.nc")]
    want = sorted(map(repr, netcdf.convert(spark, files, PRESETS["nrt_bo"]).collect()))
    reader = netcdf._Reader({"files": '["%s"]' % files[0]})
    rows = lambda part: [r for batch in reader.read(part) for r in batch.to_pylist()]
    (one,) = reader.partitions()
    whole = rows(one)
    monkeypatch.setattr(netcdf, "SLICE_BYTES", 100)
    monkeypatch.setattr(netcdf, "BATCH", 2)
    assert len(reader.partitions()) > 3 and [r["n"] for r in whole] == [0, 1, 2]
    assert repr([r for p in reader.partitions() for r in rows(p)]) == repr(whole) and len(want) == 18


def test_files_that_only_spark_opens(spark, tmp_path):
    """Through a path that is a mount of Hadoop's, and no file for Python: the same rows, and files of their own."""
    (tmp_path / "in").mkdir()
    nrt_file(tmp_path / "in" / "a.nc", deph=True, profile="deploy")
    nrt_file(tmp_path / "in" / "b.nc", platform="PL2", n=2)
    (tmp_path / "in" / "c.nc").write_bytes(b"broken")
    spark.sparkContext._jsc.hadoopConfiguration().set(f"fs.viewfs.mounttable.{tmp_path.name}.link./in", f"file://{tmp_path}/in")
    far, near = ([f"{top}/{n}.nc" for n in "ab"] for top in (f"viewfs://{tmp_path.name}/in", tmp_path / "in"))
    got, want = (sorted(map(repr, netcdf.convert(spark, files, PRESETS["nrt_bo"]).collect())) for files in (far, near))
    assert got == want and len(got) == 15
    results = {f"viewfs://{tmp_path.name}/in/{n}.nc": str(tmp_path / "out" / f"{n}.parquet") for n in "abc"}
    (failed,) = netcdf.convert_each(spark, results, PRESETS["nrt_bo"])
    assert "c.nc: " in failed and sorted(p.name for p in (tmp_path / "out").iterdir()) == ["a.parquet", "b.parquet"]
    assert sorted(map(repr, spark.read.parquet(str(tmp_path / "out")).collect())) == want


def test_headers(spark, tmp_path):
    nrt_file(tmp_path / "a.nc")
    own = netcdf.header(tmp_path / "a.nc")["a"]
    assert own["global_attributes"] == {"title": "casts", "platform_code": "PL1", "platform_name": "", "time_coverage_start": "", "data_mode": "R"}
    assert own["dimensions"] == {"TIME": 3, "DEPTH": 4} and own["variables"]["TEMP"] == {"data_type": "Float(F32)", "dimensions": ["TIME", "DEPTH"]}
    assert netcdf.header(tmp_path / "a.nc", "cora")["a"]["global_attributes"] == {}
    assert netcdf.headers(spark, [str(tmp_path / "a.nc")]).count() == 1


def test_layouts(tmp_path):
    assert layout("nrt_bo").has_profile_coords and not layout("nrt_bo", has_profile_coords=False).has_profile_coords
    (tmp_path / "c.toml").write_text('time_var = "T"\nqc_type = "Char"\nhas_time_qc = false\nhas_deph_source = false\n')
    own = layout("cora", tmp_path / "c.toml", has_deph_source=True)
    assert (own.time_var, own.qc_type, own.has_time_qc, own.has_deph_source, own.pattern) == ("T", "Char", False, True, None)
    (tmp_path / "d.toml").write_text("has_deph_source = true\n")
    with pytest.raises(ValueError, match="has_profile_coords"):
        layout("nrt_ar", tmp_path / "d.toml")
    with pytest.raises(ValueError):
        layout("argo")


def test_files(tmp_path):
    for name, size in (("x/AR_1.nc", 5), ("y/AR_2.nc", 9), ("y/BO_1.nc", 1), ("AR_3.txt", 1)):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"." * size)
    found = listed(tmp_path, "AR_*.nc")
    assert [p.name for p in found] == ["AR_1.nc", "AR_2.nc"] and listed(tmp_path, "zz*") == []
    assert [Path(p).name for p in largest_first(found)] == ["AR_2.nc", "AR_1.nc"]
    assert targets(found, None, "parquet")[0][1] == tmp_path / "x" / "AR_1.parquet"
    (tmp_path / "y" / "AR_1.nc").write_bytes(b"")
    with pytest.raises(ValueError, match="duplicate"):
        targets(listed(tmp_path, "AR_*.nc"), tmp_path / "out", "yaml")
    with pytest.raises(NotADirectoryError):
        listed(tmp_path / "none", "*")
