"""The sink that gives each source a file of its own."""

from __future__ import annotations

import json
from pathlib import Path

import pyarrow as pa
import pytest
from pyarrow import parquet
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType
from test_sources import nrt_file

from brineframe.cli import dispatch
from brineframe.sources import netcdf
from brineframe.sources.outputs import TARGET, _Writer, noted, write_each, write_one
from brineframe.sources.presets import PRESETS


def names(folder: Path) -> list[str]:
    return sorted(p.name for p in folder.iterdir())


def test_one_job_converts_all_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(12):
        nrt_file(tmp_path / "in" / f"AR_PR_CT_{k:02}.nc", platform=f"PL{k}")
    results = {str(tmp_path / "in" / f"AR_PR_CT_{k:02}.nc"): str(tmp_path / "out" / f"r{k}.parquet") for k in range(12)}
    spark.sparkContext.setJobGroup("converting", "")
    try:
        assert netcdf.convert_each(spark, results, PRESETS["nrt_ar"]) == []
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("converting")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) == 1
    assert names(tmp_path / "out") == sorted(f"r{k}.parquet" for k in range(12)) and all((tmp_path / "out" / n).is_file() for n in names(tmp_path / "out"))
    want = netcdf.convert(spark, [str(tmp_path / "in" / "AR_PR_CT_07.nc")], PRESETS["nrt_ar"])
    got = spark.read.parquet(str(tmp_path / "out" / "r7.parquet"))
    assert got.dtypes == want.dtypes
    assert repr(got.collect()) == repr(want.orderBy("profile_no", "observation_no").collect())
    plan = netcdf.observations(netcdf.read_profiles(spark, results, PRESETS["nrt_ar"]), PRESETS["nrt_ar"], ("target",))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_what_fails_is_left_out_and_told(spark, tmp_path):
    for k in range(3):
        nrt_file(tmp_path / f"AR_PR_CT_{k}.nc")
    (tmp_path / "AR_PR_CT_8.nc").write_bytes(b"broken")
    whole = (tmp_path / "AR_PR_CT_0.nc").read_bytes()
    (tmp_path / "AR_PR_CT_9.nc").write_bytes(whole[: len(whole) // 2])  # the header is there, the values are not
    with pytest.raises(RuntimeError, match="2 of 5 files failed(.|\n)*CT_8.nc(.|\n)*CT_9.nc"):
        dispatch(["batch", "convert", "nrt_ar", "-o", str(tmp_path / "out"), str(tmp_path)], spark)
    assert names(tmp_path / "out") == [f"AR_PR_CT_{k}.parquet" for k in range(3)]
    assert spark.read.parquet(str(tmp_path / "out")).count() == 27


def table(spark, rows):
    return spark.createDataFrame(rows, f"v long, {TARGET} string")


def test_a_job_that_fails_changes_nothing(spark, tmp_path):
    old = str(tmp_path / "a.parquet")
    write_each(table(spark, [(1, old)]))
    rows = table(spark, [(k, str(tmp_path / f"{'abc'[k % 3]}.parquet")) for k in range(3000)]).repartition(4)
    bad = rows.withColumn("v", F.when(F.col("v") == 2900, F.raise_error(F.lit("lost"))).otherwise(F.col("v")))
    with pytest.raises(Exception, match="lost"):
        write_each(bad)
    assert names(tmp_path) == ["a.parquet"] and [r["v"] for r in spark.read.parquet(old).collect()] == [1]
    with pytest.raises(Exception, match="several runs"):  # rows of one file in two partitions, said to be in order
        write_each(table(spark, [(1, old)]).union(table(spark, [(2, old)])), ordered=True)
    with pytest.raises(Exception, match="null"):
        write_each(table(spark, [(1, old), (2, None)]).coalesce(1))
    assert names(tmp_path) == ["a.parquet"]
    write_each(rows)
    assert [spark.read.parquet(str(tmp_path / f"{c}.parquet")).agg(F.count("v"), F.sum(F.col("v") % 3)).first()[:] for c in "abc"] == [(1000, 0), (1000, 1000), (1000, 2000)]


def test_two_phases(tmp_path):
    """What a killed task left goes with abort or with the commit of another try; nothing is visible before the commit."""
    schema = StructType([StructField("v", LongType()), StructField(TARGET, StringType())])
    a, b, c = (str(tmp_path / n) for n in ("a", "b", "c"))
    batch = lambda *rows: pa.RecordBatch.from_pylist([{"v": v, TARGET: t} for v, t in rows], pa.schema([("v", pa.int64()), (TARGET, pa.string())]))
    own = _Writer(schema, {"expected": json.dumps([a, b, c])})

    def killed():
        yield batch((1, a), (2, a), (3, b))
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        own.write(killed())
    assert [len(list(p.iterdir())) for p in tmp_path.iterdir()] == [0]
    left = own.write([batch((1, a))])  # finished, but the driver never heard of it
    done = own.write([batch((1, a), (2, a)), batch((3, a), (4, b))])
    assert not {"a", "b", "c"} & set(names(tmp_path)) and len(left.files) == 1
    own.commit([done, None])
    assert names(tmp_path) == ["a", "b", "c"]
    assert [parquet.read_table(p).to_pydict() for p in (a, b, c)] == [{"v": [1, 2, 3]}, {"v": [4]}, {"v": []}]
    again = _Writer(schema, {"expected": json.dumps([a])})
    again.abort([again.write([batch((9, a))]), None])
    assert names(tmp_path) == ["a", "b", "c"] and parquet.read_table(a).num_rows == 3 and noted(None) == []
    with pytest.raises(ValueError, match=TARGET):
        _Writer(StructType([StructField("v", LongType())]), {})


def test_one_file(spark, tmp_path):
    path = str(tmp_path / "x" / "all.parquet")
    write_one(spark.range(5000).repartition(7).orderBy(F.desc("id")), path)
    assert Path(path).is_file() and [r["id"] for r in spark.read.parquet(path).collect()] == list(range(4999, -1, -1))
    write_one(spark.range(0), path)
    assert spark.read.parquet(path).count() == 0 and spark.read.parquet(path).columns == ["id"]
    spark.createDataFrame([("1", "1"), ("4", "1")], "time_qc string, position_qc string").write.parquet(str(tmp_path / "in"))
    dispatch(["dropqc", "--one-file", str(tmp_path / "in"), str(tmp_path / "good.parquet")], spark)
    assert (tmp_path / "good.parquet").is_file() and spark.read.parquet(str(tmp_path / "good.parquet")).count() == 1
