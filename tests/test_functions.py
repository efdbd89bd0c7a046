from __future__ import annotations

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from brineframe.functions import grids, qc, teos10, times
from brineframe.functions.keys import KeyOptions, scaled, time_key
from brineframe.functions.missing import require

NAN = float("nan")


def values(spark, data, schema, *columns):
    out = spark.createDataFrame(data, schema).select(*columns).collect()
    return [r[0] if len(columns) == 1 else tuple(r) for r in out]


def test_flags(spark):
    data = [(x,) for x in (0, 1, 5, 9, -128, -1, 10, 100, None)]
    assert values(spark, data, "i int", qc.flag_from_int(F.col("i"))) == ["0", "1", "5", "9", "", "", "", "", ""]
    assert values(spark, [("1",), (" ",), ("\0",), ("A",), (None,)], "c string", qc.flag_from_char(F.col("c"))) == ["1", "", "", "A", ""]
    assert values(spark, [("AB 12  \0\0",), ("",)], "c string", qc.packed_text(F.col("c"))) == ["AB12", ""]
    got = values(spark, [(1.0,), (99.0,), (None,), (NAN,)], "v float", qc.float_or_nan(F.col("v"), 99.0))
    assert got[0] == 1.0 and all(math.isnan(x) for x in got[1:])


def test_days(spark):
    data = [(0.0,), (0.5,), (25567.25,), (-1.5,), (1.000011,), (NAN,), (None,), (1e300,)]
    stamps = values(spark, data, "d double", times.days_to_timestamp(F.col("d")))
    assert stamps[:7] == [dt.datetime(1950, 1, 1), dt.datetime(1950, 1, 1, 12), dt.datetime(2020, 1, 1, 6), dt.datetime(1949, 12, 30, 12), dt.datetime(1950, 1, 2), dt.datetime(1950, 1, 1), dt.datetime(1950, 1, 1)]
    ms = values(spark, data[:7], "d double", times.days_to_ms(F.col("d")))
    assert ms == [-631_152_000_000, -631_108_800_000, 1_577_858_400_000, -631_281_600_000, -631_065_599_050, None, None]


def test_truncation_and_rounding_may_fall_on_different_days(spark):
    d = 25567 + (86400 - 0.0003) / 86400
    stamp, ms = values(spark, [(d,)], "d double", times.days_to_timestamp(F.col("d")), times.days_to_ms(F.col("d")))[0]
    assert stamp == dt.datetime(2020, 1, 1, 23, 59, 59) and ms == 1_577_923_200_000


def test_patterns(spark):
    assert times.date_pattern("%Y-%m-%d") == "yyyy'-'MM'-'dd"
    got = values(spark, [(1_577_858_461_000,)], "ms long", *(time_key(F.col("ms"), KeyOptions(f)) for f in ("%Y-%m-%d", "%H:%M:%S", "100%% it's %j")))
    assert got == [("2020-01-01", "06:01:01", "100% it's 001")]
    import datetime as dt

    when = dt.datetime(2021, 11, 7, 15, 4, 9, 250_000)
    for f in ("%a %A %b %h %B", "%I:%M %p", "%D %R %X %x", "%y%j%n%t%%"):
        assert values(spark, [(int(when.replace(tzinfo=dt.timezone.utc).timestamp() * 1000),)], "ms long", time_key(F.col("ms"), KeyOptions(f))) == [when.strftime(f)]
    assert values(spark, [(1_577_858_461_250,)], "ms long", time_key(F.col("ms"), KeyOptions("%S.%3f %Z%z"))) == ["01.250 UTC+0000"]
    for bad in ("%Q", "%", "%Y-%"):
        with pytest.raises(ValueError):
            times.date_pattern(bad)


def test_rounding_of_coordinates(spark):
    data = [(x,) for x in (10.0005, 2.0005, -2.0005, 1.2344, 1.2346, -1.2346, 0.0)]
    got = {m: values(spark, data, "v double", scaled(F.col("v"), KeyOptions(round_mode=m))) for m in ("round", "floor", "ceil", "trunc")}

    def away(x):
        return int(math.copysign(math.floor(abs(x) + 0.5), x))

    assert got["round"] == [away(x * 1000.0) for (x,) in data]
    assert got["floor"] == [math.floor(x * 1000.0) for (x,) in data]
    assert got["ceil"] == [math.ceil(x * 1000.0) for (x,) in data]
    assert got["trunc"] == [math.trunc(x * 1000.0) for (x,) in data]
    assert values(spark, [(0.49999999999999994,)], "v double", scaled(F.col("v"), KeyOptions(decimals=0))) == [0]


def test_teos10(spark):
    data = [(float(p), lat) for p in (1, 10, 100, 1000, 6000) for lat in (0.0, 45.0, 80.0)]
    df = spark.createDataFrame(data, "p double, lat double").withColumn("z", teos10.z_from_p(F.col("p"), F.col("lat")))
    for r in teos10.with_pressure(df, F.col("z"), F.col("lat"), "back").collect():
        assert r["back"] == pytest.approx(r["p"], abs=1e-6)
    (z,) = values(spark, [(10.0, 4.0)], "p double, lat double", teos10.z_from_p(F.col("p"), F.col("lat")))
    assert z == pytest.approx(-9.94458, abs=1e-5)
    up = spark.createDataFrame([(50.0,)], "z double")
    assert math.isnan(teos10.with_pressure(up, F.col("z"), F.lit(0.0), "p").first()["p"])


def test_conversions_fill_what_is_missing(spark):
    schema = "pres float, pres_qc string, deph float, deph_qc string, lat double"
    data = [(NAN, "", 100.0, "2", 45.0), (50.0, "1", 100.0, "2", 45.0), (NAN, "", NAN, "", 45.0), (50.0, "1", NAN, "", 45.0), (99999.0, "9", 100.0, "2", 45.0), (NAN, "", -50.0, "2", 45.0)]
    df = grids.with_made_pressure(spark.createDataFrame(data, schema), F.col("deph"), F.col("lat"))
    c = F.col
    p = df.select(*grids.pressure_from_depth(c("pres"), c("pres_qc"), c("deph"), c("deph_qc"), c("__made"), F.lit(99999.0))).collect()
    assert p[0][0] == pytest.approx(100.9, abs=0.5) and tuple(p[0][1:]) == ("2", 1)
    assert tuple(p[1]) == (50.0, "1", 0) and math.isnan(p[2][0]) and tuple(p[2][1:]) == ("", 0)
    assert tuple(p[3]) == (50.0, "1", 0) and p[4][2] == 1 and math.isnan(p[5][0]) and p[5][2] == 0
    d = df.select(*grids.depth_from_pressure(c("deph"), c("deph_qc"), c("pres"), c("pres_qc"), c("lat"))).collect()
    assert tuple(d[0]) == (100.0, "2", 0) and d[3][0] == pytest.approx(49.6, abs=0.5) and tuple(d[3][1:]) == ("1", 1) and math.isnan(d[2][0])


def test_coordinates_fill_each_other(spark):
    df = spark.createDataFrame([(1.0, 10.0), (NAN, 20.0), (3.0, NAN), (None, 5.0), (NAN, NAN)], "a double, b double")
    got = [tuple(r) for r in df.select(grids.filled_from(F.col("a"), F.col("b")), grids.filled_from(F.col("b"), F.col("a"))).collect()]
    assert got[:4] == [(1.0, 10.0), (20.0, 20.0), (3.0, 3.0), (5.0, 5.0)] and math.isnan(got[4][0])


@pytest.mark.parametrize("starts, data, want", [([0, 3], [1.0, 2.0], [1, 1, 1, 2, 2]), ([3, 0], [10.0, 20.0], [20, 20, 20, 10, 10]), ([2], [7.0], [NAN, NAN, 7, 7]), ([-5, 1], [4.0, 5.0], [4, 5]), ([0, 0], [1.0, 2.0], [2, 2]), ([], [], [NAN, NAN])])
def test_deployments(spark, starts, data, want):
    steps = spark.createDataFrame([(t,) for t in range(len(want))], "t long")
    runs = spark.createDataFrame([(s, v, k) for k, (s, v) in enumerate(zip(starts, data))], "start int, value double, position int")
    rows = spark.createDataFrame([(t, starts, data) for t in range(len(want))], "t long, s array<int>, v array<double>")
    for got in (grids.deployed(steps, runs), grids.deployed(steps, runs, span=2), grids.deployed(steps, runs, span=1), rows.select("t", grids.deployed_in(F.col("s"), F.col("v"), F.col("t")).alias("value"))):
        assert repr([r["value"] for r in got.orderBy("t").collect()]) == repr([float(x) for x in want])


def test_missing_columns_are_named():
    with pytest.raises(ValueError, match="psal"):
        require(["temp"], "temp", "psal")
