"""Cells as column expressions against the same rules in Python, and reports written by executors."""

from __future__ import annotations

import datetime as dt
import json
import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from brineframe.functions.cells import cell, four_decimals, json_cell, shortest
from brineframe.plans import render
from brineframe.plans.lines import duplicates_line, json_record, numbered_lines, tsv_line, write_lines_of

NAN, INF = float("nan"), float("inf")


def doubles():
    rng = random.Random(0)
    out = [NAN, INF, -INF, 0.0, -0.0, 0.03125, 0.09375, -0.03125, 2.00005, 1.00005, 0.00005, 0.00015, 0.99995, 9.99995, 0.999949999, -0.00001, 1e-20, 5e-324, 1e15, 2.0**52 + 0.5, 2.0**53 - 1, 123456789.12345, 22712.25, 0.1, 1 / 3, 100.0, 1e22, 1.5e300, 2e-9]
    out += [rng.uniform(-400, 400) for _ in range(400)] + [round(rng.uniform(-99, 99), 5) for _ in range(600)] + [rng.randrange(-(10**7), 10**7) / 32 for _ in range(200)]
    out += [v for _ in range(600) if math.isfinite(v := struct.unpack("<d", rng.randbytes(8))[0])]
    return out + [math.nextafter(v, w) for v in (0.00005, 1.00005, 0.5, 0.03125) for w in (INF, -INF)]


def test_numbers(spark):
    values = doubles()
    rows = spark.createDataFrame([(v,) for v in values + [None]], "v double").select("v", four_decimals(F.col("v")), shortest(F.col("v"))).collect()
    for v, four, short in rows:
        if v is None:
            assert (four, short) == ("", "NaN")
            continue
        if not math.isfinite(v) or abs(v) < 9.2e18:
            assert four == render.number(v), v
        else:  # digits after the seventeenth are zeros
            assert float(four) == v
        if math.isfinite(v):
            assert "e" not in short.lower() and float(short) == v
            # numbers below the smallest normal one may have a digit more than they need
            assert abs(v) < 2.3e-308 or len(short.replace("-", "").replace(".", "").strip("0")) <= len(render.plain(v).replace("-", "").replace(".", "").strip("0")), v
            if 1e-300 < abs(v) < 1e15 or v == 0:
                assert short.lstrip("-") == render.plain(v).lstrip("-"), v


TABLE = "s string, n long, x double, f float, b boolean, t timestamp_ntz"


def table(spark):
    odd = "a\tb\\c\"d\ne\x01\x1f é/"
    rows = [(odd, 1, 2.00005, 0.5, True, dt.datetime(2020, 1, 31, 6, 0, 7)), (None, None, None, None, None, None), ("", -3, NAN, INF, False, dt.datetime(1950, 1, 1)), ("z", 0, -1e-5, 1 / 3, None, None)]
    return spark.createDataFrame(rows, TABLE), rows


def test_cells_of_every_kind(spark):
    df, rows = table(spark)
    got = df.select(*(f(F.col(k.name), k.dataType) for f in (cell, json_cell) for k in df.schema.fields)).collect()
    asis = [tuple(r) for r in df.collect()]
    assert [tuple(r)[:6] for r in got] == [tuple(map(render.cell, r)) for r in asis]
    assert [tuple(r)[6:] for r in got] == [tuple(map(render.json_cell, r)) for r in asis]
    for r, plain in zip(df.select(json_record(df)).collect(), asis):
        record = json.loads(r[0])
        assert list(record) == df.columns and record["s"] == plain[0] and record["n"] == plain[1]


def test_lines_are_numbered_and_written(spark, tmp_path):
    df = spark.range(500).select((F.col("id") * 37 % 500).alias("k"), (F.col("id") / 8).alias("x")).repartition(4)
    want = ["k\tx"] + [f"{k}\t{render.number(x)}" for k, x in sorted(map(tuple, df.collect()))]
    rows = numbered_lines(df, tsv_line(df), ["k"], "k\tx", files=5).collect()
    assert [r["text"] for r in sorted(rows, key=lambda r: r["line"])] == want and sorted(r["line"] for r in rows) == list(range(501))
    write_lines_of(df, tsv_line(df), ["k"], str(tmp_path / "r.tsv"), "k\tx", files=5)
    assert (tmp_path / "r.tsv").read_text() == "\n".join(want) + "\n" and [p.name for p in tmp_path.iterdir() if "draft" in p.name] == []
    none = df.limit(0)
    write_lines_of(none, tsv_line(none), ["k"], str(tmp_path / "r.tsv"), "k\tx")
    assert (tmp_path / "r.tsv").read_text() == "k\tx\n"


def test_the_duplicates_table(spark):
    rows = [(1, "A", 3, 22712.25, dt.datetime(2011, 3, 9, 2, 30), -7.25, 58.1204, 3), (1, "B", 9, NAN, dt.datetime(2011, 3, 9, 2, 30, 0, 250000), 3.0, 1 / 3, 1), (2, "A", 4, 1.0, None, -180.0, 1e-7, 2)]
    df = spark.createDataFrame(rows, "dup_group long, platform_code string, profile_no long, profile_time double, profile_timestamp timestamp_ntz, longitude double, latitude double, n_obs long")
    want = list(render.duplicates_lines(df))[1:]
    assert [f"{r[0]}\n" for r in df.select(duplicates_line()).collect()] == want


def test_cells_are_worked_out_once(spark):
    """The expression of a cell grows with its steps, not twofold with each: what Spark can't compile runs row by row, a hundred times slower."""
    for f in (four_decimals, shortest):
        plan = spark.range(1).select(f(F.col("id").cast("double")).alias("x"))._jdf.queryExecution().analyzed().toString()
        assert len(plan) < 12_000, (f.__name__, len(plan))


@pytest.mark.parametrize("of", [json_cell, cell])
def test_usual_cells_take_no_lambda(spark, of):
    """Lambdas are run step by step: one for ties and large numbers, and a fold for texts with rare control characters, are all there are."""
    for kind in ("double", "string", "bigint", "boolean", "timestamp_ntz"):
        df = spark.createDataFrame([], f"x {kind}")
        plan = df.select(of(F.col("x"), df.schema["x"].dataType).alias("y"))._jdf.queryExecution().analyzed().toString()
        assert plan.count("lambdafunction(") <= 2, kind


def test_numbers_near_ties(spark):
    rng = random.Random(3)
    at = [k / 20_000 for k in range(1, 20_000, 2)] + [float(1 << e) + d for e in (9, 37, 39) for d in (-0.5, 0.5, 2.0**-13, 2.0**-14, -(2.0**-14))] + [float(1 << 53), 2.0**53 - 1, 2.0**52 + 0.5, 9.2e18]
    ties = [rng.randrange(1 << e) + (2 * rng.randrange(10_000) + 1) / 20_000 for e in range(53) for _ in range(20)]
    values = [s * v for t in at + ties for v in (t, math.nextafter(t, INF), math.nextafter(t, -INF)) for s in (1, -1) if abs(v) < 9.2e18]
    for v, four in spark.createDataFrame([(v,) for v in values], "v double").select("v", four_decimals(F.col("v"))).collect():
        assert four == render.number(v), v


def test_every_control_character(spark):
    text = "".join(map(chr, range(32))) + '"\\\x7fé'
    got = spark.createDataFrame([(text,), ("\\u0001",), (" ",)], "s string")
    assert [r[0] for r in got.select(json_cell(F.col("s"), got.schema["s"].dataType)).collect()] == [json.dumps(t, ensure_ascii=False) for t in (text, "\\u0001", " ")]
    odd = spark.createDataFrame([(1,)], 'n long').withColumnRenamed("n", 'a"\\\t')
    assert json.loads(odd.select(json_record(odd)).first()[0]) == {'a"\\\t': 1}


def test_lines_are_compiled_in_small_methods(spark):
    """Java doesn't compile methods of more than 8,000 bytes; a line of many cells stays below that."""
    df = spark.range(1).select(*((F.col("id") / k).alias(f"x{k}") for k in range(1, 30)), *(F.concat(F.lit(f"{k}\t"), F.col("id").cast("string")).alias(f"s{k}") for k in range(6)))
    for line in (tsv_line, json_record):
        subtrees = df.select(line(df).alias("text"))._jdf.queryExecution().debug().codegenToSeq()
        assert all(subtrees.apply(k)._3().maxMethodCodeSize() < 8_000 for k in range(subtrees.size())), line.__name__
