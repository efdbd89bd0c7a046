from __future__ import annotations

import math

import pytest
from data import COMPARE, compare_a, compare_b

from brineframe.functions.keys import KeyOptions
from brineframe.operators.compare import COLUMNS, CompareOptions, compare
from brineframe.plans.render import rendered


def rows(spark, options=CompareOptions(), a=None, b=None, parts=2):
    a = spark.createDataFrame(compare_a() if a is None else a, COMPARE).repartition(parts)
    b = spark.createDataFrame(compare_b() if b is None else b, COMPARE).repartition(parts)
    return compare(a, b, "a", "b", options).collect()


@pytest.mark.parametrize("parts", [1, 3, 17])
@pytest.mark.parametrize("time_col", ["profile_time", "profile_timestamp"])
def test_both_ways(spark, parts, time_col):
    got = [tuple(r) for r in rows(spark, CompareOptions(time_col=time_col), parts=parts)]
    assert got == [
        ("b", "a", 2, 1, 50.0, 3, 0, 2, 66.67, 1, 1, 50.0, 13, 7),
        ("a", "b", 3, 1, 33.33, 4, 1, 2, 50.0, 1, 1, 50.0, 17, 6),
    ]


def test_options(spark):
    assert [r["matched_profiles"] for r in rows(spark, CompareOptions(use_platform=False))] == [3, 3]
    assert rows(spark, CompareOptions(KeyOptions(decimals=4)))[0]["matched_profiles"] == 1
    assert rows(spark, CompareOptions(KeyOptions("%Y-%m-%d %H")))[0]["matched_profiles"] == 1
    with pytest.raises(ValueError, match="available"):
        rows(spark, CompareOptions(lon_col="nowhere"))
    with pytest.raises(ValueError, match="time column"):
        rows(spark, CompareOptions(time_col="platform_code"))


def test_sizes(spark):
    got = rows(spark, a=compare_a((3, 8, 1, 0)), b=compare_b((3, 5, 2)))[0]
    assert (got["ref_observations"], got["matched_observations"], got["matched_profiles"], got["same_nobs"], got["diff_nobs"]) == (10, 8, 2, 1, 1)


def test_empty_side(spark):
    got = rows(spark, b=[])
    assert math.isnan(got[0]["platform_cov_pct"]) and got[0]["ref_observations"] == 0 and got[1]["matched_profiles"] == 0
    line = rendered(COLUMNS, [tuple(r) for r in got]).splitlines()[1].split("\t")
    assert line[:6] == ["b", "a", "0", "0", "", "0"]
