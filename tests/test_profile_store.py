"""Profiles kept up by file: the same as from the whole product, and only new files are read."""

from __future__ import annotations

import shutil
import time
from pathlib import Path

import pytest
from data import DUP, dup_rows
from pyspark.sql import functions as F

from brineframe.operators.compare import CompareOptions, compare
from brineframe.operators.duplicates import mark_duplicates
from brineframe.plans.profile_store import ProfileStore
from brineframe.plans.report import report

ORDERED = ["platform_code", "profile_no"]


def deliver(spark, folder: Path, name: str, rows, schema=DUP) -> None:
    """A file of the product."""
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(folder / "draft"))
    (part,) = (folder / "draft").glob("part-*")
    part.rename(folder / name)
    shutil.rmtree(folder / "draft")


def same(spark, store, product, levels=("profile",)):
    whole = spark.read.parquet(str(product))
    text = lambda df: sorted(repr(r) for r in df.collect())
    rounded = lambda df: df.select(*(F.round(c, 9).alias(c) if c.endswith("_mean") else c for c in df.columns))
    for level in levels:
        assert text(rounded(store.report(level))) == text(rounded(report(whole, level)))
    groups = store.duplicates().select("dup_group", "pc", "pn", "n_obs", "longitude")
    assert text(groups) == text(mark_duplicates(whole)[1].select("dup_group", F.col("platform_code").alias("pc"), F.col("profile_no").alias("pn"), "n_obs", "longitude"))


@pytest.fixture
def product(tmp_path):
    folder = tmp_path / "product"
    folder.mkdir()
    return folder


def test_files_come_change_and_go(spark, product, tmp_path):
    rows = dup_rows()
    store = ProfileStore(spark, str(tmp_path / "store"))
    deliver(spark, product, "a.parquet", rows[::2])  # profiles are split between both files
    assert store.update([str(product)]) == (1, 0) and store.update([str(product)]) == (0, 0)
    same(spark, store, product)
    deliver(spark, product, "b.parquet", rows[1::2] + [(None, None, 1, 1.0, rows[0][4], 1.0, 2.0, 3.0, 4.0, 5.0, "1", "4", "")])
    assert store.update([str(product)]) == (1, 0)
    same(spark, store, product, ("platform", "profile", "global"))
    time.sleep(1.1)  # so that the time of change differs, should the size be the same
    (product / "a.parquet").unlink()
    deliver(spark, product, "a.parquet", rows[::3])
    assert store.update([str(product)]) == (1, 0)
    same(spark, store, product)
    (product / "b.parquet").unlink()
    assert store.update([str(product)]) == (0, 1)
    same(spark, store, product)
    again = ProfileStore(spark, str(tmp_path / "store"))
    assert again.update([str(product)]) == (0, 0) and again.profiles().count() == store.profiles().count() > 0


def test_untouched_files_are_not_opened(spark, product, tmp_path):
    """With the contents of all earlier files destroyed, an update and every result are as before."""
    rows = dup_rows()
    for k in range(4):
        deliver(spark, product, f"{k}.parquet", rows[k::5])
    stores = [ProfileStore(spark, str(tmp_path / f"store{k}")) for k in range(2)]
    results = []
    for k, store in enumerate(stores):
        store.update([str(product)])
    deliver(spark, product, "new.parquet", rows[4::5])
    for k, store in enumerate(stores):
        if k == 1:
            for own in range(4):  # as long and as old as before, and no Parquet any more
                path = product / f"{own}.parquet"
                stamp = path.stat()
                path.write_bytes(b"x" * stamp.st_size)
                import os

                os.utime(path, ns=(stamp.st_atime_ns, stamp.st_mtime_ns))
        assert store.update([str(product)]) == (1, 0)
        results.append([sorted(map(repr, df.collect())) for df in (store.report("profile"), store.report("global"), store.duplicates().drop("seen", "key"), store.compared(store, "a", "b"))])
    assert results[0] == results[1] and all(results[0])


def test_two_products(spark, product, tmp_path):
    rows = dup_rows()
    other = tmp_path / "other"
    other.mkdir()
    deliver(spark, product, "a.parquet", rows)
    deliver(spark, other, "b.parquet", rows[3:9])
    deliver(spark, other, "c.parquet", rows[12:])
    one, two = ProfileStore(spark, str(tmp_path / "s1")), ProfileStore(spark, str(tmp_path / "s2"))
    one.update([str(product)])
    two.update([str(other)])
    for time_col in ("profile_time", "profile_timestamp"):
        options = CompareOptions(time_col=time_col)
        want = compare(spark.read.parquet(str(product)), spark.read.parquet(str(other)), "x", "y", options)
        assert sorted(map(repr, one.compared(two, "x", "y", options).collect())) == sorted(map(repr, want.collect()))


def test_updates_that_overlap(spark, product, tmp_path):
    """Another writer's update between a look at the state and the commit: this one begins anew."""
    rows = dup_rows()
    deliver(spark, product, "a.parquet", rows[::2])
    one, two = ProfileStore(spark, str(tmp_path / "store")), ProfileStore(spark, str(tmp_path / "store"))
    partials, met = one._partials, []

    def slow(files):
        if not met:
            met.append(files)
            deliver(spark, product, "b.parquet", rows[1::2])
            two.update([str(product)])
        return partials(files)

    one._partials = slow
    assert one.update([str(product)]) == (0, 1) and len(met) == 1  # it listed the files before b came
    assert two.update([str(product)]) == (1, 0)
    same(spark, two, product)


def test_no_files(spark, product, tmp_path):
    store = ProfileStore(spark, str(tmp_path / "store"))
    assert store.update([str(product)]) == (0, 0) and store.profiles().count() == 0 and store.duplicates().count() == 0
    assert store.report("global").first()["n_profiles"] == 0
