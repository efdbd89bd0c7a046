"""Observations stored by profile: the same results, and no shuffle of rows after the first step."""

from __future__ import annotations

import random
import uuid

import pytest
from data import DUP, day

from brineframe.operators.cleaning import Box, clean
from brineframe.operators.duplicates import drop_duplicate_profiles, duplicate_groups, mark_duplicates
from brineframe.operators.order import with_order
from brineframe.plans.report import report
from brineframe.sources.bucketed import ProfileBuckets

NAN = float("nan")


def product(seed=0, n=160):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        p, no = rng.choice(["A", "B", "C", "", None]), rng.choice([None, 0, *range(1, 40)])
        t, lon, lat = day(f"2020-01-0{rng.randint(1, 3)}"), rng.choice([1.0, 1.0001, 2.0, NAN]), rng.choice([50.0, 51.0])
        flags = rng.choice(["1", "1", "", "4"]), rng.choice(["1", "1", "1", "3"])
        for level in range(rng.randint(1, 4)):
            out.append((p, no, level + 1, 25567.0, t, lon, lat, rng.choice([NAN, 1.0, 2.5]), rng.choice([35.0, 35.0, NAN]), rng.choice([10.0 * level, 10.0 * level, NAN]), *flags, ""))
    return out


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("buckets")
    spark.createDataFrame(product(), DUP).repartition(3).write.parquet(str(folder / "plain"))
    plain = spark.read.parquet(str(folder / "plain"))
    names = iter(f"brine_{uuid.uuid4().hex}" for _ in range(20))
    place = lambda n: str(folder / n)
    made = {"plain": plain, "stored": ProfileBuckets.create(plain, (n := next(names)), place(n), 6)}
    box = Box(0.0, 3.0, 49.0, 50.5)
    made["box"] = box
    made["cleaned"] = made["stored"].clean((n := next(names)), place(n))
    made["boxed"] = made["stored"].clean((n := next(names)), place(n), box)
    made["marked"], made["dups"] = made["cleaned"].mark((n := next(names)), place(n))
    made["left"] = made["marked"].dedup((n := next(names)), place(n))
    yield made
    for t in made.values():
        if isinstance(t, ProfileBuckets):
            t.drop()


def key(df):
    return sorted(map(repr, df.collect()))


def test_the_same_rows(tables):
    plain = tables["plain"]
    assert key(tables["stored"].table()) == key(plain) and tables["stored"].table().columns == plain.columns
    # the order of the first table goes with the rows, here as there
    good = clean(with_order(plain))
    assert key(tables["cleaned"].table()) == key(good.drop("__order")) and good.count() > 20
    assert key(tables["boxed"].table()) == key(clean(plain, tables["box"]))
    marked, dups = mark_duplicates(good)
    assert key(tables["marked"].table()) == key(marked.drop("__order")) and key(tables["dups"]) == key(dups) and dups.count() > 2
    left = drop_duplicate_profiles(marked)
    assert key(tables["left"].table()) == key(left.drop("__order")) and 0 < left.count() < marked.count()
    # on rows with null platforms and numbers too
    groups = duplicate_groups(tables["stored"].profiles())
    assert key(tables["stored"].marked_rows(groups).drop("__pc", "__pn", "__order")) == key(mark_duplicates(plain)[0])
    assert key(tables["stored"].dedup_rows().drop("__pc", "__pn", "__order")) == key(drop_duplicate_profiles(plain))
    for level in ("platform", "global", "profile"):
        assert key(tables["marked"].report(level)) == key(report(marked, level))
        assert key(tables["stored"].report(level)) == key(report(plain, level))


def node_rows(df):
    """(what, depth) of the nodes of the plan as it is before it runs."""
    text = df._jdf.queryExecution().executedPlan().toString()
    return [(line.lstrip(" :+-*()0123456789"), len(line) - len(line.lstrip(" :+-"))) for line in text.splitlines()]


def shuffled(df) -> list[bool]:
    """Of each Exchange in the plan: whether rows reach it that no aggregation has reduced to profiles."""
    nodes, out = node_rows(df), []
    for k, (name, depth) in enumerate(nodes):
        if name.startswith("Exchange"):
            below = []
            for other, d in nodes[k + 1 :]:
                if d <= depth:
                    break
                below.append(other)
            out.append(not any("Aggregate" in x for x in below))
    return out


def test_no_shuffle_after_the_first_step(spark, tables):
    assert shuffled(tables["stored"].clean_rows()) == [] and shuffled(tables["stored"].clean_rows(tables["box"])) == []
    assert shuffled(tables["cleaned"].profiles()) == [] and shuffled(tables["left"].profile_rows()) == []
    assert shuffled(tables["left"].report("global")).count(True) == 0
    for df in (tables["cleaned"].marked_rows(duplicate_groups(tables["cleaned"].profiles())), tables["marked"].dedup_rows()):
        met = shuffled(df)
        assert met and not any(met)  # profiles are shuffled, rows are not
        text = df._jdf.queryExecution().executedPlan().toString()
        assert "SelectedBucketsCount: 6 out of 6" in text
    # the plain form, for comparison
    assert shuffled(clean(tables["plain"]))
    assert tables["left"]._buckets() == 6
