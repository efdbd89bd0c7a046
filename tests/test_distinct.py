"""Distinct counts from bitmaps."""

from __future__ import annotations

import random
from collections import defaultdict

from brineframe.plans.distinct import BLOCK, Dictionary, bitmaps, counted, rolled


def test_counts_roll_up_exactly(spark, tmp_path):
    rng = random.Random(0)
    rows = [(rng.choice("xyz"), rng.choice("pq"), rng.choice([None, "", *(f"v{k}" for k in range(60))])) for _ in range(400)]
    words, sets = Dictionary(spark, str(tmp_path / "w")), None
    for part in (rows[:150], rows[150:151], rows[151:]):
        df = spark.createDataFrame(part, "a string, b string, v string").repartition(3)
        words.add(df, "v")
        own = bitmaps(df, ["a", "b"], "v", words.words())
        sets = own if sets is None else sets.unionByName(own)
    numbers = {r["value"]: r["number"] for r in words.words().collect()}
    assert len(numbers) == len(set(numbers.values())) == len({v for _, _, v in rows}) and {n // BLOCK for n in numbers.values()} >= {0}
    for by in ((), ("a",), ("b",), ("a", "b")):
        want = defaultdict(set)
        for a, b, v in rows:
            want[tuple({"a": a, "b": b}[c] for c in by)].add(v)
        assert {tuple(r)[:-1]: r[-1] for r in counted(sets, list(by)).collect()} == {k: len(v) for k, v in want.items()}
    # a roll-up of a roll-up is that of all
    assert counted(rolled(sets, ["a"])).first()["n"] == len(numbers)
    words.add(spark.createDataFrame(rows, "a string, b string, v string"), "v")
    assert max(words.log.commits()) <= 2  # nothing was lacking


def test_nothing(spark, tmp_path):
    none = spark.createDataFrame([], "a string, v string")
    words = Dictionary(spark, str(tmp_path / "w"))
    words.add(none, "v")
    assert counted(bitmaps(none, ["a"], "v", words.words()), ["a"]).count() == 0 and counted(bitmaps(none, [], "v", words.words())).first()["n"] == 0
