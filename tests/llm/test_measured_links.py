"""All pairs of neighbours count in the measured recall; runs of texts are as large as asked for."""

import numpy as np
import pyarrow as pa
import pytest


def test_all_neighbours_are_measured(spark):
    from brineframe.llm import ngram_join as module

    one = np.random.default_rng(3).integers(0, 60_000, (80, module.VALUES)).astype(np.uint16)
    reps = spark.createDataFrame([(i, x.tobytes()) for i, x in enumerate(np.repeat(one, 2, 0))], "rep long, sig binary")
    _, d, share = module.meeting_depth(reps, 0.8, 0.999)
    assert share == pytest.approx((80 + module.ASSUMED * module.expected(0.8, d)) / (80 + module.ASSUMED), abs=1e-12)


def test_runs_of_a_size():
    from brineframe.llm.words import SMALL_RUN, runs

    batch = pa.record_batch({"text": ["x" * 100_000] * 50})
    parts = list(runs(batch, size=SMALL_RUN))
    assert sum(p.num_rows for p in parts) == 50 and max(p.num_rows for p in parts) <= SMALL_RUN // 100_000 + 1
