"""Mixing sources to target weights: capped water-filling, then seeded sampling.

A source's target is its share of the total, clamped at ``epochs`` times its size; the
excess goes to the others by weight until none is above. A target is met by whole
repetitions of the source and a fractional one: the source's documents in the order of
a seeded hash, up to the document that comes nearest to the target. The prefix sums
behind that are taken per hash range first, so no task ever sees a whole source.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..session import prepare, stored
from .words import IS_SPACE, raw, runs

#: Hash ranges per source.
RANGES = 4096
HASH_BITS = 60


def water_fill(sizes: Sequence[int], weights: Sequence[float], total: float, epochs: float) -> list[float]:
    """Targets in proportion to the weights, none above ``epochs`` times its size."""
    caps = [epochs * s for s in sizes]
    clamped = [False] * len(caps)
    while True:
        left = total - sum(c for c, done in zip(caps, clamped) if done)
        weight = sum(w for w, done in zip(weights, clamped) if not done)
        if not weight:
            return caps
        targets = [c if done else max(left, 0.0) * w / weight for c, w, done in zip(caps, weights, clamped)]
        above = [not done and t > c for t, c, done in zip(targets, caps, clamped)]
        if not any(above):
            return targets
        clamped = [a or b for a, b in zip(clamped, above)]


def _sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in runs(batch):
            data, offs = raw(part.column("text"))
            space = IS_SPACE[data]
            first = ~space
            first[1:] &= space[:-1]
            inner = offs[:-1][offs[:-1] < len(data)]
            first[inner] = ~space[inner]
            total = np.zeros(len(data) + 1, np.int64)
            np.cumsum(first, out=total[1:])
            size = pa.array(total[offs[1:]] - total[offs[:-1]])
            names = [c for c in part.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), size], [*names, "size"])


def source_targets(per_source: dict[str | None, int], weights: Sequence[float] = (3, 1, 2), share: float = 1.5, epochs: float = 2) -> dict[str | None, float]:
    """Sources by code point, null last, take the weights in turn."""
    names = sorted((s for s in per_source if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in per_source)
    sizes = [per_source[s] for s in names]
    return dict(zip(names, water_fill(sizes, [weights[k % len(weights)] for k in range(len(names))], share * sum(sizes), epochs)))


def mixed(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, epochs: float = 2, seed: int = 0) -> DataFrame:
    """One row per document: doc_id, source, k1, k2 (a hash of the row), size, source_size, target, taken, repeats.

    Size is the number of ``[^\\x20\\x09-\\x0D]+``; null and empty texts have 0 and are never
    taken beyond that. A null source is a source of its own, the last. Null ids are drawn
    like others, rows that repeat an id separately, in the order of their text's hash. The
    per-source totals come to the driver: a row per source, and there must be few enough
    sources to be given weights. Columns other than doc_id, text, source aren't read.
    """
    spark = prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    rows = _keyed(rows).withColumnsRenamed({"__k1": "k1", "__k2": "k2"})
    sized = rows.mapInArrow(_sized, "doc_id long, source string, k1 long, k2 long, size long")
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, HASH_BITS // 4), 16, 10).cast("long")
    sized = stored(sized.withColumn("draw", draw).withColumn("row", F.monotonically_increasing_id()), "sizes")
    per_source = {r["source"]: r["n"] for r in sized.groupBy("source").agg(F.sum("size").alias("n")).collect()}
    targets = source_targets(per_source, weights, share, epochs)
    plan = []
    for name, target in targets.items():
        n = per_source[name]
        whole = int(target // n) if n else 0
        plan.append((name, n, float(target), whole, float(target - whole * n)))
    kind = T.StructType([T.StructField("name", T.StringType()), T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType()), T.StructField("whole", T.IntegerType()), T.StructField("rest", T.DoubleType())])
    plan = spark.createDataFrame(plan, kind)
    sized = sized.withColumn("range", F.shiftright("draw", HASH_BITS - int(np.log2(RANGES))))
    ranges = sized.groupBy("source", "range").agg(F.sum("size").alias("in_range"))
    up_to = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(F.col("source").alias("s"), F.col("range").alias("r"), F.coalesce(F.sum("in_range").over(up_to), F.lit(0)).alias("below"))
    inside = Window.partitionBy("source", "range").orderBy("draw", "doc_id", "k1", "row").rowsBetween(Window.unboundedPreceding, -1)
    out = (
        sized.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(ranges, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r")))
        .join(plan, F.col("source").eqNullSafe(F.col("name")))
    )
    # the document that crosses the target goes in if that comes nearer to it
    extra = (2 * (F.col("below") + F.col("within")) + F.col("size") <= 2 * F.col("rest")) & (F.col("rest") > 0)
    out = out.withColumn("repeats", F.col("whole") + extra.cast("int"))
    return out.select("doc_id", "source", "k1", "k2", "size", "source_size", "target", (F.col("size") * F.col("repeats")).cast("long").alias("taken"), "repeats")


def _keyed(docs: DataFrame) -> DataFrame:
    """k1, k2 stand for a row's id, source and text; equal rows share them."""
    parts = [F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text").cast("string")]
    return docs.withColumn("__k1", F.xxhash64(*parts)).withColumn("__k2", F.xxhash64(F.lit(7), *parts[::-1]))


def mix_documents(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, epochs: float = 2, seed: int = 0) -> DataFrame:
    """The documents of the mix: rows of ``docs``, repeated as often as they are taken. Rows
    that are taken 0 times, those without words among them, are left out. Column names that begin with
    ``__`` are ours."""
    nth = Window.partitionBy("__k1", "__k2").orderBy("__k1")
    plan = mixed(docs, weights, share, epochs, seed).where("repeats > 0 and size > 0").select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2"), F.col("repeats").alias("__repeats"))
    plan = plan.withColumn("__nth", F.row_number().over(nth))
    rows = _keyed(docs).withColumn("__nth", F.row_number().over(nth))
    return rows.join(plan, ["__k1", "__k2", "__nth"]).select(*(rows[f"`{c}`"] for c in docs.columns), F.explode(F.sequence(F.lit(1), "__repeats")).alias("__copy")).drop("__copy")
