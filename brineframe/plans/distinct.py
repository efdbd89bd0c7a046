"""Distinct counts that roll up: exact bitmaps over a dictionary of values.

A value's number comes from a dictionary table, which is written once and grows by values that it lacks; it packs the numbers of
values that come together side by side. A group's values are then a few bitmaps of 32,768 bits, and those of a larger group
are their bitwise OR: from profile to platform to all, from file to file, without a second look at the rows. Counts are exact.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.ledger import Batch, Ledger

#: Numbers of one task of one batch: a batch's numbers begin at a multiple of this.
BLOCK = 1 << 33


class Dictionary:
    """Numbers of the different values of a column of text, at ``path``; null is a value of its own."""

    WORDS = "value string, number long"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.log = spark, Ledger(spark, path)

    def add(self, values: DataFrame, column: str) -> None:
        """Gives numbers to the values of a column that have none yet."""
        new = values.select(F.col(column).cast("string").alias("value")).distinct()

        def work(batch: Batch) -> None:
            known = batch.read("words", self.WORDS)
            left = _lacking(new, known)
            top = known.agg(F.max("number")).first()[0]
            start = 0 if top is None else (top // BLOCK + 1) * BLOCK
            # one file: the numbers of a batch are dense
            batch.write("words", left.coalesce(1).withColumn("number", F.monotonically_increasing_id() + start))

        if _lacking(new, self.words()).head(1):
            self.log.apply(uuid.uuid4().hex, work)

    def words(self) -> DataFrame:
        """value, number."""
        return self.log.read("words", self.WORDS).drop("seq")


def _lacking(new: DataFrame, known: DataFrame) -> DataFrame:
    return new.alias("n").join(known.alias("k"), F.col("n.value").eqNullSafe(F.col("k.value")), "left_anti").select("n.value")


def bitmaps(rows: DataFrame, by: Sequence[str], column: str, words: DataFrame) -> DataFrame:
    """``by``, bucket, bits: the set of values of ``column`` in each group, as bitmaps of the numbers in ``words``. A group and value is
    one row before it meets the dictionary."""
    each = rows.select(*by, F.col(column).cast("string").alias("__value")).distinct()
    number = each.join(words.select(F.col("value").alias("__word"), "number"), F.col("__value").eqNullSafe(F.col("__word")))
    # bitmap functions number from 1
    return number.groupBy(*by, F.bitmap_bucket_number(F.col("number") + 1).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("number") + 1)).alias("bits"))


def rolled(sets: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The sets of larger groups: bitmaps of fewer columns, or of several tables of bitmaps put together."""
    return sets.groupBy(*by, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def counted(sets: DataFrame, by: Sequence[str] = (), name: str = "n") -> DataFrame:
    """How many values each set has."""
    own = rolled(sets, by).select(*by, F.bitmap_count("bits").alias("n"))
    return own.groupBy(*by).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias(name))
