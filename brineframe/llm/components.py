"""Connected components by alternating large and small stars."""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored

#: Edges for which a table that is written in between has a file.
FILE_EDGES = 100_000


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component), for each node of ``edges`` (a long, b long).

    Every round is a few aggregations with map-side combine and joins with written tables,
    which adaptive execution can split where a node has very many edges, and ends in a
    written table; the number of rounds grows with the logarithm of the longest path.
    Self-loops are ignored. Tables in between have a file for each FILE_EDGES edges, but as many as the
    session runs tasks at once at least, and no more than shuffles have partitions.
    """
    slots = edges.sparkSession.sparkContext.defaultParallelism
    edge = lambda a, b: F.struct(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    now = edges.where("a <> b").select(edge(F.col("a"), F.col("b")).alias("e")).select("e.u", "e.v").distinct()
    now = stored(now, "edges")
    while True:
        # done when each node has one edge, and none is the end of another's
        ends = now.select(F.col("u").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(now.select(F.col("v").alias("x"), F.lit(0).alias("out"), F.lit(1).alias("into")))
        open_ = ends.groupBy("x").agg(F.sum("out").alias("out"), F.max("into").alias("into")).agg(F.count_if(F.expr("out > 1 or out = 1 and into = 1")), F.sum("out")).first()
        if not open_[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        parts = max(slots, ceil(2 * open_[1] / FILE_EDGES))
        kept = lambda df, name: stored(df.coalesce(parts), name)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = kept(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = kept(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large-stars")
        least = kept(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        now = kept(small.distinct(), "edges")
