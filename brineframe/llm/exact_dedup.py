"""Exact dedup: group by a 128-bit content hash, keep the smallest id, compare bytes inside groups.

DataFrame functions only. The normalised text travels once, after a map-side
combine that leaves one row per distinct text and task, so a text that a third of
all rows share is a few rows when it is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored

#: The white space that normalisation folds.
SPACE_RUN = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_RUN, " ")


def exact_groups(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document: ``key``, keep_id, group_size, kept, text_sha256.

    A group is the rows whose normalised texts have equal bytes; the md5 of the
    normalised text (128 bits) finds it and, where one hash has several texts, the
    texts themselves tell them apart, so a collision never joins two groups.

    Null or empty texts are one group (the empty text). A null id counts in
    group_size and is never smallest while another id is there; if all ids of a
    group are null, keep_id is null and those rows are kept. Rows that repeat both
    id and text are one document: all are returned with the same decision. Other
    columns of ``docs`` are not read, so their names can't clash.
    """
    rows = docs.select(F.col(key).alias("id"), normalised(F.col(text)).alias("norm"))
    rows = rows.select("id", "norm", F.unhex(F.md5("norm")).alias("hash"))
    # bytes are compared here: (hash, norm) is the grouping key, first combined in each task
    texts = rows.groupBy("hash", "norm").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    by_hash = stored(
        texts.groupBy("hash").agg(
            F.count(F.lit(1)).alias("n_texts"),
            F.min("keep_id").alias("keep_id"),
            F.sum("group_size").alias("group_size"),
            F.min(F.sha2("norm", 256)).alias("text_sha256"),
        ),
        "content-hashes",
    )
    # ids travel with the hash only
    out = rows.select("id", "hash").join(by_hash, "hash").select("id", "keep_id", "group_size", "text_sha256", "n_texts")
    if by_hash.where("n_texts > 1").head(1):
        # a collision: the rows of such a hash are told apart by their texts
        clashing = by_hash.where("n_texts > 1").select("hash")
        several = rows.join(clashing, "hash", "left_semi").join(texts, ["hash", "norm"])
        several = several.select("id", "keep_id", "group_size", F.sha2("norm", 256).alias("text_sha256"), F.lit(1).alias("n_texts"))
        out = out.where("n_texts = 1").unionByName(several)
    return out.select(
        F.col("id").alias(key),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
    )
