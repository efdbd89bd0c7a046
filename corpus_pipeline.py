"""The corpus pipeline: quality rules, line dedup, n-gram Jaccard join, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brineframe.llm.line_dedup import line_dedup
from brineframe.llm.mixing import mix_documents
from brineframe.llm.ngram_join import one_of_each
from brineframe.llm.packing import pack
from brineframe.llm.quality_rules import good_documents
from brineframe.llm.queries import tokenizer_file
from brineframe.session import prepare, stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass, without the lines that too many documents of their source hold."""
    return good_documents(docs)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that a document with a smaller id holds."""
    clean = line_dedup(docs)
    kinds = dict(docs.dtypes)
    return clean.select(
        *(
            F.col("kept_text").alias("text") if c == "text" else F.length("kept_text").cast(kinds[c]).alias(c) if c == "n_chars" else F.col(f"`{c}`")
            for c in docs.columns
        )
    )


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id."""
    return one_of_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mix_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 1024 tokens."""
    return pack(docs, tokenizer_file())


STAGES = [("quality rules", quality_rules), ("line dedup", drop_lines), ("n-gram join", near_duplicates), ("mixing", mixing), ("packing", packing)]

#: SQL has no tokenizer for the last stage; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
