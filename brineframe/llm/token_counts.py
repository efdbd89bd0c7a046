"""Token counts: rollups by source, language and tokenizer version, kept by signed deltas."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import prepare, stored
from ..sources.ledger import Batch, Ledger
from .tokens import encoder
from .words import Words, runs

GROUP = ["source", "lang", "version"]
SUMS = ["docs", "tokens", "chars"]
#: Documents for which a rollup has a folder of entries, and the fewest folders.
FOLDER_DOCS, LEAST_FOLDERS = 250_000, 8


def _counter(versions: Mapping[str, str | None]):
    """Counts of each text by each version; a version without a file counts words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in runs(batch):
                text = part.column("text")
                chars = pa.compute.utf8_length(text).fill_null(0).cast(pa.int64())
                for version, path in versions.items():
                    bounds = Words(text).bounds if path is None else encoder(path)(text)[1]
                    yield pa.RecordBatch.from_arrays(
                        [part.column("doc_id"), part.column("source"), part.column("lang"), pa.array([version] * part.num_rows, pa.string()), pa.array(np.diff(bounds).astype(np.int64)), chars],
                        ["doc_id", "source", "lang", "version", "tokens", "chars"],
                    )

    return run


class TokenRollup:
    """Totals at ``path``, changed by batches of inserts, revisions and deletes.

    ``versions`` maps a tokenizer version to its tokenizers file (None: words
    ``[^\\x20\\x09-\\x0D]+``). State: ``entries`` holds signed rows per document, in folders by a
    hash of its id; ``deltas`` their sums per group and batch; totals are the sums of the
    deltas. A batch opens the entries of the folders that its ids fall into and no others.
    ``folders`` holds for the whole rollup: take one for each FOLDER_DOCS documents that it shall have.
    """

    ENTRY = "doc_id long, source string, lang string, version string, docs long, tokens long, chars long"
    DELTA = "source string, lang string, version string, docs long, tokens long, chars long"

    def __init__(self, spark: SparkSession, path: str, versions: Mapping[str, str | None], folders: int = LEAST_FOLDERS):
        self.spark, self.log, self.versions = prepare(spark), Ledger(spark, path), dict(versions)
        self.folders = self.log.fixed("folders", folders)

    def counts(self, docs: DataFrame) -> DataFrame:
        """One positive entry per document, group and version; rows that repeat an id add up."""
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.col(c).cast("string").alias(c) for c in ("text", "source", "lang")))
        each = rows.mapInArrow(_counter(self.versions), "doc_id long, source string, lang string, version string, tokens long, chars long")
        return each.groupBy("doc_id", *GROUP).agg(F.count(F.lit(1)).alias("docs"), F.sum("tokens").alias("tokens"), F.sum("chars").alias("chars"))

    def _folder(self):
        """Where a document's entries are; those of null ids, which are never looked up, are spread."""
        return F.pmod(F.when(F.col("doc_id").isNull(), F.xxhash64("tokens", "chars")).otherwise(F.xxhash64("doc_id")), F.lit(self.folders)).cast("int")

    def _standing(self, batch: Batch, ids: DataFrame) -> DataFrame:
        """What the batches before this one say about some documents (doc_id, folder)."""
        folders = [r[0] for r in ids.select("folder").distinct().collect()]
        known = batch.read("entries", f"{self.ENTRY}, folder int", by="folder", some=folders).join(ids.select("doc_id"), "doc_id", "left_semi")
        return known.groupBy("doc_id", *GROUP).agg(*(F.sum(c).alias(c) for c in SUMS)).where("docs <> 0 or tokens <> 0 or chars <> 0")

    def apply(self, batch: str, upserts: DataFrame | None = None, deletes: DataFrame | None = None) -> bool:
        """Commits a batch: ``upserts`` (doc_id, text, source, lang) replace what those ids had,
        ``deletes`` (doc_id) take it out. False, and no change, if the batch name was committed before.
        Batches of several writers follow one another: see ``ledger``.

        Null ids only add: they can't be revised or deleted. An id in both is an upsert. Null
        texts count no tokens; null sources and languages are groups of their own.
        """
        if self.log.begin(batch) is None:
            return False
        new = stored(self.counts(upserts), "token-counts") if upserts is not None else self.spark.createDataFrame([], self.ENTRY)
        ids = new.select("doc_id")
        if deletes is not None:
            ids = ids.unionByName(deletes.select(F.col("doc_id").cast("long").alias("doc_id")))
        ids = ids.where("doc_id is not null").distinct().withColumn("folder", F.pmod(F.xxhash64("doc_id"), F.lit(self.folders)).cast("int"))

        def work(own: Batch) -> None:
            signed = new.select("doc_id", *GROUP, *SUMS)
            if own.state:
                old = self._standing(own, ids)
                signed = signed.unionByName(old.select("doc_id", *GROUP, *((-F.col(c)).alias(c) for c in SUMS)))
            own.write("entries", signed.withColumn("folder", self._folder()).repartition(self.folders, "folder"), "folder")
            entries = own.own("entries", f"{self.ENTRY}, folder int")
            own.write("deltas", entries.groupBy(*GROUP).agg(*(F.sum(c).alias(c) for c in SUMS)))

        return self.log.apply(batch, work)

    def totals(self) -> DataFrame:
        """source, lang, version, docs, tokens, chars; groups without documents are left out."""
        return self.log.read("deltas", self.DELTA).groupBy(*GROUP).agg(*(F.sum(c).alias(c) for c in SUMS)).where("docs <> 0")


def folders_for(docs: DataFrame) -> int:
    """Folders for a rollup of some documents; counting them reads no column."""
    return max(LEAST_FOLDERS, ceil(docs.count() / FOLDER_DOCS))


def token_counts(docs: DataFrame, path: str, versions: Mapping[str, str | None], again: int = 16) -> TokenRollup:
    """A new rollup of ``docs`` that has seen every kind of change: two insert batches by a hash of the id, a
    deletion of one id in ``again``, and a last batch that inserts these anew and revises another one in
    ``again``. Its totals are those of ``docs``. Null ids are inserted once and left alone."""
    rollup = TokenRollup(docs.sparkSession, path, versions, folders_for(docs))
    draw = F.xxhash64(F.col("doc_id").cast("long"))
    sample = F.pmod(F.shiftrightunsigned(draw, 20), F.lit(again))
    for k in range(2):
        rollup.apply(f"part {k}", docs.where(F.pmod(draw, F.lit(2)) == k))
    known = docs.where("doc_id is not null")
    rollup.apply("taken out", deletes=known.where(sample == 0))
    rollup.apply("put back and revised", known.where(sample < 2))
    return rollup
