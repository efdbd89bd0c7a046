"""Quality classifier: ridge regression on random Fourier features, then isotonic calibration.

Features are statistics of the text alone. Random Fourier features approximate a
Gaussian kernel over them; every partition adds up its share of the normal
equations, the shares are summed by row of the matrix, and only the sum comes to the
driver. A fold that the ridge never saw calibrates its scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import prepare, stored
from .quality_rules import IS_SYMBOL, _sum, line_words, repeated_words
from .words import Words, runs

FEATURES = [
    "log words", "log bytes", "letters a word", "spread of word lengths", "longest word", "symbols", "digits", "capitals", "stops and commas", "bars",
    "beyond ascii", "words seen in 8-word runs before", "repeated lines", "log lines", "log words a line", "different words", "most frequent word",
    "entropy of words", "word after itself", "one-letter words", "words with a symbol", "lines that end in a stop",
]
#: Width of the kernel in standard deviations, number of random features, strength of the ridge, bins of the calibration.
SCALE, RANDOM, RIDGE, BINS = 4.0, 256, 1e-3, 2000
#: Partitions whose equations are added up first.
GROUP = 256


def features(words: Words, lines: list[tuple[int, int, int]]) -> np.ndarray:
    """A row for each text; ``lines``: number of lines with a word, of repeated ones, of those that end in a stop."""
    n_texts = len(words.bounds) - 1
    n = np.diff(words.bounds).astype(float)
    size = np.diff(words.offs).astype(float)
    per = lambda flags: _sum(flags, words.offs)
    words_of = lambda flags: _sum(flags, words.bounds)
    data, owner = words.data, words.owner()
    some, any_byte = np.maximum(n, 1), np.maximum(size, 1)
    length = (words.ends - words.starts).astype(float)
    mean = words_of(length) / some if len(length) else np.zeros(n_texts)
    square = words_of(length * length) / some if len(length) else np.zeros(n_texts)
    longest = np.zeros(n_texts)
    np.maximum.at(longest, owner, length)
    pairs, times = np.unique(owner * np.int64(len(words.vocab) + 1) + words.codes, return_counts=True)
    of = pairs // (len(words.vocab) + 1)
    different = np.bincount(of, minlength=n_texts)
    top = np.zeros(n_texts)
    np.maximum.at(top, of, times)
    share = times / some[of]
    entropy = np.bincount(of, weights=-share * np.log(share), minlength=n_texts)
    again = np.zeros(len(words), bool)
    again[1:] = (words.codes[1:] == words.codes[:-1]) & (owner[1:] == owner[:-1])
    marked = np.add.reduceat(IS_SYMBOL[data].astype(np.int64), words.starts) > 0 if len(words) else np.zeros(0, bool)
    lines_of, repeats, stops = (np.array(x, float) for x in zip(*lines)) if lines else (np.zeros(0),) * 3
    some_lines = np.maximum(lines_of, 1)
    return np.column_stack([
        np.log1p(n), np.log1p(size), mean, np.sqrt(np.maximum(square - mean * mean, 0)), np.log1p(longest),
        per(IS_SYMBOL[data]) / any_byte, per((data >= 48) & (data < 58)) / any_byte, per((data >= 65) & (data < 91)) / any_byte, per((data == 46) | (data == 44)) / any_byte, per(data == 124) / any_byte,
        per(data >= 128) / any_byte, repeated_words(words) / some, repeats / some_lines, np.log1p(lines_of), np.log1p(n / some_lines), different / some, top / some,
        entropy / np.log(np.maximum(n, 2)), words_of(again) / some, words_of(length == 1) / some, words_of(marked) / some, stops / some_lines,
    ])


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in runs(batch):
            words = Words(part.column("text"))
            lines = []
            for i in range(part.num_rows):
                text = words.text(i)
                full = [x for x in map(bytes.rstrip, text.split(b"\n")) if x]
                lines.append((len(full), line_words(text)[0], sum(x[-1] == 46 for x in full)))
            rows = features(words, lines)
            flat = pa.FixedSizeListArray.from_arrays(pa.array(rows.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), flat], ["doc_id", "features"])


def featured(docs: DataFrame) -> DataFrame:
    prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_featured, "doc_id long, features array<double>")


def remainder(key: Column) -> Column:
    """crc32 of the id as text, mod 5; a null id counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 5


@dataclass
class Model:
    mean: np.ndarray
    spread: np.ndarray
    waves: np.ndarray
    shifts: np.ndarray
    weights: np.ndarray
    steps: np.ndarray
    levels: np.ndarray

    def design(self, rows: np.ndarray) -> np.ndarray:
        z = np.clip((rows - self.mean) / self.spread, -6, 6)
        return np.hstack([np.ones((len(z), 1)), z, np.cos(z @ self.waves + self.shifts) * np.sqrt(2 / max(len(self.shifts), 1))])

    def raw(self, rows: np.ndarray) -> np.ndarray:
        return self.design(rows) @ self.weights

    def score(self, rows: np.ndarray) -> np.ndarray:
        raw = self.raw(rows)
        return np.clip(np.interp(raw, self.steps, self.levels) if len(self.steps) else raw, 0, 1)


def _rows(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("features").flatten().to_numpy().reshape(batch.num_rows, -1)


def _equations(model: Model):
    """One row for each row of the normal equations (the right side last), summed over the partition;
    ``group`` is that of the partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                x = model.design(_rows(batch))
                both = x.T @ np.column_stack([x, batch.column("label").to_numpy()])
                total = both if total is None else total + both
        if total is not None:
            group = np.full(len(total), TaskContext.get().partitionId() // GROUP, np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(group), pa.array(list(total), pa.list_(pa.float64()))], ["at", "group", "values"])

    return run


def _added(rows: pd.DataFrame) -> pd.DataFrame:
    # in an order that reruns share, whatever order the partitions arrive in
    values = np.sort(np.stack(list(rows["values"])), axis=0).sum(0)
    return pd.DataFrame({"at": [rows["at"].iloc[0]], "values": [values]})


def isotonic(means: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The nearest non-decreasing values: pool adjacent violators."""
    blocks: list[list[float]] = []
    for m, w in zip(means, weights):
        blocks.append([m, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            (m1, w1, n1), (m2, w2, n2) = blocks[-2:]
            blocks[-2:] = [[(m1 * w1 + m2 * w2) / (w1 + w2), w1 + w2, n1 + n2]]
    return np.repeat([b[0] for b in blocks], [int(b[2]) for b in blocks])


def _scored(model: Model, raw: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [c for c in batch.schema.names if c != "features"]
            rows = _rows(batch) if batch.num_rows else np.zeros((0, len(FEATURES)))
            score = model.raw(rows) if raw else model.score(rows)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(score)], [*names, "score"])

    return run


def fit(rows: DataFrame, seed: int = 0) -> Model:
    """From rows (features, label double, fold int): fold 1 calibrates, the others fit the ridge. All
    rows are used; those of fold 1 are pooled in BINS equal-width bins of their ridge score (a bounded number for the driver) before the
    isotonic fit. Without rows every score is 0.5; without rows in fold 1 scores are the ridge's."""
    each = [F.col("features")[k] for k in range(len(FEATURES))]
    found = rows.where("fold <> 1").agg(F.count(F.lit(1)), *(F.round(F.avg(x), 9) for x in each), *(F.round(F.stddev_pop(x), 9) for x in each)).first()
    k = len(FEATURES)
    none = np.zeros(0)
    if not found[0]:
        return Model(np.zeros(k), np.ones(k), np.zeros((k, 0)), none, np.append(0.5, np.zeros(k)), none, none)
    mean, spread = np.array(found[1 : k + 1], float), np.array(found[k + 1 :], float)
    spread[spread < 1e-9] = 1
    random = np.random.default_rng(seed)
    model = Model(mean, spread, random.normal(0, 1 / SCALE, (k, RANDOM)), random.uniform(0, 2 * np.pi, RANDOM), none, none, none)
    sums = rows.where("fold <> 1").select("features", "label").mapInArrow(_equations(model), "at int, group int, values array<double>")
    # first within groups of partitions, so that no task holds a row of all of them
    sums = sums.groupBy("at", "group").applyInPandas(_added, "at int, values array<double>")
    sums = sums.groupBy("at").applyInPandas(_added, "at int, values array<double>").orderBy("at").collect()
    both = np.array([r["values"] for r in sums])
    model.weights = np.linalg.solve(both[:, :-1] + np.diag([1e-9] + [RIDGE * found[0]] * (len(both) - 1)), both[:, -1])
    raw = rows.where("fold = 1").select("label", "features").mapInArrow(_scored(model, raw=True), "label double, score double")
    place = F.least(F.greatest(F.floor((F.col("score") + 0.5) * (BINS / 2)), F.lit(0)), F.lit(BINS - 1))
    bins = raw.groupBy(place.alias("bin")).agg(F.avg("score").alias("score"), F.avg("label").alias("label"), F.count(F.lit(1)).alias("n")).orderBy("bin").collect()
    if bins:
        model.steps = np.array([r["score"] for r in bins])
        model.levels = isotonic(np.array([r["label"] for r in bins]), np.array([r["n"] for r in bins], float))
    return model


def quality_scores(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.3) -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1, higher: label 1 likelier), predicted.

    Only labels of documents whose crc32(doc_id as text) mod 5 is not 0 are learned from; of
    several labels of one id their mean is taken, null labels and null ids are no labels. Null
    and empty texts have all features 0 and are scored like others. Rows that repeat an id are
    scored one by one. A null id counts as held out if crc32 of the empty text says so (it does).
    Columns other than doc_id and text aren't read: language and source are no inputs.
    """
    made = stored(featured(docs), "features")
    marks = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg(F.col(label).cast("double")).alias("label"))
    fold = remainder(F.col("doc_id")).cast("int")
    learn = stored(made.join(marks.where(remainder(F.col("doc_id")) != 0), "doc_id").select("features", "label", fold.alias("fold")), "labelled")
    model = fit(learn)
    out = made.mapInArrow(_scored(model), "doc_id long, score double")
    return out.select("doc_id", (remainder(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
