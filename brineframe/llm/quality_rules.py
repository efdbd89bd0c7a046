"""Quality rules: lines that too many documents of one host repeat.

Lines are normalised and hashed; distinct documents are counted per host and line;
lines above the host's limit are removed, and a document that loses too much of its
words is rejected. Base rules on the text alone come first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import prepare, stored
from .words import SMALL_RUN, SPACES, Words, rolled, runs, windows

#: Characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
IS_SYMBOL = np.zeros(256, bool)
IS_SYMBOL[list(SYMBOLS)] = True
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")

#: A line is above its host's limit when more than MIN_DOCS documents and more than MAX_SHARE of the host's documents hold it.
MIN_DOCS, MAX_SHARE = 20, 0.1
#: A document is depleted when less than this share of its words is left.
MIN_LEFT = 0.3


def repeated_words(words: Words, n: int = 8) -> np.ndarray:
    """Per text: words in n-word windows that are found twice or more in that text."""
    at, edges = windows(words.bounds, n)
    out = np.zeros(len(words.bounds) - 1, np.int64)
    if not len(at):
        return out
    owner = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    key = rolled(words.hashes(), n)[at] ^ (owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    maybe = np.flatnonzero(pd.Series(key).duplicated(keep=False).to_numpy())
    if not len(maybe):
        return out
    # what the hashes found is compared word by word
    exact = np.column_stack([owner[maybe], *(words.codes[at[maybe] + j] for j in range(n))])
    exact = np.ascontiguousarray(exact).view(np.dtype((np.void, exact.shape[1] * 8))).ravel()
    _, inverse, counts = np.unique(exact, return_inverse=True, return_counts=True)
    hits = at[maybe[counts[inverse] > 1]]
    step = np.zeros(len(words) + 1, np.int64)
    np.add.at(step, hits, 1)
    np.add.at(step, hits + n, -1)
    covered = np.cumsum(step[:-1]) > 0
    np.add.at(out, words.owner()[covered], 1)
    return out


def _sum(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offs[1:]] - total[offs[:-1]]


def line_key(line: bytes) -> bytes:
    return line.strip(SPACES).translate(LOWER)


def line_words(text: bytes) -> tuple[int, dict[bytes, int]]:
    """Number of repeated lines, and the words of each line hash (repeats summed)."""
    seen: set[bytes] = set()
    repeats, own = 0, {}
    for line in text.split(b"\n"):
        n = len(line.split())
        if n:
            if line in seen:
                repeats += 1
            seen.add(line)
            k = xxhash.xxh3_128_digest(line_key(line))
            own[k] = own.get(k, 0) + n
    return repeats, own


def _base(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in runs(batch, size=SMALL_RUN):
            words = Words(part.column("text"))
            n_words = np.diff(words.bounds)
            inside = np.zeros(len(words.data) + 1, np.int8)
            inside[words.starts] += 1
            np.add.at(inside, words.ends, -1)
            chars = _sum((np.cumsum(inside[:-1]) > 0) & ((words.data & 0xC0) != 0x80), words.offs)
            symbols = _sum(IS_SYMBOL[words.data], words.offs)
            repeat = repeated_words(words)
            dup, keys, sizes, ends = [], [], [], [0]
            for i in range(part.num_rows):
                d, own = line_words(words.text(i))
                dup.append(d)
                keys += own.keys()
                sizes += own.values()
                ends.append(len(keys))
            lines = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(keys, pa.binary()), pa.array(sizes, pa.int64())], ["line", "words"]))
            failed = (n_words < 20) | (100 * repeat > 30 * n_words)
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in ("doc_id", "k1", "k2", "t1", "t2", "source")), pa.array(n_words, pa.int64()), pa.array(chars), pa.array(symbols), pa.array(dup, pa.int64()), pa.array(repeat), pa.array(failed), lines],
                ["doc_id", "k1", "k2", "t1", "t2", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "lines"],
            )


def _keyed(docs: DataFrame, host: str = "source", names: tuple[str, str] = ("k1", "k2")) -> DataFrame:
    """Two columns that stand for a row's id, text and host; rows equal in these get equal verdicts."""
    parts = [F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col(host).cast("string")]
    return docs.withColumn(names[0], F.xxhash64(*parts)).withColumn(names[1], F.xxhash64(F.lit(7), *parts[::-1]))


METRICS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def base_table(docs: DataFrame, host: str = "source") -> DataFrame:
    """Base measures and line hashes of each document, with a row number that later steps join on."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col(host).cast("string").alias("source"))
    keyed = _keyed(rows).withColumn("t1", F.xxhash64("text")).withColumn("t2", F.xxhash64(F.lit(7), "text"))
    base = keyed.mapInArrow(_base, "doc_id long, k1 long, k2 long, t1 long, t2 long, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, lines array<struct<line:binary,words:long>>")
    return stored(base.withColumn("row", F.monotonically_increasing_id()), "quality-base")


def frequent_lines(base: DataFrame, min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE, texts: bool = False) -> DataFrame:
    """source, line: the lines above their host's limit. Null hosts are a host. With ``texts``, copies
    of one text count once for each host, among the line's documents and the host's."""
    docs = F.count_distinct("t1", "t2") if texts else F.count(F.lit(1))
    per_line = base.select("source", "t1", "t2", F.explode("lines.line").alias("line")).groupBy("source", "line").agg(docs.alias("n")).where(F.col("n") > min_docs)
    hosts = base.groupBy("source").agg(docs.alias("docs")).withColumnRenamed("source", "host")
    return per_line.join(hosts, F.col("source").eqNullSafe(F.col("host"))).where(F.col("n") > F.col("docs") * max_share).select("source", "line")


def quality_rules(docs: DataFrame, host: str = "source", min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE, min_left: float = MIN_LEFT) -> DataFrame:
    """One row per document: the base measures, base_failed, n_removed (words in lines above
    their host's limit) and kept.

    Null and empty texts have no words and fail the base rules. Null hosts count as one
    host. Rows that repeat an id count as documents of their own. A limit is passed, not
    reached: a line goes when more than ``min_docs`` documents and more than ``max_share``
    of the host's documents hold it. A document with exactly ``min_left`` of its words
    left is kept. Columns other than doc_id, text and ``host`` are not read.
    """
    base = base_table(docs, host)
    return _judged(base, frequent_lines(base, min_docs, max_share), min_left).select(*METRICS, "n_removed", "kept")


def _judged(base: DataFrame, frequent: DataFrame, min_left: float) -> DataFrame:
    lines = base.select("row", "source", F.explode("lines").alias("l")).select("row", "source", F.col("l.line").alias("line"), F.col("l.words").alias("words"))
    often = frequent.select(F.col("source").alias("host"), F.col("line").alias("often"))
    lost = lines.join(often, (F.col("line") == F.col("often")) & F.col("source").eqNullSafe(F.col("host"))).groupBy("row").agg(F.sum("words").alias("lost"))
    out = base.drop("lines").join(lost, "row", "left").withColumn("n_removed", F.coalesce("lost", F.lit(0)).cast("long"))
    return out.withColumn("kept", ~F.col("base_failed") & ((F.col("n_words") - F.col("n_removed")) >= F.col("n_words") * min_left))


def _without_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in runs(batch, size=SMALL_RUN):
            texts = []
            for text, gone in zip(part.column("text").to_pylist(), part.column("__gone").to_pylist()):
                if gone:
                    gone = set(gone)
                    text = b"\n".join(x for x in text.encode().split(b"\n") if not x.strip(SPACES) or xxhash.xxh3_128_digest(line_key(x)) not in gone).decode()
                texts.append(text)
            names = [c for c in part.schema.names if c not in ("text", "__gone")]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(texts, pa.string())], [*names, "text"])


def good_documents(docs: DataFrame, host: str = "source", min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE, min_left: float = MIN_LEFT) -> DataFrame:
    """The documents that pass, without their lines above the limits; columns as in ``docs``, which
    has doc_id, text and ``host``. n_chars, if there, is the length of the new text. Copies of a
    text count once, so that a line is not boilerplate for being in a text that was copied.
    Column names that begin with ``__`` are ours."""
    base = base_table(docs, host)
    frequent = frequent_lines(base, min_docs, max_share, texts=True)
    judged = _judged(base, frequent, min_left).where("kept").select("k1", "k2", "source", "row")
    often = frequent.select(F.col("source").alias("host"), F.col("line").alias("often"))
    lines = base.select("row", "source", F.explode("lines.line").alias("line"))
    gone = lines.join(often, (F.col("line") == F.col("often")) & F.col("source").eqNullSafe(F.col("host"))).groupBy("row").agg(F.collect_set("line").alias("gone"))
    keep = judged.join(gone, "row", "left").groupBy("k1", "k2").agg(F.max("gone").alias("__gone")).withColumnsRenamed({"k1": "__k1", "k2": "__k2"})
    rows = _keyed(docs, host, ("__k1", "__k2")).join(keep, ["__k1", "__k2"]).drop("__k1", "__k2")
    order = [c for c in docs.columns if c != "text"] + ["text"]
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    out = rows.select(*(F.col(f"`{c}`") for c in order), "__gone").mapInArrow(_without_lines, ", ".join(f"`{c}` {kinds[c]}" for c in order))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(kinds["n_chars"]))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))
