"""Substring dedup: windows of words that start more than once, found by super-k-mers.

Consecutive windows with the same minimiser (the smallest hash of the short
m-word runs inside the window) form a super-k-mer. Equal windows have equal
minimisers, so all copies of a window meet in the bucket of its minimiser:

1. each text gives its super-k-mers' minimisers (numbers only); a minimiser seen
   once in the corpus can't hold a repeated window, and is done;
2. super-k-mers of the others travel as one packed string each; equal strings are
   combined before the shuffle and again after it;
3. in its bucket a string is cut into windows; sorting (prefix doubling over word
   numbers, no hashes) counts the equal ones exactly;
4. the windows that were counted more than once go back to their documents.

A passage that very many documents share leaves a bucket of strings that differ at its
edges only. A bucket of more words than a task shall sort is split by the hash of the
window: its strings are cut into windows first, and each part is sorted and counted as
any other bucket. So no task holds more than a bounded number of words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import prepare, stored
from .words import Words, ranks, rolled, runs, windows

#: Words of the short runs whose hashes compete for minimiser.
SHORT = 8
#: Words of a bucket's strings from which it is split, and words that are sorted at once.
BUCKET_WORDS, SORT_WORDS = 250_000, 2_000_000
#: Bytes of different strings of a task that are combined at a time, and windows of strings that are made at a time.
COMBINE, MADE = 24 << 20, 20_000


def _smallest(values: np.ndarray, n: int) -> np.ndarray:
    """The smallest of each n consecutive values."""
    span = 1
    while span < n and len(values):
        step = min(span, n - span)
        values = np.minimum(values[: max(len(values) - step, 0)], values[step:])
        span += step
    return values


def super_kmers(words: Words, window: int, short: int) -> tuple[np.ndarray, ...]:
    """Text, first window, number of windows, minimiser, and 1 (or 2 where the minimiser's run of
    words may occur twice inside) of each super-k-mer."""
    at, edges = windows(words.bounds, window)
    empty = np.zeros(0, np.int64)
    if not len(at):
        return empty, empty, empty, empty, empty
    hashes = rolled(words.hashes(), short)
    least = _smallest(hashes, window - short + 1)[at]
    owner = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    new = np.ones(len(at), bool)
    new[1:] = (least[1:] != least[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(at)))
    twice = np.unique(hashes[pd.Series(hashes).duplicated().to_numpy()])
    weight = 1 + np.isin(least[first], twice)
    return owner[first], at[first] - words.bounds[owner[first]], n, least[first].view(np.int64), weight.astype(np.int64)


def _lists(values: np.ndarray, owner: np.ndarray, size: int, kind) -> pa.ListArray:
    ends = np.zeros(size + 1, np.int32)
    np.cumsum(np.bincount(owner, minlength=size), out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values, kind))


def _minimisers(window: int, short: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in runs(batch):
                words = Words(part.column("text"))
                owner, _, _, least, weight = super_kmers(words, window, short)
                has = np.bincount(owner, minlength=part.num_rows) > 0
                out = pa.RecordBatch.from_arrays(
                    [part.column("k1"), part.column("k2"), _lists(least, owner, part.num_rows, pa.int64()), _lists(weight, owner, part.num_rows, pa.int32())],
                    ["k1", "k2", "mins", "weights"],
                )
                yield out.filter(pa.array(has))

    return run


def _kept(words: list[bytes], gone: np.ndarray | None) -> str:
    left = words if gone is None else [w for w, g in zip(words, gone) if not g]
    return hashlib.sha256(b" ".join(left)).hexdigest()


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The result of documents without a suspect; the others keep their text for later."""
    for batch in batches:
        for part in runs(batch):
            suspect = part.column("marks").is_valid().to_pylist()
            n, sha, left = [], [], []
            for text, later in zip(part.column("text").cast(pa.binary()).to_pylist(), suspect):
                words = (text or b"").split()
                n.append(len(words))
                sha.append(None if later else _kept(words, None))
                left.append(text if later else None)
            text = pa.array(left, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [part.column(c) for c in ("doc_id", "k1", "k2")] + [pa.array(n, pa.int64()), pa.array(sha, pa.string()), text, part.column("marks")],
                ["doc_id", "k1", "k2", "n_words", "kept_sha256", "text", "marks"],
            )


def _packed(window: int, short: int):
    """A row for each suspect super-k-mer, with its words as one string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in runs(batch):
                words = Words(part.column("text"))
                owner, start, n, least, _ = super_kmers(words, window, short)
                k1, k2, marks = (part.column(c).to_pylist() for c in ("k1", "k2", "marks"))
                rank = np.arange(len(owner)) - np.searchsorted(owner, owner)
                out: dict[str, list] = {c: [] for c in ("least", "packed", "s1", "s2", "k1", "k2", "start", "n")}
                for i, mark in enumerate(marks):
                    if not mark:
                        continue
                    own = words.text(i).split()
                    lo, hi = np.searchsorted(owner, [i, i + 1])
                    for j in lo + np.flatnonzero(np.isin(rank[lo:hi], mark)):
                        a = int(start[j])
                        packed = b" ".join(own[a : a + int(n[j]) + window - 1])
                        both = xxhash.xxh3_128_intdigest(packed)
                        for c, v in zip(out, (int(least[j]), packed, (both >> 64) - (1 << 63), (both & (1 << 64) - 1) - (1 << 63), k1[i], k2[i], a, int(n[j]))):
                            out[c].append(v)
                if out["k1"]:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(v, pa.binary()).cast(pa.string()) if c == "packed" else pa.array(v, pa.int32() if c in ("start", "n") else pa.int64()) for c, v in out.items()], list(out)
                    )

    return run


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal strings of a task as one row with their number, a bounded number of bytes at a time."""
    held: dict[tuple, int] = {}
    size = 0

    def flush() -> pa.RecordBatch:
        columns = list(zip(*held)) or [()] * 5
        kinds = (pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64())
        out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)] + [pa.array(list(held.values()), pa.int64())], ["least", "part", "packed", "s1", "s2", "times"])
        held.clear()
        return out

    for batch in batches:
        for *row, times in zip(*(batch.column(c).to_pylist() for c in ("least", "part", "packed", "s1", "s2", "times"))):
            row = tuple(row)
            if row in held:
                held[row] += times
            else:
                held[row] = times
                size += len(row[2])
                if size >= COMBINE:
                    yield flush()
                    size = 0
    yield flush()


def _counted(window: int):
    """Of strings sorted by bucket: which of their windows are there more than once."""

    def flush(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        words = Words(pa.concat_arrays(table.column("packed").chunks))
        at, edges = windows(words.bounds, window)
        owner = np.repeat(np.arange(table.num_rows), np.diff(edges))
        rank = ranks(words.codes, window)[at]
        times = table.column("times").to_numpy()
        often = np.bincount(rank, weights=times[owner])[rank] >= 2
        dup = _lists((np.arange(len(at)) - edges[owner])[often], owner[often], table.num_rows, pa.int32())
        out = pa.RecordBatch.from_arrays([table.column("s1").combine_chunks(), table.column("s2").combine_chunks(), dup], ["s1", "s2", "dups"])
        return out.filter(pa.array(np.bincount(owner[often], minlength=table.num_rows) > 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            least, part = batch.column("least").to_numpy(), batch.column("part").to_numpy()
            change = np.flatnonzero((least[1:] != least[:-1]) | (part[1:] != part[:-1])) + 1
            edges = [0, *change.tolist(), batch.num_rows]
            if held and size >= SORT_WORDS and (held[-1].column("least")[-1].as_py(), held[-1].column("part")[-1].as_py()) != (least[0], part[0]):
                yield flush(held)
                held, size = [], 0
            spaces = np.cumsum(np.append(0, pa.compute.count_substring(batch.column("packed"), " ").to_numpy() + 1))
            begun = 0
            for a, b in zip(edges, edges[1:]):
                size += int(spaces[b] - spaces[a])
                if size >= SORT_WORDS and b < batch.num_rows:
                    held.append(batch.slice(begun, b - begun))
                    yield flush(held)
                    held, size, begun = [], 0, b
            held.append(batch.slice(begun))
        if held:
            yield flush(held)

    return run


def _windows(window: int):
    """Each window of the strings of split buckets as a row, with the part that its hash falls into."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("least", "part", "packed", "w1", "w2", "s1", "s2", "at", "times")
        kinds = (pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
        rows: list[tuple] = []

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * len(names), kinds)], list(names))
            rows.clear()
            return out

        for batch in batches:
            for least, parts, packed, a, b, n in zip(*(batch.column(c).to_pylist() for c in ("least", "parts", "packed", "s1", "s2", "times"))):
                words = packed.split(" ")
                for k in range(len(words) - window + 1):
                    own = " ".join(words[k : k + window])
                    both = xxhash.xxh3_128_intdigest(own)
                    rows.append((least, (both >> 64) % parts, own, (both >> 64) - (1 << 63), (both & (1 << 64) - 1) - (1 << 63), a, b, k, n))
                    if len(rows) >= MADE:
                        yield flush()
        yield flush()

    return run


def _repeated(strings: DataFrame, window: int) -> DataFrame:
    """s1, s2, dups: the windows of strings (least, part, packed, s1, s2, times) that their bucket's part holds more than once."""
    parts = int(strings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    combined = strings.select("least", "part", "packed", "s1", "s2", "times").mapInArrow(_combined, "least long, part int, packed string, s1 long, s2 long, times long")
    dups = combined.repartition(parts, "least", "part").sortWithinPartitions("least", "part").mapInArrow(_counted(window), "s1 long, s2 long, dups array<int>")
    return dups.groupBy("s1", "s2").agg(F.any_value("dups").alias("dups"))  # a string of several tasks came back several times


def _removed(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in runs(batch):
                n, sha = [], []
                for text, total, old, dups in zip(part.column("text").cast(pa.binary()).to_pylist(), part.column("n_words").to_pylist(), part.column("kept_sha256").to_pylist(), part.column("dups").to_pylist()):
                    if old is not None:
                        n.append(0)
                        sha.append(old)
                        continue
                    step = np.zeros(total + 1, np.int64)
                    starts = np.unique(np.array([x for xs in dups or () for x in xs], np.int64))
                    step[starts] += 1
                    np.subtract.at(step, starts + window, 1)
                    gone = np.cumsum(step[:-1]) > 0
                    n.append(int(gone.sum()))
                    sha.append(_kept((text or b"").split(), gone))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_words"), pa.array(n, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return run


def marked_windows(docs: DataFrame, window: int = 35, short: int = SHORT) -> DataFrame:
    """doc_id, k1, k2, n_words, kept_sha256 and text (one of them null), dups (lists of window starts).

    ``text`` is there for documents that may lose words, ``kept_sha256`` for the others."""
    prepare(docs.sparkSession)
    if not 1 <= short <= window:
        raise ValueError("short must be from 1 to window")
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # (k1, k2) stands for id and text; rows that repeat both share it and are treated alike
    keyed = keyed.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64(F.lit(7), "text", "doc_id").alias("k2"))
    mins = stored(keyed.select("k1", "k2", "text").mapInArrow(_minimisers(window, short), "k1 long, k2 long, mins array<long>, weights array<int>"), "minimisers")
    flat = mins.select("k1", "k2", F.posexplode(F.arrays_zip("mins", "weights")).alias("place", "z")).select("k1", "k2", "place", F.col("z.mins").alias("least"), F.col("z.weights").alias("weight"))
    shared = flat.groupBy("least").agg(F.sum("weight").alias("n")).where("n > 1").select("least")
    marks = flat.select("k1", "k2", "place", "least").join(shared, "least", "left_semi").groupBy("k1", "k2").agg(F.collect_set("place").alias("marks"))
    settled = stored(
        keyed.join(marks, ["k1", "k2"], "left")
        .select("doc_id", "k1", "k2", "text", "marks")
        .mapInArrow(_settled, "doc_id long, k1 long, k2 long, n_words long, kept_sha256 string, text string, marks array<int>"),
        "settled",
    )
    packed = stored(
        settled.where("marks is not null").select("k1", "k2", "text", "marks").mapInArrow(_packed(window, short), "least long, packed string, s1 long, s2 long, k1 long, k2 long, start int, n int"),
        "super-k-mers",
    )
    # words of the different strings of each bucket; of one that is too large, the parts that its windows are dealt to
    each = packed.groupBy("least", "s1", "s2").agg(F.max("n").alias("n")).groupBy("least").agg(F.sum("n").alias("n"), F.sum(F.col("n") + window - 1).alias("words"))
    large = each.where(F.col("words") > BUCKET_WORDS).select("least", F.ceil(F.col("n") * window / BUCKET_WORDS).cast("int").alias("parts"))
    large = stored(large, "large-buckets")
    some = bool(large.head(1))
    whole = packed.join(large, "least", "left_anti") if some else packed
    dups = _repeated(whole.withColumn("part", F.lit(0)).withColumn("times", F.lit(1).cast("long")), window)
    if some:
        strings = packed.join(large, "least").groupBy("least", "parts", "packed", "s1", "s2").agg(F.count(F.lit(1)).alias("times"))
        cut = stored(strings.mapInArrow(_windows(window), "least long, part int, packed string, w1 long, w2 long, s1 long, s2 long, at int, times long"), "cut-windows")
        often = _repeated(cut.withColumn("s1", F.col("w1")).withColumn("s2", F.col("w2")), window)
        back = cut.select("w1", "w2", "s1", "s2", "at").join(stored(often.select(F.col("s1").alias("w1"), F.col("s2").alias("w2")), "often"), ["w1", "w2"])
        dups = dups.unionByName(back.groupBy("s1", "s2").agg(F.collect_set("at").alias("dups")))
    found = (
        packed.select("s1", "s2", "k1", "k2", "start")
        .join(dups, ["s1", "s2"])
        .groupBy("k1", "k2")
        .agg(F.collect_set(F.transform("dups", lambda d: d + F.col("start"))).alias("dups"))
    )
    return settled.drop("marks").join(found, ["k1", "k2"], "left")


def substring_dedup(docs: DataFrame, window: int = 35, short: int = SHORT) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256 of what is left of its words.

    Words are ``[^\\x20\\x09-\\x0D]+``. A word goes if a window of ``window`` words that
    covers it starts at any other place too, in the same document or another.

    Null and empty texts have no words. Texts shorter than a window lose nothing.
    Rows that repeat an id and a text are separate documents with equal results (each
    is the other's copy). Null ids are kept as they are. Other columns are not read.
    """
    return marked_windows(docs, window, short).select("doc_id", "n_words", "kept_sha256", "text", "dups").mapInArrow(_removed(window), "doc_id long, n_words long, n_removed long, kept_sha256 string")
