"""Runs of words that repeat with a period: tandem repeats found with a suffix tree.

The linear method of Gusfield and Stoye, over word numbers instead of letters:

1. Lempel-Ziv blocks of the text; squares (a string twice in a row) whose left half ends in a block
   are found by extending from the block's two borders, which covers the leftmost place of each.
2. From each of these squares the walk goes on to its rotations: along the text while they lie there, then
   by the suffix link of its place in the tree and the branch with the right word, until the place is
   marked already. That completes the vocabulary: every different square with a primitive root.
3. The leaves below a square's place are all its occurrences. Squares of one period that start at
   consecutive words merge into a run.

The tree is its suffix array with the lengths of common prefixes: a place of the tree is a range of
leaves and a depth, found by range minima. All steps handle all texts of a batch at once; only block
borders are walked one by one.

Before that, words that no repeated window of half the least length covers are put aside: such a word is in no
run, and no run goes across it. What is left falls into stretches, each a string of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import prepare
from .words import Words, mix, rolled, runs, windows

LEAST = 12
#: Words of the stretches that one tree holds; a longer stretch has a tree of its own.
TREE_WORDS = 1 << 18


def _minima(values: np.ndarray) -> list[np.ndarray]:
    """[k][i]: the least of values[i : i + (1 << k)]."""
    out = [values]
    while len(out[-1]) > 1 << len(out) - 1:
        half = 1 << len(out) - 1
        out.append(np.minimum(out[-1][:-half], out[-1][half:]))
    return out


def _reach_down(minima: list[np.ndarray], at: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """For each place ``at`` the least place p with values[p : at] all at ``limit`` or more."""
    at = at.copy()
    for k in range(len(minima) - 1, -1, -1):
        to = at - (1 << k)
        fine = to >= 0
        fine[fine] = minima[k][to[fine]] >= limit[fine]
        at[fine] = to[fine]
    return at


def _reach_up(minima: list[np.ndarray], at: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """For each place ``at`` the greatest place p with values[at : p] all at ``limit`` or more."""
    at, n = at.copy(), len(minima[0])
    for k in range(len(minima) - 1, -1, -1):
        fine = at + (1 << k) <= n
        fine[fine] = minima[k][at[fine]] >= limit[fine]
        at[fine] += 1 << k
    return at


class SuffixTree:
    """Of a sequence of numbers whose last one occurs once. ``leaves`` are its suffixes in order."""

    def __init__(self, codes: np.ndarray):
        n = self.size = len(codes)
        rank, span = np.unique(codes, return_inverse=True)[1].astype(np.int64), 1
        levels = [rank.astype(np.int32)]
        while int(rank.max(initial=0)) + 1 < n:
            pair = rank * (n + 1)
            pair[: n - span] += rank[span:] + 1
            rank, span = np.unique(pair, return_inverse=True)[1].astype(np.int64), 2 * span
            levels.append(rank.astype(np.int32))
        #: [k, i]: a number of the 1 << k codes from i on, equal for equal ones only.
        self.levels, self.rank, self.codes = np.stack(levels), rank, levels[0]
        self.leaves = np.empty(n, np.int64)
        self.leaves[rank] = np.arange(n)
        self.common = np.zeros(n, np.int64)
        if n > 1:
            self.common[1:] = self.ahead(self.leaves[:-1], self.leaves[1:])
        self._common = _minima(self.common)

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many codes the suffixes from i and j share (i <> j)."""
        i, j, start = i.copy(), j.copy(), i
        for k in range(len(self.levels) - 1, -1, -1):
            step = (self.levels[k][i] == self.levels[k][j]).astype(np.int64) << k
            i += step
            j += step
        return i - start

    def back(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many codes the prefixes up to and with i and j share (-1: an empty prefix)."""
        i, j, start = i.copy(), j.copy(), i
        for k in range(len(self.levels) - 1, -1, -1):
            a, b = i - (1 << k) + 1, j - (1 << k) + 1
            fine = (a >= 0) & (b >= 0)
            fine[fine] = self.levels[k][a[fine]] == self.levels[k][b[fine]]
            step = fine.astype(np.int64) << k
            i -= step
            j -= step
        return start - i

    def same(self, i: np.ndarray, j: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether ``length`` >= 1 codes from i and j on are equal (i <> j)."""
        k = np.frexp(length)[1] - 1
        known = k < len(self.levels)
        k = np.where(known, k, 0)
        rest = length - (np.int64(1) << k)
        return known & (self.levels[k, i] == self.levels[k, j]) & (self.levels[k, i + rest * known] == self.levels[k, j + rest * known])

    def place(self, at: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of leaves below the place of codes[at : at + depth]."""
        rank = self.rank[at]
        return _reach_down(self._common, rank + 1, depth) - 1, _reach_up(self._common, rank + 1, depth)

    def branch(self, low: np.ndarray, high: np.ndarray, depth: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Of the leaves low:high, which share ``depth`` codes, one that goes on with ``code``; -1 if none does."""
        lo, hi, left = low.copy(), high.copy(), np.flatnonzero(low < high)
        while len(left):
            mid = (lo[left] + hi[left]) // 2
            less = self.codes[self.leaves[mid] + depth[left]] < code[left]
            lo[left] = np.where(less, mid + 1, lo[left])
            hi[left] = np.where(less, hi[left], mid)
            left = left[lo[left] < hi[left]]
        found = lo < high
        found[found] = self.codes[self.leaves[lo[found]] + depth[found]] == code[found]
        return np.where(found, self.leaves[np.minimum(lo, self.size - 1)], -1)

    def blocks(self) -> np.ndarray:
        """Borders of the Lempel-Ziv blocks: each is the longest string from there on that also starts earlier, or one code."""
        minima = _minima(self.leaves)
        place, own = np.arange(self.size), self.leaves
        before, after = _reach_down(minima, place, own) - 1, _reach_up(minima, place, own)
        longest = np.zeros(self.size, np.int64)
        for other in (before, after):  # the nearest leaves of earlier suffixes
            some = (other >= 0) & (other < self.size)
            longest[own[some]] = np.maximum(longest[own[some]], self.ahead(own[some], own[other[some]]))
        step, at, out = np.maximum(longest, 1).tolist(), 0, [0]
        while at < self.size:
            at += step[at]
            out.append(at)
        return np.array(out)


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each count c: the numbers 0 to c - 1, and whose they are."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts), owner


def covering_squares(tree: SuffixTree) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of squares, among them one from which the leftmost place of each square is reached by moving right."""
    edges = tree.blocks()
    low, high = edges[:-1], edges[1:]
    size = high - low
    found = []
    # the right half goes on into the next block
    k, b = _spread(np.where(high < tree.size, size, 0))
    k, border = k + 1, high[b]
    q = border - k
    ahead, back = tree.ahead(border, q), tree.back(border - 1, q - 1)
    fine = (ahead + back >= k) & (ahead > 0)
    found.append((np.maximum(q - back, q - k + 1)[fine], k[fine]))
    # the left half begins before the block
    k, b = _spread(np.where(low > 0, np.minimum(size + np.append(size[1:], 0), tree.size - 1 - low), 0))
    k, border = k + 1, low[b]
    q = border + k
    ahead, back = tree.ahead(border, q), tree.back(border - 1, q - 1)
    start = np.maximum(border - back, border - k + 1)
    fine = (ahead + back >= k) & (ahead > 0) & (back > 0) & (start + k <= high[b])
    found.append((start[fine], k[fine]))
    return tuple(np.concatenate(x) for x in zip(*found))


def primitive(tree: SuffixTree, start: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Squares whose half is no power of a shorter string."""
    least = np.arange(int(period.max(initial=1)) + 1)
    for p in range(2, int(len(least) ** 0.5) + 1):
        if least[p] == p:
            part = least[p * p :: p]
            part[part == np.arange(p * p, len(least), p)] = p
    out, rest = np.ones(len(start), bool), period.copy()
    while (some := np.flatnonzero(out & (rest > 1))).size:
        prime = least[rest[some]]
        part = period[some] // prime
        out[some] = ~tree.same(start[some], start[some] + part, 2 * period[some] - part)
        rest[some] //= prime
    return out


def vocabulary(tree: SuffixTree) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(low, high, period): the places of all different squares with primitive roots."""
    start, period = covering_squares(tree)
    fine = primitive(tree, start, period)
    start, period = start[fine], period[fine]
    marked = np.zeros(0, np.int64)
    width = np.int64(tree.size + 1)
    found = []
    while len(start):
        # walks that reach the same end begin at the first of them
        end = start + period + tree.ahead(start, start + period)
        order = np.lexsort((start, end, period))
        first = np.append(True, (np.diff(period[order]) != 0) | (np.diff(end[order]) != 0))
        start, period, end = (x[order][first] for x in (start, period, end))
        # rotations that follow in the text; after as many as the period has words they are the same again
        turns = np.minimum(end - start - 2 * period + 1, period)
        step, walk = _spread(turns)
        at, own = start[walk] + step, period[walk]
        low, high = tree.place(at, 2 * own)
        mark, one = np.unique(low * width + own, return_index=True)
        new = ~np.isin(mark, marked)
        marked = np.concatenate([marked, mark[new]])
        one = one[new]
        found.append((low[one], high[one], own[one]))
        # where the text goes on otherwise: the suffix link of the last place, and its branch
        last = start + turns - 1
        open_ = turns < period
        last, period = last[open_], period[open_]
        low, high = tree.place(last + 1, 2 * period - 1)
        start = tree.branch(low, high, 2 * period - 1, tree.codes[last])
        some = start >= 0
        start, period = start[some], period[some]
        new = ~np.isin(tree.place(start, 2 * period)[0] * width + period, marked)
        start, period = start[new], period[new]
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3


def all_runs(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs of two periods or more in a sequence whose last code occurs once."""
    tree = SuffixTree(codes)
    low, high, period = vocabulary(tree)
    step, square = _spread(high - low)
    start, period = tree.leaves[low[square] + step], period[square]
    order = np.lexsort((start, period))
    start, period = start[order], period[order]
    first = np.ones(len(start), bool)
    first[1:] = (np.diff(period) != 0) | (np.diff(start) != 1)
    heads = np.flatnonzero(first)
    last = np.append(heads[1:], len(start)) - 1 if len(heads) else heads
    return start[heads], start[last] - start[heads] + 2 * period[heads], period[heads]


def _covered(codes: np.ndarray, bounds: np.ndarray, window: int) -> np.ndarray:
    """Words of windows that are found twice or more within the bounds of one stretch."""
    at, edges = windows(bounds, window)
    if not len(at):
        return np.zeros(len(codes), bool)
    own = np.repeat(np.arange(len(bounds) - 1, dtype=np.uint64), np.diff(edges))
    value = mix(rolled(mix(codes.astype(np.uint64) + np.uint64(1)), window)[at] + mix(own + np.uint64(7)))
    order = np.argsort(value, kind="stable")
    twin = value[order[1:]] == value[order[:-1]]
    twice = np.zeros(len(at), bool)
    twice[order[1:][twin]] = True
    twice[order[:-1][twin]] = True
    depth = np.zeros(len(codes) + 1, np.int64)
    np.add.at(depth, at[twice], 1)
    np.add.at(depth, at[twice] + window, -1)
    return np.cumsum(depth[:-1]) > 0


def stretches(codes: np.ndarray, bounds: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(low, high) of parts of the texts that hold all runs of ``least`` words or more, each run in one part.

    A run of period q and length L repeats L - q words at the distance q, and L - q is at least half of ``least``
    as L is at least 2·q: so every word of it is in a window of that size that its part holds twice."""
    window = (least + 1) // 2
    low, high = bounds[:-1], bounds[1:]
    while True:
        some = high - low >= least
        low, high = low[some], high[some]
        step, part = _spread(high - low)
        place = low[part] + step
        edges = np.append(0, np.cumsum(high - low))
        covered = _covered(codes[place], edges, window)
        if covered.all():
            return low, high
        begins = covered.copy()
        begins[1:] &= ~covered[:-1] | (part[1:] != part[:-1])
        ends = covered.copy()
        ends[:-1] &= ~covered[1:] | (part[1:] != part[:-1])
        low, high = place[begins], place[ends] + 1


def text_runs(codes: np.ndarray, bounds: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, ...]:
    """(text, start, length, period) of the runs of at least ``least`` words, by text, start and period."""
    low, high = stretches(codes, bounds, least)
    sizes = high - low + 1
    tree = np.cumsum(sizes) // TREE_WORDS
    found = []
    for a, b in zip(np.flatnonzero(np.diff(tree, prepend=-1)), [*np.flatnonzero(np.diff(tree)) + 1, len(low)]):
        step, part = _spread(sizes[a:b])
        ends = step == sizes[a:b][part] - 1
        place = np.where(ends, 0, low[a:b][part] + step)
        start, length, period = all_runs(np.where(ends, int(codes.max()) + 1 + part, codes[place] if len(place) else place))
        some = length >= least
        found.append((place[start[some]], length[some], period[some]))
    start, length, period = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
    text = np.searchsorted(bounds, start, side="right") - 1
    order = np.lexsort((period, start))
    return text[order], (start - bounds[text])[order], length[order], period[order]


def _collapsed(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in runs(batch):
                words = Words(part.column("text"))
                text, start, length, period = text_runs(words.codes, words.bounds, least)
                depth = np.zeros(len(words) + 1, np.int64)
                first = words.bounds[text] + start
                np.add.at(depth, first + period, 1)
                np.add.at(depth, first + length, -1)
                stays = np.cumsum(depth[:-1]) == 0
                counts = np.bincount(text, minlength=part.num_rows)
                kept = []
                for i, (a, b, n) in enumerate(zip(words.bounds, words.bounds[1:], counts)):
                    own = words.text(i).split()
                    kept.append(b" ".join(compress(own, stays[a:b].tolist()) if n else own))
                ends = pa.array(np.append(0, np.cumsum(counts)).astype(np.int32))
                rows = pa.StructArray.from_arrays([pa.array(x.astype(np.int64)) for x in (start, length, period)], ["start", "length", "period"])
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), pa.array(np.diff(words.bounds).astype(np.int64)), pa.ListArray.from_arrays(ends, rows), pa.array(kept, pa.binary()).cast(pa.string())],
                    ["key", "n_words", "runs", "collapsed"],
                )

    return run


def _repeating(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in runs(batch):
            texts = []
            for h, text in zip(part.column("h").to_pylist(), part.column("text").cast(pa.binary()).to_pylist()):
                if h is not None and h % 10 == 0 and text is not None and (words := text.split()):
                    g, n = h // 10, len(words)
                    a = g % n
                    p = 1 + (n - a) // (3 + g % 8)
                    text = b" ".join(words[:a] + (words[a : a + p] * -(-(n - a) // p))[: n - a])
                texts.append(text)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "text"])


def with_repeats(docs: DataFrame) -> DataFrame:
    """doc_id and text, where the texts of one id in ten repeat: with h = crc32 of the decimal id, g = h / 10 and
    h divisible by 10, the words from a = g mod n on repeat the p = 1 + (n - a) / (3 + g mod 8) words there.
    Null ids and texts stay as they are."""
    rows = prepare(docs.sparkSession) and docs.select("doc_id", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_repeating, f"doc_id {dict(docs.dtypes)['doc_id']}, text string")


def digest(found: DataFrame) -> DataFrame:
    """Of ``periodic_runs`` by doc_id: number, longest run (ties: smallest start, then period) and hashes."""
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    out = found.select("doc_id", "n_words", "runs", best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), (-F.col("best.less")).alias("length"), F.col("best.period").alias("period"),
        F.expr("-best.less * 1000 div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256", "n_words",
    )


def periodic_runs(docs: DataFrame, least: int = LEAST, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document: ``key``, n_words, runs, collapsed.

    Words are ``[^\\x20\\x09-\\x0D]+``, numbered from 0. ``runs`` are structs (start, length, period) by
    start, then period: stretches with smallest period ``period`` and a length of at least ``least`` and twice the
    period, which no neighbouring word extends. ``collapsed`` is the text without the words that some run contains
    after its first period, joined by single spaces.

    Null and empty texts have no words, no runs and an empty ``collapsed``. Null keys and rows that repeat a key or a
    text are documents of their own; other columns are not read. Texts are whole: a task holds one
    slice of some megabytes, or one longer text, and some 300 bytes for each word of its longest repeating part.
    """
    kind = dict(docs.dtypes)[key]
    rows = prepare(docs.sparkSession) and docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    out = rows.mapInArrow(_collapsed(least), f"key {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
    return out.withColumnRenamed("key", key)
