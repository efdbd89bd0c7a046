"""MinHash near-dedup by a multi-index Hamming join.

1. A document's set of two-word shingles gives a signature of 64 MinHash values of 16 bits each. Documents with
   the same set are one class, of which one representative goes on.
2. Signatures of a linked pair differ in a number of values that is binomial; ``radius`` is the distance that all but
   one in ten million pairs at the threshold keep to.
3. Signatures are cut into chunks, as many that, by the pigeonhole principle, two within the radius differ in at most ERRORS
   values of some chunk. Each way to place these errors leaves the chunk's other values, which are a key. Two
   signatures within the radius share a key, without exception.
4. Members of a key are gathered to candidate groups by the distance of their signatures, large keys in salted parts. Keys
   come in rounds; a key whose members are in one group already is passed over.
5. Links are confirmed on whole sets within the groups, by leaders (``groups.linked``); their components are the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import prepare, stored
from .components import components
from .groups import PART, candidate_groups, linked, shingle_sets
from .ngram_join import shingles
from .words import BASE, Words, mix, raw, runs

WORDS, THRESHOLD = 2, 0.8
#: MinHash values of a signature, bits of each, and the share of pairs at the threshold that may be further apart than the radius.
VALUES, BITS, MISSED = 64, 16, 1e-7
#: Values of a chunk that may differ.
ERRORS = 1
#: A signature that differs from a leader in up to so many values follows it.
CLOSE = 4

_RANDOM = np.random.default_rng(19970611)
_XOR = _RANDOM.integers(0, 1 << 32, VALUES, dtype=np.uint32)
_ODD = _RANDOM.integers(0, 1 << 31, VALUES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def radius(threshold: float = THRESHOLD, values: int = VALUES, bits: int = BITS, missed: float = MISSED) -> int:
    """The least distance that a pair at the threshold exceeds with a chance of ``missed`` at most. Each value
    differs with a chance of (1 - threshold) * (1 - 2 ** -bits), independently of the others."""
    p = (1 - threshold) * (1 - 0.5**bits)
    beyond = 0.0
    for d in range(values, 0, -1):
        beyond += comb(values, d) * p**d * (1 - p) ** (values - d)
        if beyond > missed:
            return d
    return 0


def chunks(distance: int, values: int = VALUES, errors: int = ERRORS) -> list[np.ndarray]:
    """Parts of a signature such that two at ``distance`` or less differ in up to ``errors`` values of some part: were there
    more in every part, the distance would be at least (errors + 1) times the parts."""
    return np.array_split(np.arange(values), min(distance // (errors + 1) + 1, values))


def index_keys(distance: int, values: int = VALUES, errors: int = ERRORS) -> list[np.ndarray]:
    """The values that make each key: of each chunk all but ``errors``, in every way."""
    return [np.delete(own, list(out)) for own in chunks(distance, values, errors) for out in combinations(range(len(own)), min(errors, len(own)))]


def in_rounds(keys: list[np.ndarray]) -> list[list[np.ndarray]]:
    """The keys in three rounds: an eighth of them, a quarter, the rest. The first gather what is very similar."""
    n = max(1, len(keys) // 8)
    return [x for x in (keys[:n], keys[n : 3 * n], keys[3 * n :]) if x]


def signatures(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """MinHash values, cut to BITS, of the sets of numbers that are not empty."""
    starts = bounds[:-1][np.diff(bounds) > 0]
    low = (values >> np.uint64(16)).astype(np.uint32)
    out = np.zeros((len(starts), VALUES), np.uint16)
    for a in range(0, len(starts), 256):
        b = min(a + 256, len(starts))
        part = low[starts[a] : starts[b] if b < len(starts) else len(low)]
        for k in range(VALUES):
            least = np.minimum.reduceat((part ^ _XOR[k]) * _ODD[k], starts[a:b] - starts[a])
            out[a:b, k] = least * np.uint32(0x9E3779B1) >> np.uint32(32 - BITS)
    return out


def shingle_arrays(texts: pa.Array, words: int = WORDS) -> list[np.ndarray]:
    """The set of hashed shingles of each text, in order; empty without words."""
    values, bounds = shingles(Words(pa.compute.ascii_lower(texts)), words)
    return [np.unique(values[a:b]).view(np.int64) for a, b in zip(bounds, bounds[1:])]


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in runs(batch):
            sets = shingle_arrays(part.column("text"))
            bounds = np.append(0, np.cumsum([len(x) for x in sets]))
            both = [xxhash.xxh3_128_intdigest(x.tobytes()) for x in sets]
            half = lambda x: (x & (1 << 64) - 1) - (1 << 63)
            own = iter(signatures(np.concatenate(sets).view(np.uint64), bounds))
            sigs = [next(own).tobytes() if len(x) else None for x in sets]
            columns = [pa.array([half(x >> 64) for x in both], pa.int64()), pa.array([half(x) for x in both], pa.int64()), pa.array(np.diff(bounds).astype(np.int64)), pa.array(sigs, pa.binary())]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "k1", "k2")), *columns], ["doc_id", "k1", "k2", "c1", "c2", "n", "sig"])


def _keyed(keys: list[np.ndarray]):
    """A row for each representative and key: a hash of the key's values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                sig = raw(part.column("sig"))[0].view(np.uint16).reshape(part.num_rows, VALUES).astype(np.uint64)
                node = np.empty((part.num_rows, len(keys)), np.uint64)
                for k, own in enumerate(keys):
                    total = np.zeros(part.num_rows, np.uint64)
                    for v in own:
                        total = mix(total * BASE + (sig[:, v] << np.uint64(8)) + np.uint64(v))
                    node[:, k] = total
                columns = [pa.array(np.repeat(part.column(c).to_numpy(), len(keys))) for c in ("rep", "root")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(node.ravel().view(np.int64))], ["rep", "root", "node"])

    return run


def classified(docs: DataFrame, threshold: float = THRESHOLD, part: int = PART) -> DataFrame:
    """One row per document: doc_id, k1, k2 (a hash of id and text), n (size of its set) and top (the number of its class)."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keyed = rows.withColumn("k1", F.xxhash64("doc_id", "text")).withColumn("k2", F.xxhash64(F.lit(7), "text", "doc_id"))
    base = keyed.mapInArrow(_signed, "doc_id long, k1 long, k2 long, c1 long, c2 long, n long, sig binary")
    base = stored(base.withColumn("row", F.monotonically_increasing_id()), "signatures")
    full = base.where("n > 0")
    classes = stored(full.groupBy("c1", "c2").agg(F.min("row").alias("rep")), "set-classes")
    reps = full.join(classes.select(F.col("rep").alias("row")), "row").select(F.col("row").alias("rep"), "k1", "k2", "n", "sig")
    reps = stored(reps, "representatives")

    distance = radius(threshold)
    keys = index_keys(distance)
    rounds = [lambda some, own=own: some.select("rep", "root", "sig").mapInArrow(_keyed(own), "rep long, root long, node long") for own in in_rounds(keys)]
    candidate = candidate_groups(rounds, reps, CLOSE, distance + CLOSE, distance + 2 * CLOSE)
    members = candidate.select(F.col("node").alias("rep"), F.col("root").alias("grp")).join(reps.select("rep", F.col("n").alias("size"), "k1", "k2"), "rep")
    members = stored(members, "members")
    sets_of = lambda some: shingle_sets(keyed, some, shingle_arrays)
    final = components(linked(members, sets_of, threshold, part))
    each = base.select("row", "doc_id", "k1", "k2", "c1", "c2", "n").join(classes, ["c1", "c2"], "left").join(final.select(F.col("node").alias("rep"), F.col("root").alias("top")), "rep", "left")
    # documents without shingles are classes of their own
    top = F.when(F.col("n") == 0, F.col("row")).otherwise(F.coalesce("top", "rep"))
    return stored(each.select("doc_id", "k1", "k2", "n", top.alias("top")), "classes")


def minhash_groups(docs: DataFrame, threshold: float = THRESHOLD, part: int = PART) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Words are ``[^\\x20\\x09-\\x0D]+`` after A-Z are lower-cased; a document's set is its distinct two-word shingles, or
    its only word. Documents are linked if their sets' Jaccard similarity is ``threshold`` or more; component_id is
    the smallest id that links lead to, its own included, and the document with that id is kept.

    Null texts and texts without words have an empty set and are linked with nothing, each other included. Null ids stay
    null and are never smallest while another id is there; a component of null ids alone has a null component_id and its rows are
    kept. Rows that repeat an id are documents of their own with that id, so more than one may be kept. Other columns are not read.
    """
    each = classified(docs, threshold, part)
    # written, so that adaptive execution can split the join where one component has most documents
    least = stored(each.groupBy("top").agg(F.min("doc_id").alias("component_id")), "component-ids")
    out = each.join(least, "top")
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
