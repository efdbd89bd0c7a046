"""N-gram Jaccard join: documents whose sets of word shingles overlap by a threshold or more.

1. Documents with the same words are one class, of which one representative goes on.
2. Its MinHash values, in an order of its own for each trie, are its label there. The
   labels of all tries are sorted (by ranges, so that no task holds a trie); neighbours in
   the sorted order give the longest prefix that each label shares with any other. A node
   at depth d is a run of labels that share their first d values.
3. Prefixes are shortened, all tries at once, from the longest down, until the measured share
   of links that meet in a node reaches the target recall (``meeting_depth``). Links to
   measure by are neighbours of the sorted tries, judged in the tries that did not pair them.
4. In a node, representatives are compared by all their MinHash values against leaders:
   members close to a leader share its links, the others lead themselves. So a node of
   thousands of near copies costs little more than its size, and its pairs are never
   written. Large nodes are split into salted parts, whose leaders meet in blocks.
5. Connected leaders and members are candidate groups. The shingle sets of a group come
   together in blocks, where all pairs are verified exactly; each block gives counts and
   a spanning tree, not pairs.
6. Components of verified links are the classes that come out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import prepare, stored
from .components import components
from .groups import candidate_groups, grouped, linked, overlaps, roots, shingle_sets
from .words import SMALL_RUN, Words, mix, raw, rolled, runs, windows

WORDS, THRESHOLD = 5, 0.8
#: MinHash values, tries, values of a label, and the share of links that shall meet in some node.
VALUES, TREES, LONGEST, RECALL = 128, 32, 12, 0.9999
#: Links at the threshold, of computed recall, that count besides those that are measured.
ASSUMED = 100
#: Bytes of a label: the trie, then two for each value.
LABEL = 1 + 2 * LONGEST
#: Estimates from which a member shares its leader's links, and from which two are of one candidate group.
#: For a true pair at 0.8 the triangle inequality leaves its leaders at 0.6 or more.
CLOSE, RELATED = 0.9, 0.5
#: Documents of a group that one task compares at once.
BLOCK = 512

_RANDOM = np.random.default_rng(20240229)
_XOR = _RANDOM.integers(0, 1 << 32, VALUES, dtype=np.uint32)
_ODD = _RANDOM.integers(0, 1 << 31, VALUES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ORDER = np.stack([_RANDOM.permutation(VALUES)[:LONGEST] for _ in range(TREES)])


def expected(threshold: float, d: int, trees: int = TREES) -> float:
    """The chance that a pair at the threshold shares its first d values in some trie, if tries are independent."""
    return 1 - (1 - threshold**d) ** trees


def shingles(words: Words, n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of each text's n-word shingles, and the bounds of the texts among them. A text
    of 1 to n - 1 words is one shingle, one without words has none."""
    hashes = words.hashes()
    at, edges = windows(words.bounds, n)
    count = np.diff(words.bounds)
    own = np.diff(edges)
    short = np.flatnonzero((count > 0) & (count < n))
    sizes = own.copy()
    sizes[short] = 1
    bounds = np.append(0, np.cumsum(sizes))
    out = np.zeros(bounds[-1], np.uint64)
    if len(at):
        long = np.repeat(own > 0, sizes)
        out[long] = rolled(hashes, n)[at]
    for i in short:
        part = hashes[words.bounds[i] : words.bounds[i + 1]]
        out[bounds[i]] = mix(rolled(part, len(part)) + np.uint64(len(part)))[0]
    return out, bounds


def signatures(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """MinHash values (uint32) of the sets that are not empty."""
    starts = bounds[:-1][np.diff(bounds) > 0]
    low = (values >> np.uint64(16)).astype(np.uint32)
    out = np.zeros((len(starts), VALUES), np.uint32)
    edges = [*range(0, len(starts), 256), len(starts)]
    for a, b in zip(edges, edges[1:]):
        if a == b:
            continue
        lo, hi = starts[a], starts[b] if b < len(starts) else len(low)
        part, at = low[lo:hi], starts[a:b] - lo
        for k in range(VALUES):
            out[a:b, k] = np.minimum.reduceat((part ^ _XOR[k]) * _ODD[k], at)
    return out


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in runs(batch, size=SMALL_RUN):
            words = Words(part.column("text"))
            values, bounds = shingles(words)
            full = np.flatnonzero(np.diff(bounds) > 0)
            both = [xxhash.xxh3_128_intdigest(b" ".join(words.text(i).split())) for i in range(part.num_rows)]
            half = lambda x: (x & (1 << 64) - 1) - (1 << 63)
            small = (signatures(values, bounds) * np.uint32(0x9E3779B1) >> np.uint32(16)).astype(np.uint16)
            sigs: list = [None] * part.num_rows
            for k, i in enumerate(full):
                sigs[i] = small[k].tobytes()
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in ("doc_id", "k1", "k2")), pa.array([half(x >> 64) for x in both], pa.int64()), pa.array([half(x) for x in both], pa.int64()), pa.array(np.diff(bounds)), pa.array(sigs, pa.binary())],
                ["doc_id", "k1", "k2", "c1", "c2", "n", "sig"],
            )


def _sigs(column: pa.Array) -> np.ndarray:
    return raw(column)[0].view(np.uint16).reshape(len(column), VALUES)


def _labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each representative and trie: its label."""
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            out = np.empty((part.num_rows, TREES, LABEL), np.uint8)
            out[:, :, 0] = np.arange(TREES)
            out[:, :, 1:] = np.ascontiguousarray(_sigs(part.column("sig"))[:, _ORDER], ">u2").view(np.uint8).reshape(part.num_rows, TREES, -1)
            ends = pa.array(np.arange(part.num_rows * TREES + 1, dtype=np.int32) * LABEL)
            labels = pa.BinaryArray.from_buffers(pa.binary(), part.num_rows * TREES, [None, ends.buffers()[1], pa.py_buffer(out.tobytes())])
            yield pa.RecordBatch.from_arrays([labels, pa.array(np.repeat(part.column("rep").to_numpy(), TREES))], ["label", "rep"])


def shared_values(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """How many of their first values each two labels (rows of bytes) share; 0 in different tries."""
    differ = one != other
    first = np.where(differ.any(1), differ.argmax(1), LABEL)
    return np.maximum((first - 1) // 2, 0)


def _neighbours(floor: int):
    """Of sorted labels: those that share ``floor`` values or more with the one before (``up``) or after
    (``down``). The first and last of a partition always come too (edge 1, 2 or 3), as they lack a neighbour."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()

        def rows(labels: np.ndarray, reps: np.ndarray, up: np.ndarray, down: np.ndarray, prev: np.ndarray, edge: np.ndarray) -> pa.RecordBatch:
            some = np.flatnonzero((np.maximum(up, down) >= floor) | (edge > 0))
            whole = pa.array([x.tobytes() for x in labels[some]], pa.binary())
            numbers = [pa.array(x[some], k) for x, k in ((reps, pa.int64()), (up, pa.int32()), (down, pa.int32()), (prev, pa.int64()), (edge, pa.int32()))]
            return pa.RecordBatch.from_arrays([whole, *numbers, pa.array(np.full(len(some), part), pa.int32())], ["label", "rep", "up", "down", "prev", "edge", "part"])

        held = None  # the last label so far: what follows it is not known yet
        for batch in batches:
            if not batch.num_rows:
                continue
            labels, reps = raw(batch.column("label"))[0].reshape(batch.num_rows, LABEL), batch.column("rep").to_numpy()
            up, prev, edge = np.zeros(1, np.int64), reps[:1], np.ones(1, np.int64)
            if held:
                labels, reps = np.vstack([held[0], labels]), np.append(held[1], reps)
                up, prev, edge = held[2:]
            between = shared_values(labels[:-1], labels[1:])
            up, prev, edge = np.append(up, between), np.append(prev, reps[:-1]), np.append(edge, np.zeros(len(between), np.int64))
            if len(between):
                yield rows(labels[:-1], reps[:-1], up[:-1], between, prev[:-1], edge[:-1])
            held = labels[-1:].copy(), reps[-1:], up[-1:], prev[-1:], edge[-1:]
        if held:
            labels, reps, up, prev, edge = held
            yield rows(labels, reps, up, np.zeros(1, np.int64), prev, edge | 2)

    return run


def sorted_tries(reps: DataFrame, floor: int) -> DataFrame:
    """label, rep, up, down, prev of the labels that share ``floor`` values or more with a neighbour.

    Labels are dealt by ranges of (label, rep), so those that very many share spread over tasks. Where two
    partitions meet, the two labels come to the driver: two for each partition."""
    spark = reps.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    labels = reps.select("rep", "sig").mapInArrow(_labels, "label binary, rep long")
    rows = labels.repartitionByRange(parts, "label", "rep").sortWithinPartitions("label", "rep")
    rows = stored(rows.mapInArrow(_neighbours(floor), "label binary, rep long, up int, down int, prev long, edge int, part int"), "tries")
    edges = [r.asDict() for r in rows.where("edge > 0").collect()]
    edges.sort(key=lambda r: (r["part"], r["edge"] != 1 and r["edge"] != 3))
    for one, other in zip(edges, edges[1:]):
        if one["part"] != other["part"]:
            both = (np.frombuffer(bytes(x["label"]), np.uint8)[None] for x in (one, other))
            one["down"] = other["up"] = int(shared_values(*both)[0])
            other["prev"] = one["rep"]
    names = ["label", "rep", "up", "down", "prev"]
    ends = spark.createDataFrame([tuple(r[c] for c in names) for r in edges], "label binary, rep long, up int, down int, prev long")
    return rows.where("edge = 0").select(names).unionByName(ends.where(F.greatest("up", "down") >= floor))


def _meetings(threshold: float):
    """Of pairs that look like links: the longest prefix they share in a trie other than ``tree``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                same = _sigs(part.column("one")) == _sigs(part.column("other"))
                link = same.mean(1) >= threshold
                depth = np.logical_and.accumulate(same[link][:, _ORDER], 2).sum(2)
                depth[np.arange(len(depth)), part.column("tree").to_numpy()[link]] = 0
                yield pa.RecordBatch.from_arrays([pa.array(depth.max(1, initial=0), pa.int32())], ["depth"])

    return run


def meeting_depth(reps: DataFrame, threshold: float, recall: float = RECALL) -> tuple[DataFrame, int, float]:
    """The tries, the longest prefix at which the measured share of links that meet reaches ``recall``, and that share.

    Measured are all pairs that stand side by side in some sorted trie and whose MinHash
    values agree as those of a link; each by the tries other than the first that paired it. ASSUMED links at the threshold count besides
    them with their computed chance, so that a corpus with few links is read at a safe depth. If no
    prefix down to one value reaches the target, that is an error, never a silent loss."""
    floor = next((d for d in range(LONGEST, 0, -1) if expected(threshold, d) >= recall), 1)
    while True:
        floor = max(1, floor - 1)
        tries = sorted_tries(reps, floor)
        pairs = tries.where(F.col("up") >= floor).select(F.least("prev", "rep").alias("a"), F.greatest("prev", "rep").alias("b"), F.conv(F.hex(F.substring("label", 1, 1)), 16, 10).cast("int").alias("tree"))
        pairs = pairs.groupBy("a", "b").agg(F.min("tree").alias("tree"))
        sig = lambda c, name: reps.select(F.col("rep").alias(c), F.col("sig").alias(name))
        pairs = pairs.join(sig("a", "one"), "a").join(sig("b", "other"), "b").select("one", "other", "tree")
        found = {r["depth"]: r["count"] for r in pairs.mapInArrow(_meetings(threshold), "depth int").groupBy("depth").count().collect()}
        for d in range(LONGEST, floor - 1, -1):
            met = sum(n for m, n in found.items() if m >= d) + ASSUMED * expected(threshold, d)
            share = met / (sum(found.values()) + ASSUMED)
            if share >= recall:
                return tries, d, share
        if floor == 1:
            raise ValueError(f"{TREES} tries can't bring {recall} of the links at {threshold} together, only {share:.5f}")


def shingle_arrays(texts: pa.Array) -> list[np.ndarray]:
    values, bounds = shingles(Words(texts))
    return [np.unique(values[a:b]).view(np.int64) for a, b in zip(bounds, bounds[1:])]


def _verified(threshold: float):
    def work(rows: pd.DataFrame) -> pd.DataFrame | None:
        rows = rows.drop_duplicates("rep", ignore_index=True)
        rep, copies, side = rows["rep"].to_numpy(), rows["copies"].to_numpy(), rows["side"].to_numpy()
        sets = list(rows["shingles"])
        sizes = np.fromiter(map(len, sets), np.float64, len(sets))
        both = overlaps(sets)
        links = both >= threshold * (sizes[:, None] + sizes - both) - 1e-9
        np.fill_diagonal(links, False)
        if rows["first"].iloc[0] != rows["second"].iloc[0]:  # two blocks: pairs inside one belong to its own task
            links &= side[:, None] != side
        if not links.any():
            return None
        root = roots(links)
        some = links.any(1)
        return pd.DataFrame({"rep": rep[some], "links": (links @ copies)[some], "texts": links.sum(1)[some], "root": rep[root[some]]})

    return work


def classified(docs: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK, counted: bool = True) -> DataFrame:
    """One row per document: doc_id, k1, k2 (a hash of id and text), top (the number of its class) and, where
    ``counted``, n_links and n_texts, which need all pairs of a group. See ``near_duplicates``."""
    spark = prepare(docs.sparkSession)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keyed = rows.withColumn("k1", F.xxhash64("doc_id", "text")).withColumn("k2", F.xxhash64(F.lit(7), "text", "doc_id"))
    base = keyed.mapInArrow(_signed, "doc_id long, k1 long, k2 long, c1 long, c2 long, n long, sig binary")
    base = stored(base.withColumn("row", F.monotonically_increasing_id()), "signatures")
    classes = stored(base.groupBy("c1", "c2").agg(F.min("row").alias("rep"), F.count(F.lit(1)).alias("copies")), "text-classes")
    reps = stored(base.where("sig is not null").join(classes.select(F.col("rep").alias("row"), "copies"), "row").select(F.col("row").alias("rep"), "copies", "n", "k1", "k2", "sig"), "representatives")

    tries, d, _ = meeting_depth(reps, threshold)
    at = tries.where(F.greatest("up", "down") >= d).select("rep", F.col("rep").alias("root"), F.xxhash64(F.substring("label", 1, 1 + 2 * d)).alias("node"))
    candidate = candidate_groups([lambda _: at], reps, (1 - CLOSE) * VALUES, (1 - RELATED) * VALUES, (1 - RELATED) * VALUES)
    member = candidate.join(reps.select(F.col("rep").alias("node"), "copies", "k1", "k2"), "node").select("k1", "k2", F.col("node").alias("rep"), "copies", "root")
    member = stored(member, "members")
    sets_of = lambda rows: shingle_sets(keyed, rows, shingle_arrays)
    each = base.select("row", "doc_id", "k1", "k2", "c1", "c2", F.col("sig").isNotNull().alias("full")).join(classes, ["c1", "c2"])
    if not counted:
        sized = member.join(reps.select("rep", "n"), "rep").select("rep", F.col("root").alias("grp"), F.col("n").alias("size"), "k1", "k2")
        final = components(linked(sized, sets_of, threshold, block))
        each = each.join(final.select(F.col("node").alias("rep"), F.col("root").alias("top")), "rep", "left")
        return stored(each.select("doc_id", "k1", "k2", F.coalesce("top", "rep").alias("top")), "classes")

    # groups in blocks
    sizes = member.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    member = member.join(sizes, "root").withColumn("blocks", F.ceil(F.col("n") / block).cast("int")).drop("n")
    member = member.withColumn("side", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    sets = sets_of(member)
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    sets = sets.select("*", other).withColumn("first", F.least("side", "other")).withColumn("second", F.greatest("side", "other")).drop("blocks", "other")
    # blocks meet pairwise; a group of one block is there once
    sets = sets.repartition(parts, "root", "first", "second").sortWithinPartitions("root", "first", "second", "rep")
    found = sets.mapInPandas(grouped(["root", "first", "second"], _verified(threshold)), "rep long, links long, texts long, root long")
    found = stored(found, "links")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"), F.sum("texts").alias("texts"))
    final = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))

    each = each.join(links, "rep", "left").join(final.select(F.col("node").alias("rep"), F.col("root").alias("top")), "rep", "left")
    total = F.when(F.col("full"), F.coalesce("links", F.lit(0)) + F.col("copies") - 1).otherwise(0)
    return stored(each.select("doc_id", "k1", "k2", total.cast("long").alias("n_links"), F.coalesce("texts", F.lit(0)).cast("long").alias("n_texts"), F.coalesce("top", "rep").alias("top")), "classes")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, class_id, n_links, n_texts, class_size, class_row, k1, k2.

    Two documents are linked if the Jaccard similarity of their sets of five-word shingles is
    ``threshold`` or more. Words are ``[^\\x20\\x09-\\x0D]+``; a text of one to four words is one
    shingle of all its words. class_id is the smallest id of the component of linked documents,
    n_links the number of documents linked to this one (copies counted), n_texts the number of
    different texts among them besides its own, class_size the component's documents.

    Null and empty texts have no shingles: they are copies of each other, one class, but
    linked to nothing (n_links 0). Null ids stay null; a class whose ids are all null has a
    null class_id, and class_row tells it from others. Rows that repeat an id are documents of their own. (k1, k2) is a hash of
    id and text. Other columns are not read.
    """
    each = classified(docs, threshold, block)
    # written, so that adaptive execution can split the join where one class has most documents
    whole = stored(each.groupBy("top").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size")), "class-sizes")
    return each.join(whole, "top").select("doc_id", "class_id", "n_links", "n_texts", "class_size", F.col("top").alias("class_row"), "k1", "k2")


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Of each class the document with the smallest id (all columns). Of rows that repeat that id, one.
    Column names that begin with ``__`` are ours."""
    keep = classified(docs, threshold, counted=False).groupBy("top").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2")).alias("first"))
    keep = keep.select(F.col("first.k1").alias("__k1"), F.col("first.k2").alias("__k2")).distinct()
    rows = docs.withColumn("__k1", F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))).withColumn("__k2", F.xxhash64(F.lit(7), F.col("text").cast("string"), F.col("doc_id").cast("long")))
    return rows.join(keep, ["__k1", "__k2"], "left_semi").dropDuplicates(["__k1", "__k2"]).drop("__k1", "__k2")
