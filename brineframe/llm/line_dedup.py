"""Line dedup: sharded cuckoo filters in front of exact reference-count tables.

State (a ``Ledger``), each table in folders by shard of the line key or by bucket of the document id:

* ``refs`` (by bucket): the line keys of each document; ``gone`` (by bucket): the deleted ones;
* ``counts`` (by shard): the documents that hold a key and the smallest id of them; the row of the last batch counts;
* ``holders`` (by shard): the documents of each key that two or more hold;
* ``filters`` (by shard): the cuckoo filter of the shard's live keys; the last batch that changed it counts.

A batch is combined to one row per key before it meets its shard, so a line of a
third of all documents is one row. The filter says which keys are certainly new;
only the others are looked up in the exact counts. Fingerprints can be taken out
again, so deleting documents gives their lines back to the next holder. A batch opens
the files of the shards and buckets that it touches and no others.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import prepare, stored, work_path
from ..sources.ledger import Batch, Ledger
from .words import SMALL_RUN, SPACES, runs

#: Fixed value: keys shorter than this many code points stay.
MIN_CODE_POINTS = 10
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
SLOTS = 4
#: Lines for which a shard is made, and the fewest shards.
SHARD_LINES, LEAST_SHARDS = 250_000, 8
#: Stands for a null id: after all others.
LAST = (1 << 63) - 1


class CuckooFilter:
    """16-bit fingerprints in buckets of four. When a segment is full a segment of twice its size joins it."""

    def __init__(self, expected: int = 1024, segments: list[np.ndarray] | None = None):
        self.segments = segments or [self._segment(expected)]

    @staticmethod
    def _segment(expected: int) -> np.ndarray:
        return np.zeros((1 << max(4, int(np.ceil(np.log2(max(expected, 1) / SLOTS / 0.8)))), SLOTS), np.uint16)

    @staticmethod
    def _places(hashes: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mask = np.uint64(len(table) - 1)
        prints = ((hashes >> np.uint64(48)) % np.uint64(65535) + np.uint64(1)).astype(np.uint16)
        one = hashes & mask
        other = one ^ (prints.astype(np.uint64) * np.uint64(0x5BD1E995) & mask)
        return prints, one.astype(np.int64), other.astype(np.int64)

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        found = np.zeros(len(hashes), bool)
        for table in self.segments:
            prints, one, other = self._places(hashes, table)
            found |= (table[one] == prints[:, None]).any(1) | (table[other] == prints[:, None]).any(1)
        return found

    def insert(self, hashes: np.ndarray) -> None:
        """Adds each hash once more; the caller sees to it that a live key is added once."""
        while len(hashes):
            table = self.segments[-1]
            room = max(int(table.size * 0.85) - np.count_nonzero(table), 0)
            hashes = np.append(self._insert(table, hashes[:room]), hashes[room:])
            if len(hashes):
                self.segments.append(self._segment(max(2 * table.size, int(len(hashes) / 0.8))))

    def _insert(self, table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        left = hashes
        for turn in range(64):
            if not len(left):
                return left
            prints, one, other = self._places(left, table)
            bucket = one if turn % 2 == 0 else other
            first = np.unique(bucket, return_index=True)[1]
            free = table[bucket[first]] == 0
            first, free = first[free.any(1)], free[free.any(1)]
            table[bucket[first], free.argmax(1)] = prints[first]
            stay = np.ones(len(left), bool)
            stay[first] = False
            left = left[stay]
        return self._kick(table, left)

    def _kick(self, table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        mask = len(table) - 1
        prints, one, _ = self._places(hashes, table)
        failed = []
        for k, (p, b) in enumerate(zip(prints.tolist(), one.tolist())):
            trail = []
            for hop in range(200):
                b ^= (p * 0x5BD1E995 & mask) * (hop > 0)
                free = np.flatnonzero(table[b] == 0)
                if len(free):
                    table[b, free[0]] = p
                    break
                slot = (p + hop) % SLOTS
                trail.append((b, slot))
                p, table[b, slot] = int(table[b, slot]), p
            else:  # put everything back: the key goes to the next segment
                for b, slot in reversed(trail):
                    p, table[b, slot] = int(table[b, slot]), p
                failed.append(k)
        return hashes[failed]

    def remove(self, hashes: np.ndarray) -> None:
        """Takes one fingerprint of each hash out; in a bucket one at a time, for all buckets at once."""
        for table in reversed(self.segments):
            for side in (1, 2):
                while len(hashes):
                    places = self._places(hashes, table)
                    bucket = places[side]
                    hit = table[bucket] == places[0][:, None]
                    some = np.flatnonzero(hit.any(1))
                    if not len(some):
                        break
                    first = some[np.unique(bucket[some], return_index=True)[1]]
                    table[bucket[first], hit[first].argmax(1)] = 0
                    hashes = np.delete(hashes, first)


def line_key(line: bytes) -> bytes | None:
    """128-bit hash of a line's key; None if the line always stays."""
    key = line.strip(SPACES).translate(LOWER)
    if len(key) < MIN_CODE_POINTS or len(key) < 4 * MIN_CODE_POINTS and len(key.decode()) < MIN_CODE_POINTS:
        return None
    return xxhash.xxh3_128_digest(key)


def _refs(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in runs(batch, size=SMALL_RUN):
                ids, keys = [], []
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").cast(pa.binary()).to_pylist()):
                    own = {line_key(x) for x in (text or b"").split(b"\n")}
                    own.discard(None)
                    keys += own
                    ids += [LAST if doc is None else doc] * len(own)
                shard = np.frombuffer(b"".join(keys), ">u4").reshape(-1, 4)[:, 0] % shards if keys else np.zeros(0)
                yield pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int32)), pa.array(keys, pa.binary()), pa.array(ids, pa.int64())], ["shard", "key", "doc"])

    return run


def _hashes(keys: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(keys), ">u8").reshape(-1, 2)[:, 1].astype(np.uint64) if len(keys) else np.zeros(0, np.uint64)


def _load(rows: pd.DataFrame, expected: int) -> CuckooFilter:
    rows = rows.sort_values("segment")
    return CuckooFilter(expected, [np.frombuffer(x, np.uint16).reshape(-1, SLOTS).copy() for x in rows["slots"]])


def _dump(shard: int, own: CuckooFilter, changed: bool = True) -> pd.DataFrame:
    return pd.DataFrame({"shard": np.int32(shard), "key": None, "segment": range(len(own.segments)), "slots": [x.tobytes() for x in own.segments], "changed": changed})


_PROBED = "shard int, key binary, segment int, slots binary, changed boolean"
_FILTER = ["shard", "segment", "slots"]


def _add(keys: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
    """Of one shard: keys that the filter may have held, and the filter with the new keys in it."""
    if not len(keys):
        return pd.DataFrame({c: [] for c in (*_FILTER, "key", "changed")})
    shard = int(keys["shard"].iloc[0])
    keys = keys.sort_values("key")  # the same filter whatever the order of arrival
    own, hashes = _load(rows, len(keys)), _hashes(keys["key"])
    maybe = own.contains(hashes)
    own.insert(hashes[~maybe])
    # a new key that the filter takes for an old one needs its fingerprint too: see LineIndex.insert
    hits = pd.DataFrame({"shard": np.int32(shard), "key": keys["key"][maybe], "segment": -1, "slots": None, "changed": True})
    return pd.concat([hits, _dump(shard, own, not maybe.all())])


def _changed(sign: int):
    """Of one shard: the filter with some keys more or fewer; nothing if it is as it was."""

    def run(rows: pd.DataFrame, keys: pd.DataFrame) -> pd.DataFrame:
        if not len(keys):
            return rows[rows["changed"]][_FILTER] if len(rows) else rows[_FILTER]
        shard = int(keys["shard"].iloc[0])
        own = _load(rows, len(keys))
        (own.insert if sign > 0 else own.remove)(_hashes(keys.sort_values("key")["key"]))
        return _dump(shard, own)[_FILTER]

    return run


def _numbers(df: DataFrame, column: str) -> list[int]:
    """The shards or buckets of some rows: no more than there are."""
    return [r[0] for r in df.select(column).distinct().collect()]


class LineIndex:
    """An incremental line dedup at ``path`` (a new folder or an earlier index, whose number of shards holds).

    ``shards``: a shard's filter and its share of a batch's keys are in memory at once; take
    one for each SHARD_LINES lines, as ``line_dedup`` does. ``looked_up`` is the number of keys
    that the filters sent the last batch to the exact counts for.
    """

    REFS, GONE = "doc long, key binary, shard int, bucket int", "doc long, bucket int"
    COUNTS, HOLDERS, FILTERS = "key binary, docs long, owner long, old_docs long, old_owner long, shard int", "key binary, doc long, shard int", "segment int, slots binary, shard int"

    def __init__(self, spark: SparkSession, path: str, shards: int = 64):
        self.spark, self.log = prepare(spark), Ledger(spark, path)
        self.shards, self.looked_up = self.log.fixed("shards", shards), 0

    def _bucket(self, doc: str = "doc"):
        """The bucket of a document; the lines of all null ids are spread."""
        return F.pmod(F.xxhash64(doc), F.lit(self.shards)).cast("int")

    def _live(self, state: Batch | Ledger, rows: DataFrame, buckets: Iterable[int]) -> DataFrame:
        """Rows (doc, seq) of documents in some buckets that no later deletion took out."""
        gone = state.read("gone", self.GONE, by="bucket", some=buckets).groupBy("doc").agg(F.max("seq").alias("until"))
        return rows.join(gone, "doc", "left").where("until is null or seq > until").drop("until")

    def _filters(self, state: Batch, shards: Iterable[int]) -> DataFrame:
        """The newest filters of some shards."""
        rows = state.read("filters", self.FILTERS, by="shard", some=shards)
        newest = rows.groupBy("shard").agg(F.max("seq").alias("seq"))
        return rows.join(newest, ["shard", "seq"]).select(*_FILTER, F.lit(False).alias("changed"))

    def _counts(self, state: Batch | Ledger, shards: Iterable[int] | None = None) -> DataFrame:
        """key, docs, owner of the keys that live documents hold."""
        rows = state.read("counts", self.COUNTS, by="shard", some=shards)
        last = rows.groupBy("key").agg(F.max_by(F.struct("docs", "owner"), "seq").alias("now"))
        return last.select("key", "now.docs", "now.owner").where("docs > 0")

    def _written(self, batch: Batch, table: str, df: DataFrame, by: str) -> DataFrame:
        """Writes a table of the open batch and gives it back; folders that hold much are written by several tasks."""
        batch.write(table, df.hint("rebalance", by), by)
        return batch.own(table, {"gone": self.GONE, "counts": self.COUNTS, "holders": self.HOLDERS}[table]).drop("seq")

    def insert(self, docs: DataFrame, batch: str) -> None:
        """Adds documents (doc_id, text). A batch name that was committed before is left alone. An id that is
        there already has the lines of both texts from now on; to revise a document, delete it first. Batches of
        several writers follow one another: see ``ledger``."""
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        bucket = F.when(F.col("doc") == LAST, self._bucket("key")).otherwise(self._bucket())
        refs = rows.mapInArrow(_refs(self.shards), "shard int, key binary, doc long").withColumn("bucket", bucket)
        self.log.apply(batch, lambda own: self._insert(own, refs))

    def _insert(self, batch: Batch, refs: DataFrame) -> None:
        batch.write("refs", refs.repartition(self.shards, "bucket").dropDuplicates(["bucket", "doc", "key"]), "bucket")
        refs = batch.own("refs", self.REFS).drop("seq")
        if batch.state:
            own = refs.select("doc", "bucket").distinct()
            buckets = _numbers(own, "bucket")
            earlier = self._live(batch, batch.read("refs", self.REFS, by="bucket", some=buckets).select("doc", "bucket", "seq"), buckets)
            known = stored(earlier.join(own.select("doc"), "doc", "left_semi").select("doc", "bucket").distinct(), "known-documents")
            if known.head(1):
                held = self._live(batch, *self._refs_of(batch, known)).select("doc", "key")
                refs = stored(refs.join(held, ["doc", "key"], "left_anti"), "new-lines")

        keys = stored(refs.groupBy("shard", "key").agg(F.count(F.lit(1)).alias("docs"), F.min("doc").alias("owner")), "line-keys")
        probed = stored(keys.select("shard", "key").groupBy("shard").cogroup(self._filters(batch, _numbers(keys, "shard")).groupBy("shard")).applyInPandas(_add, _PROBED), "probed")
        maybe = probed.where("key is not null").select("shard", "key")
        self.looked_up = maybe.count()
        old = self.spark.createDataFrame([], "key binary, old_docs long, old_owner long")
        if self.looked_up:
            found = self._counts(batch, _numbers(maybe, "shard")).join(maybe.select("key"), "key", "left_semi")
            old = stored(found.select("key", F.col("docs").alias("old_docs"), F.col("owner").alias("old_owner")), "held-keys")
        now = keys.join(old, "key", "left").select("key", (F.col("docs") + F.coalesce("old_docs", F.lit(0))).alias("docs"), F.least("owner", "old_owner").alias("owner"), "old_docs", "old_owner", "shard")
        now = self._written(batch, "counts", now, "shard")
        holders = refs.join(now.where("docs > 1").select("key"), "key", "left_semi").select("key", "doc", "shard")
        # the holder of a key that had one so far
        first = now.where("old_docs = 1").select("key", F.col("old_owner").alias("doc"), "shard")
        self._written(batch, "holders", holders.unionByName(first), "shard")
        filters = probed.where("key is null").select(*_FILTER, "changed")
        if self.looked_up:  # keys that the filter only seemed to hold are put in now
            false = stored(maybe.join(old, "key", "left_anti"), "seeming-keys")
            filters = filters.groupBy("shard").cogroup(false.groupBy("shard")).applyInPandas(_changed(1), "shard int, segment int, slots binary")
        batch.write("filters", filters.select(*_FILTER), "shard")

    def _refs_of(self, state: Batch | Ledger, docs: DataFrame) -> tuple[DataFrame, list[int]]:
        """The committed lines of documents (doc, bucket), and the buckets that hold them."""
        buckets = list(range(self.shards)) if docs.where(F.col("doc") == LAST).head(1) else _numbers(docs, "bucket")
        return state.read("refs", self.REFS, by="bucket", some=buckets).join(docs.select("doc"), "doc", "left_semi"), buckets

    def delete(self, docs: DataFrame, batch: str) -> None:
        """Takes documents (doc_id) out; their lines pass to the next smallest holder. Ids that are not there change nothing."""
        gone = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc")).distinct().withColumn("bucket", self._bucket())
        self.log.apply(batch, lambda own: self._delete(own, gone))

    def _delete(self, batch: Batch, gone: DataFrame) -> None:
        gone = self._written(batch, "gone", gone, "bucket")
        refs = self._live(batch, *self._refs_of(batch, gone)).select("doc", "key", "shard").distinct()
        lost = stored(refs.groupBy("shard", "key").agg(F.count(F.lit(1)).alias("fewer"), F.min("doc").alias("least")), "lost-keys")
        shards = _numbers(lost, "shard")
        now = self._counts(batch, shards).join(lost, "key")
        now = stored(now.select("key", (F.col("docs") - F.col("fewer")).alias("docs"), "owner", F.col("docs").alias("old_docs"), F.col("owner").alias("old_owner"), "shard", (F.col("owner") == F.col("least")).alias("passes")), "recounted")
        held = batch.read("holders", self.HOLDERS, by="shard", some=shards).join(now.where("passes and docs > 0").select("key"), "key", "left_semi")
        held = stored(held.join(gone.select("doc"), "doc", "left_anti").select("key", "doc", "seq", self._bucket().alias("bucket")), "heirs")
        heirs = self._live(batch, held, _numbers(held, "bucket")).groupBy("key").agg(F.min("doc").alias("heir"))
        now = now.join(heirs, "key", "left").withColumn("owner", F.when(F.col("passes"), F.col("heir")).otherwise(F.col("owner"))).drop("passes", "heir")
        now = self._written(batch, "counts", now.select("key", "docs", "owner", "old_docs", "old_owner", "shard"), "shard")
        empty = now.where("docs = 0").select("shard", "key")
        filters = self._filters(batch, _numbers(empty, "shard")).groupBy("shard").cogroup(empty.groupBy("shard"))
        batch.write("filters", filters.applyInPandas(_changed(-1), "shard int, segment int, slots binary"), "shard")

    def shared(self) -> DataFrame:
        """key, owner: lines of at least two live documents."""
        return self._counts(self.log).where("docs > 1").select("key", "owner")

    def clean(self, docs: DataFrame, whole: bool = True) -> DataFrame:
        """doc_id, n_lines, n_dropped, kept_text of documents (doc_id, text) that were inserted; other columns stay too.

        ``whole``: the documents are most of the index, so all counts are read. Else the lines of these ids say which
        shards are: no other folder is opened."""
        rows = docs.withColumn("__doc", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)))
        shards = None
        if not whole:
            own = rows.select(F.col("__doc").alias("doc")).distinct().withColumn("bucket", self._bucket())
            shards = _numbers(self._refs_of(self.log, own)[0], "shard")
        # written, so that adaptive execution can split the join where one line has very many holders
        owners = stored(self._counts(self.log, shards).where("docs > 1").select("key", "owner"), "owners")
        held = self.log.read("holders", self.HOLDERS, by="shard", some=shards).select("key", "doc")
        if not whole:
            held = held.join(own.select("doc"), "doc", "left_semi")
        drops = held.join(owners, "key").where("doc > owner").groupBy("doc").agg(F.collect_set("key").alias("__drop"))
        rows = rows.join(drops.withColumnRenamed("doc", "__doc"), "__doc", "left").drop("__doc")
        kinds = {f.name: f.dataType for f in docs.schema.fields}
        schema = ", ".join([f"`{c}` {k.simpleString()}" for c, k in kinds.items()] + ["n_lines long", "n_dropped long", "kept_text string"])
        return rows.mapInArrow(_clean, schema)


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in runs(batch, size=SMALL_RUN):
            n, dropped, kept = [], [], []
            for text, drop in zip(part.column("text").cast(pa.binary()).to_pylist(), part.column("__drop").to_pylist()):
                lines = (text or b"").split(b"\n")
                n.append(len(lines))
                if drop:
                    gone = set(drop)
                    lines = [x for x in lines if line_key(x) not in gone]
                dropped.append(n[-1] - len(lines))
                kept.append(b"\n".join(lines))
            names = [c for c in part.schema.names if c != "__drop"]
            yield pa.RecordBatch.from_arrays(
                [part.column(c) for c in names] + [pa.array(n, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], [*names, "n_lines", "n_dropped", "kept_text"]
            )


def shards_for(docs: DataFrame) -> int:
    """Shards for the lines of some documents."""
    text = F.col("text").cast("string")
    lines = docs.agg(F.sum(F.coalesce(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))), F.lit(0)) + 1)).first()[0] or 0
    return max(LEAST_SHARDS, ceil(lines / SHARD_LINES))


def line_dedup(docs: DataFrame, path: str | None = None, shards: int | None = None, batches: int = 2, again: int = 0) -> DataFrame:
    """Documents without the lines that a document with a smaller id holds too.

    A line's key is the line stripped of ``[\\x20\\x09-\\x0D]`` at both ends, A-Z lower-cased;
    keys of under 10 code points always stay. Null or empty texts are one empty line.
    Rows that repeat an id are one document: they keep the lines that this document owns.
    Null ids are together one document that comes after all others. Returns the columns of
    ``docs`` with n_lines (before), n_dropped and kept_text; of ``docs``, only columns named
    like these three clash and are replaced.

    The documents go into a new index in ``batches`` by a hash of their id, so from the second on
    the filters choose the keys that are looked up. With ``again``, one id in so many is then
    deleted and inserted anew, which ends in the same state. ``shards``: by default from the number of lines.
    """
    spark = docs.sparkSession
    docs = docs.drop("n_lines", "n_dropped", "kept_text", "__drop", "__doc")
    index = LineIndex(spark, path or work_path(spark, "line-index"), shards or shards_for(docs))
    draw = F.xxhash64(F.col("doc_id").cast("long"))
    for k in range(batches):
        index.insert(docs.where(F.pmod(draw, F.lit(batches)) == k), f"part {k}")
    if again:
        some = docs.where(F.pmod(F.shiftrightunsigned(draw, 20), F.lit(again)) == 0)
        index.delete(some, "taken out")
        index.insert(some, "put back")
    return index.clean(docs)


def digest(cleaned: DataFrame) -> DataFrame:
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))
