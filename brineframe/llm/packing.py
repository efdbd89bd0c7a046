"""Packing: best-fit decreasing into windows of a fixed number of tokens.

Documents longer than a window are first cut into full windows. What is left of each
document is dealt evenly into shards; each shard is packed on its own, longest piece
first, always into the fullest open window that still has room, which a segment tree
over remaining capacities finds. A shard ends with a few windows that are not full,
so the loss doesn't grow with the corpus.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import prepare, stored
from .tokens import encoder
from .words import runs

WINDOW = 1024
#: Pieces that one shard packs (some 50 bytes each are in memory).
SHARD_PIECES = 50_000


def _pieces(path: str, window: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in runs(batch):
                ids, bounds = encoder(path)(part.column("text"))
                n = np.diff(bounds) + 1
                # each document's ids, then end_id
                flat = np.full(len(ids) + len(n), end_id, "<u4")
                flat[np.arange(len(ids)) + np.repeat(np.arange(len(n)), n - 1)] = ids
                begin = np.cumsum(n) - n
                cuts = -(-n // window)
                doc = np.repeat(np.arange(len(n)), cuts)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(cuts) - cuts, cuts)) * window
                length = np.minimum(window, n[doc] - start)
                places = (begin[doc] + start) * 4
                view = memoryview(flat).cast("B")
                crc = [zlib.crc32(view[a:b]) for a, b in zip(places.tolist(), (places + length * 4).tolist())]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(n[doc])],
                    ["doc_id", "start", "length", "ids_crc32", "doc_tokens"],
                )

    return run


def best_fit(lengths: list[int], window: int) -> tuple[list[int], list[int]]:
    """Window number and offset of each piece; the pieces are in falling order of length."""
    width = 1 << window.bit_length()
    tree = bytearray(2 * width)  # leaf r: is there an open window with r tokens of room
    room: list[list[int]] = [[] for _ in range(window + 1)]
    number, offset, opened = [], [], 0
    for n in lengths:
        # the smallest non-empty leaf >= n
        node = width + n
        if not tree[node]:
            while node > 1 and (node & 1 or not tree[node + 1]):
                node >>= 1
            if node > 1:
                node += 1
                while node < width:
                    node <<= 1
                    if not tree[node]:
                        node += 1
        if node > 1:
            r = node - width
            k = room[r].pop()
            if not room[r]:
                while node and tree[node] and (node >= width or not (tree[2 * node] or tree[2 * node + 1])):
                    tree[node] = 0
                    node >>= 1
        else:
            r, k = window, opened
            opened += 1
        number.append(k)
        offset.append(window - r)
        left = r - n
        if left:
            if not room[left]:
                node = width + left
                while node and not tree[node]:
                    tree[node] = 1
                    node >>= 1
            room[left].append(k)
    return number, offset


def _pack(window: int):
    def run(pieces: pd.DataFrame) -> pd.DataFrame:
        pieces = pieces.sort_values(["length", "piece"], ascending=[False, True], ignore_index=True)
        number, offset = best_fit(pieces["length"].tolist(), window)
        shard = int(pieces["shard"].iloc[0])
        pieces["sequence_id"] = 2 * ((shard << 31) + np.array(number, np.int64)) + 1
        pieces["offset"] = np.array(offset, np.int64)
        return pieces[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]]

    return run


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = 0, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids are those of ``tokenizer`` (a tokenizers file; the string of an added token is
    that token, as its file says) and then ``end_id``. Null and empty texts are ``end_id`` alone. Rows
    that repeat an id are documents of their own; null ids are kept. Full windows have even
    sequence numbers, the others odd ones; offsets in a sequence have no gaps. Other columns
    are not read.
    """
    spark = prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = rows.mapInArrow(_pieces(tokenizer, window, end_id), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")
    pieces = stored(pieces.withColumn("piece", F.monotonically_increasing_id()), "pieces")
    full = pieces.where(F.col("length") == window)
    rest = pieces.where(F.col("length") < window)
    shards = max(1, round(rest.count() / shard_pieces))
    columns = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    packed = rest.withColumn("shard", F.pmod(F.xxhash64("piece"), F.lit(shards))).groupBy("shard").applyInPandas(_pack(window), columns)
    whole = full.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (2 * F.col("piece")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return whole.unionByName(packed)
