"""Words of many texts as flat arrays, without a Python object per word.

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]``; UTF-8 never uses
those bytes inside a character, so splitting bytes equals splitting text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute is not there without it)
import xxhash

SPACES = b" \t\n\x0b\x0c\r"
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True
IS_END, IS_LETTER = np.zeros(256, bool), np.zeros(256, bool)
IS_END[list(b".,;:!?")] = True
IS_LETTER[65:91] = IS_LETTER[97:123] = True
#: Texts are handled in runs of about so many bytes; one longer text makes a run of its own.
RUN_BYTES = 4 << 20
#: Of the pipeline's stages, whose workers keep what their largest run took until the last stage ends.
SMALL_RUN = 1 << 20


def runs(batch: pa.RecordBatch, column: str = "text", size: int = RUN_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch, each with about ``size`` bytes of ``column``. What Arrow holds without need is given back at the end."""
    if not batch.num_rows:
        return
    sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    cut = np.flatnonzero(np.diff(np.cumsum(sizes.astype(np.int64)) // size)) + 1
    edges = [0, *cut.tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield batch.slice(a, b - a)
    pa.default_memory_pool().release_unused()


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row, and the n + 1 offsets of the texts in them; a null is empty."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    texts = pa.concat_arrays([texts])
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(texts) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


class Words:
    """``bounds[i]:bounds[i + 1]`` are the words of text i; ``codes`` are indices into ``vocab``;
    ``starts`` and ``ends`` are byte places in ``data``."""

    def __init__(self, texts: pa.Array, cut_ends: bool = False):
        """``cut_ends``: one of ``.,;:!?`` that ends a word after an ASCII letter is a word of its own."""
        data, offs = raw(texts)
        space = IS_SPACE[data]
        first = ~space
        last = first.copy()
        first[1:] &= space[:-1]
        last[:-1] &= space[1:]
        inner = offs[1:-1]
        inner = inner[(inner > 0) & (inner < len(data))]
        first[inner] = ~space[inner]
        last[inner - 1] = ~space[inner - 1]
        if cut_ends and len(data):
            ends = np.flatnonzero(IS_END[data] & last & ~first)
            ends = ends[IS_LETTER[data[ends - 1]]]
            first[ends] = True
            last[ends - 1] = True
        self.data, self.offs = data, offs
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.starts, offs)
        ends = np.zeros(len(self.starts) + 1, np.int64)
        np.cumsum(self.ends - self.starts, out=ends[1:])
        flat = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(self.starts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data[~space]))])
        coded = flat.dictionary_encode()
        self.codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.vocab = coded.dictionary

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word, the same in every run."""
        own = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in self.vocab.to_pylist()), np.uint64, len(self.vocab))
        return own[self.codes] if len(own) else np.zeros(0, np.uint64)

    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))

    def text(self, i: int) -> bytes:
        return self.data[self.offs[i] : self.offs[i + 1]].tobytes()

    def __len__(self) -> int:
        return len(self.starts)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: An odd multiplier for rolling hashes.
BASE = np.uint64(0x9E3779B97F4A7C15)


def rolled(hashes: np.ndarray, n: int) -> np.ndarray:
    """A mixed 64-bit hash of each n consecutive words; windows that cross texts are the caller's to drop."""
    size = len(hashes) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:size].copy()
    for j in range(1, n):
        out *= BASE
        out += hashes[j : j + size]
    return mix(out)


def windows(bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the n-word windows that lie in one text, and for n + 1 bounds of texts the bounds among those places."""
    counts = np.maximum(np.diff(bounds) - n + 1, 0)
    edges = np.zeros(len(bounds), np.int64)
    np.cumsum(counts, out=edges[1:])
    at = np.arange(edges[-1]) - np.repeat(edges[:-1], counts) + np.repeat(bounds[:-1], counts)
    return at, edges


def ranks(codes: np.ndarray, n: int) -> np.ndarray:
    """For each window of n codes a number that is equal for equal windows only: prefix doubling, each
    step a sort of pairs. Codes are not negative."""
    size = len(codes) - n + 1
    if size <= 0:
        return np.zeros(0, np.int64)
    rank, span = np.unique(codes, return_inverse=True)[1].astype(np.int64), 1
    while span < n:
        step = min(span, n - span)
        pair = rank[: len(rank) - step] * np.int64(rank.max() + 1) + rank[step:]
        rank, span = np.unique(pair, return_inverse=True)[1].astype(np.int64), span + step
    return rank
