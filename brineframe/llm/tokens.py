"""Byte-level BPE ids of many texts, with a cache of words.

New words are encoded by tiktoken with the ranks that the tokenizers file itself holds
(the ids are the same, which the tests check, at a quarter of the time); texts with
unusual white space or the string of an added token go through the tokenizers library whole.

The pre-tokenizer cuts before a single space or newline that stands between two other
characters, so the ids of a text are those of its words, each with the space
before it, and of the newlines. A text with other white space is encoded as a whole.
"""

from __future__ import annotations

import json
import os
import re
from pathlib import Path

import numpy as np
import pyarrow as pa

from .words import Words

#: Words held in the cache of a worker; when it is full it starts anew.
CACHE_WORDS = 500_000
#: White space beyond ASCII, which the pre-tokenizer knows too.
_WIDE = re.compile("[\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]")
#: Fixed value: the published pattern of the byte-level pre-tokenizer.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _by_ranks(path: str):
    """A tiktoken encoding with the vocabulary of a byte-level tokenizers file; None if its ids aren't
    in the order of its merges, so that ids can't serve as ranks."""
    import tiktoken

    model = json.loads(Path(path).read_text())["model"]
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(sorted({*range(256)} - {*plain}))}
    merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    ids = [model["vocab"][m] for m in merged]
    if ids != sorted(ids):
        return None
    ranks = {bytes(byte[c] for c in t): i for t, i in model["vocab"].items() if all(c in byte for c in t) and (len(t) == 1 or i >= ids[0])}
    ranks = {t: i for t, i in ranks.items() if len(t) == 1 or i <= ids[-1]}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words = _by_ranks(path)
        added = [x["content"].encode() for x in json.loads(Path(path).read_text()).get("added_tokens", [])]
        self.added = re.compile(b"|".join(map(re.escape, added))) if added else None
        self.newline = self._encode(["\n"])[0][0]
        self._clear()

    def _clear(self) -> None:
        self.slots: dict[bytes, int] = {}
        self.pool, self.pool_size = np.zeros(1 << 20, np.uint32), 0
        self.first, self.length = np.zeros(1 << 18, np.int64), np.zeros(1 << 18, np.int64)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _add(self, words: list[bytes]) -> None:
        """Puts new words into the cache; none of them holds a newline."""
        new = [w for w in words if w not in self.slots]
        if not new:
            return
        if self.words is None:
            ids = self._encode([w.decode() for w in new])
            lengths = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter((x for xs in ids for x in xs), np.uint32, int(lengths.sum()))
        else:  # newlines between words are tokens of their own
            flat = self.words.encode_to_numpy(b"\n".join(new).decode(), disallowed_special=())
            stops = np.append(np.flatnonzero(flat == self.newline), len(flat))
            lengths = np.diff(stops, prepend=-1) - 1
            flat = flat[flat != self.newline]
        a, n = len(self.slots), len(self.slots) + len(new)
        while len(self.first) < n:
            self.first, self.length = np.append(self.first, np.zeros_like(self.first)), np.append(self.length, np.zeros_like(self.length))
        while len(self.pool) < self.pool_size + len(flat):
            self.pool = np.append(self.pool, np.zeros_like(self.pool))
        self.pool[self.pool_size : self.pool_size + len(flat)] = flat
        self.length[a:n] = lengths
        self.first[a:n] = self.pool_size + np.cumsum(lengths) - lengths
        self.pool_size += len(flat)
        self.slots.update(zip(new, range(a, n)))

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row (uint32), and their n + 1 bounds; a null is empty."""
        words = Words(texts, cut_ends=True)
        n = len(words.bounds) - 1
        before = words.starts - np.append(0, words.ends[:-1])[: len(words)]
        opening = words.bounds[:-1][np.diff(words.bounds) > 0]
        owner = words.owner()
        before[opening] = words.starts[opening] - words.offs[owner[opening]]
        sign = np.where(before > 0, words.data[words.starts - 1], 0) if len(words) else np.zeros(0, np.uint8)
        plain = ((before == 1) & ((sign == 32) | (sign == 10))) | (before == 0)
        odd = np.zeros(n, bool)
        odd[owner[~plain]] = True
        tail = words.offs[1:].copy()
        some = np.diff(words.bounds) > 0
        tail[some] -= words.ends[words.bounds[1:][some] - 1]
        tail[~some] = np.diff(words.offs)[~some]
        odd |= tail > 0
        for m in self.added.finditer(words.data) if self.added else ():  # across two texts: both go whole
            odd[np.searchsorted(words.offs, [m.start(), m.end() - 1], "right") - 1] = True
        space, newline = (before == 1) & (sign == 32), (before == 1) & (sign == 10)
        key = words.codes * 2 + space
        present = np.zeros(2 * len(words.vocab), bool)
        present[key] = True
        used = np.flatnonzero(present)
        vocab = words.vocab.to_pylist()
        spelled = [b" " + vocab[k >> 1] if k & 1 else vocab[k >> 1] for k in used.tolist()]
        wide = []
        if not (words.data < 128).all() and _WIDE.search(whole := b"\n".join(spelled).decode()):
            wide = [whole.count("\n", 0, m.start()) for m in _WIDE.finditer(whole)]
        where = np.zeros(len(present), np.int64)
        where[used] = np.arange(len(used))
        place = where[key]
        if wide:
            odd[owner[np.isin(place, wide)]] = True
        if len(self.slots) > CACHE_WORDS:
            self._clear()
        self._add(spelled)
        slots = np.fromiter((self.slots[w] for w in spelled), np.int64, len(spelled))
        lengths = self.length[slots][place] + newline
        ends = np.cumsum(lengths)
        ids = self.pool[np.maximum(np.repeat(self.first[slots][place] - newline - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0), 0)]
        ids[(ends - lengths)[newline]] = self.newline
        bounds = np.append(0, ends)[words.bounds]
        if not odd.any():
            return ids, bounds
        raws = {i: np.array(x, np.uint32) for i, x in zip(np.flatnonzero(odd).tolist(), self._encode([words.text(i).decode() for i in np.flatnonzero(odd)]))}
        parts = [raws.get(i, ids[bounds[i] : bounds[i + 1]]) for i in range(n)]
        return np.concatenate(parts), np.append(0, np.cumsum([len(x) for x in parts]))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each file and worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
