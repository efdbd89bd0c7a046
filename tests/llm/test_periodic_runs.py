"""Periodic runs against brute force: every period, every start."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from brineframe.llm.periodic_runs import SuffixTree, all_runs, digest, periodic_runs, text_runs, with_repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words, least):
    n, out = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            part = words[i : i + length]
            if length >= max(least, 2 * q) and not any(part[p:] == part[:-p] for p in range(1, q)):
                out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def sequence(rng, kind, n):
    if kind < 3:
        return [rng.randrange(kind + 1) for _ in range(n)]
    if kind == 3:  # periods with faults
        part, out = [rng.randrange(4) for _ in range(rng.randint(1, 9))], []
        while len(out) < n:
            out += part if rng.random() < 0.8 else [rng.randrange(4)]
        return out[:n]
    a, b = [0], [0, 1]  # Fibonacci's string, full of squares
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


@pytest.mark.parametrize("least", [2, 3, 5, 12])
def test_runs_against_brute_force(least):
    rng = random.Random(least)
    for _ in range(250):
        texts = [sequence(rng, rng.randrange(5), rng.randint(0, 60)) for _ in range(rng.randint(1, 5))]
        codes, bounds = np.array(sum(texts, []), np.int64), np.cumsum([0] + [len(t) for t in texts])
        got = list(zip(*(x.tolist() for x in text_runs(codes, bounds, least))))
        assert got == [(k, *r) for k, t in enumerate(texts) for r in brute(t, least)]


def test_long_powers_and_no_repeats():
    for n, part in ((40_000, 1), (40_000, 1234), (30_001, 15_000)):
        words = np.resize(np.random.default_rng(part).permutation(part), n)
        assert [x.tolist() for x in text_runs(words, np.array([0, n]))] == [[0], [0], [n], [part]]
    assert not len(text_runs(np.arange(5000), np.array([0, 5000]))[0])
    assert not len(text_runs(np.zeros(0, np.int64), np.array([0, 0]))[0])
    assert [x.tolist() for x in all_runs(np.array([5]))] == [[], [], []]


def test_the_tree():
    rng = np.random.default_rng(3)
    codes = np.append(rng.integers(0, 2, 200), 9)
    tree, text = SuffixTree(codes), codes.tolist()
    assert tree.leaves.tolist() == sorted(range(201), key=lambda i: text[i:])
    share = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    i, j = rng.integers(0, 201, 300), rng.integers(0, 201, 300)
    i, j = i[i != j], j[i != j]
    assert tree.ahead(i, j).tolist() == [share(text[a:], text[b:]) for a, b in zip(i, j)]
    assert tree.back(i, j).tolist() == [share(text[: a + 1][::-1], text[: b + 1][::-1]) for a, b in zip(i, j)]
    at, depth = np.arange(150), rng.integers(1, 40, 150)
    low, high = tree.place(at, depth)
    for a, d, x, y in zip(at, depth, low, high):
        assert sorted(tree.leaves[x:y]) == [k for k in range(201) if text[k : k + d] == text[a : a + d]]
    edges = tree.blocks().tolist()
    for a, b in zip(edges, edges[1:]):
        longest = max((share(text[a:], text[k:]) for k in range(a)), default=0)
        assert b - a == max(longest, 1)


def expected(doc, text):
    words = WORD.findall(text or "")
    h = zlib.crc32(str(doc).encode()) if doc is not None else 1
    if h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    found = brute(words, 12)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    row = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return doc, len(found), *row, sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)), len(words)


def test_query_rows_on_odd_documents(spark):
    rng = random.Random(5)
    rows = [(None, "a " * 30), (1, None), (2, ""), (3, " \t\n "), (4, "x"), (4, "x y " * 9), (4, "x y " * 9), (5, "é ß é ß\n" * 12), (6, "ab " * 900 + "c"), (7, "the end " * 6 + "of " * 13)]
    for k in range(120):  # ten of them repeat by their id
        rows.append((100 + k, " ".join(f"w{c}" for c in sequence(rng, rng.randrange(5), rng.choice([1, 2, 11, 12, 13, 40, 200])))))
    rows.append((999, " ".join(str(i % 700) for i in range(3000))))
    docs = spark.createDataFrame([(d, t, "n", [1]) for d, t in rows], "doc_id long, text string, runs string, key array<int>").repartition(3)
    got = digest(periodic_runs(with_repeats(docs)))
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "n_words"]
    key = lambda r: tuple((v is None, v) for v in r)
    assert sorted(map(tuple, got.select(names).collect()), key=key) == sorted((expected(d, t) for d, t in rows), key=key)
    assert sum(zlib.crc32(str(d).encode()) % 10 == 0 for d, _ in rows if d is not None) >= 5
    assert periodic_runs(docs.limit(0)).count() == 0


def test_batches_of_many_trees(spark, monkeypatch):
    """Stretches of one batch fall into several trees with the same result."""
    import brineframe.llm.periodic_runs as module

    rng = random.Random(9)
    texts = [sequence(rng, rng.randrange(5), 80) for _ in range(60)]
    codes, bounds = np.array(sum(texts, []), np.int64), np.cumsum([0] + [len(t) for t in texts])
    whole = [x.tolist() for x in text_runs(codes, bounds)]
    monkeypatch.setattr(module, "TREE_WORDS", 300)
    assert [x.tolist() for x in text_runs(codes, bounds)] == whole
