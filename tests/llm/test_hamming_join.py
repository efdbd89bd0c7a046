"""The Hamming join and the verification of groups against brute force."""

from __future__ import annotations

import random
import re
from itertools import combinations
from math import comb

import numpy as np
import pytest

from brineframe.llm import groups, hamming_join
from brineframe.llm.components import components
from brineframe.llm.hamming_join import chunks, index_keys, minhash_groups, radius, shingle_arrays, signatures

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_radius_is_the_binomial_tail():
    for threshold, values, missed in ((0.8, 64, 1e-7), (0.5, 16, 1e-3), (0.95, 32, 1e-9)):
        d, p = radius(threshold, values, 16, missed), (1 - threshold) * (1 - 2**-16)
        tail = lambda d: sum(comb(values, k) * p**k * (1 - p) ** (values - k) for k in range(d + 1, values + 1))
        assert tail(d) <= missed < tail(d - 1)


@pytest.mark.parametrize("values, errors", [(6, 0), (8, 1), (10, 2)])
def test_keys_leave_no_pair_out(values, errors):
    """Every way to differ within the distance leaves some key alone; all of them are tried."""
    for distance in range(values):
        parts = chunks(distance, values, errors)
        assert sorted(np.concatenate(parts).tolist()) == list(range(values))
        keys = [set(k.tolist()) for k in index_keys(distance, values, errors)]
        for differ in combinations(range(values), distance):
            assert any(not key & set(differ) for key in keys)


def test_signatures_estimate_jaccard():
    rng = np.random.default_rng(0)
    for share in (0.3, 0.8):
        agree = []
        for _ in range(60):
            pool = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
            n = int(400 * share)
            a, b = np.append(pool[:n], pool[n : n + (400 - n) // 2]), np.append(pool[:n], pool[n + (400 - n) // 2 :])
            sig = signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
            agree.append((sig[0] == sig[1]).mean())
        assert abs(np.mean(agree) - share) < 0.03


def sets(text):
    words = WORD.findall((text or "").translate(LOWER))
    return {" ".join(words)} if len(words) == 1 else set(zip(words, words[1:]))


def brute(rows, threshold=0.8):
    of = [sets(t) for _, t in rows]
    root = list(range(len(rows)))
    find = lambda i: i if root[i] == i else find(root[i])
    for i, j in combinations(range(len(rows)), 2):
        if of[i] and of[j] and 100 * len(of[i] & of[j]) >= 100 * threshold * len(of[i] | of[j]):
            root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least.setdefault(find(i), []).append(doc)
    out = []
    for i, (doc, _) in enumerate(rows):
        top = min((d for d in least[find(i)] if d is not None), default=None)
        out.append((doc, len(of[i]), top, doc == top))
    return out


def multiset(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((v is None, v) for v in r))


def corpus(seed, n):
    rng = random.Random(seed)
    say = lambda k: [f"w{rng.randrange(400)}" for _ in range(k)]
    out, bases = [], [say(rng.choice([1, 2, 3, 6, 30, 120])) for _ in range(n // 8)]
    for k in range(n):
        words = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 2, 4, 9])):
            words[rng.randrange(len(words))] = f"w{rng.randrange(400)}"
        out.append((k, " ".join(w.upper() if rng.random() < 0.2 else w for w in words)))
    return out


def test_against_brute_force(spark):
    rows = corpus(1, 240)
    rows += [(None, None), (None, "solo x"), (None, "only nulls hold this text"), (900, None), (901, ""), (902, " \n\t "), (903, "One"), (904, "one"), (905, "ONE one"), (906, "É é"), (907, "é É")]
    rows += [(3, rows[3][1]), (3, "another text under a known id"), (910, "a b " * 4000), (911, "b a " * 4000), (912, "x"), (912, "x"), (912, "x")]
    # at the threshold exactly: 4 of 5, and 7 of 9 below it
    rows += [(920, "t1 t2 t3 t4 t5"), (921, "t1 t2 t3 t4 t5 t6"), (930, " ".join(f"u{k}" for k in range(9))), (931, " ".join(f"u{k}" for k in [*range(8), 99]))]
    docs = spark.createDataFrame([(d, t, "x", [1.0]) for d, t in rows], "doc_id long, text string, component_id string, sig array<double>").repartition(3)
    assert multiset(minhash_groups(docs).collect()) == multiset(brute(rows))
    assert minhash_groups(docs.limit(0)).count() == 0


def family(rng, n, words=60):
    """Near copies at every distance from their origin, and some of the copies' own."""
    origin = [f"v{k}" for k in range(words)]
    out = []
    for k in range(n):
        own = list(rng.choice(out[-30:])) if out and rng.random() < 0.3 else list(origin)
        for _ in range(rng.choice([0, 1, 2, 3, 6, 9, 14])):
            own[rng.randrange(words)] = f"z{rng.randrange(10**6)}"
        out.append(own)
    return [(k, " ".join(w)) for k, w in enumerate(out)]


def test_split_nodes_and_groups(spark, monkeypatch):
    """One large family, its nodes and groups split into many small parts: the same components."""
    rows = family(random.Random(4), 220)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = multiset(brute(rows))
    assert 1 < len({r[2] for r in want}) < 200
    monkeypatch.setattr(groups, "NODE", 30)
    assert multiset(minhash_groups(docs, part=16).collect()) == want


@pytest.mark.parametrize("seed, part", [(0, 4), (1, 9), (2, 40), (3, 1000)])
def test_linked(spark, seed, part, monkeypatch):
    """Links of one group given as sets, parts so small that followers of leaders have to meet."""
    rng = np.random.default_rng(seed)
    own = []
    for _ in range(60):
        base = own[rng.integers(len(own))] if own and rng.random() < 0.9 else np.arange(40) + 1000 * len(own)
        own.append(np.append(base[rng.random(len(base)) > 0.04], rng.integers(0, 1 << 40, rng.integers(0, 4))))
    pieces = [np.unique(x) for x in own]
    root = list(range(len(own)))
    find = lambda i: i if root[i] == i else find(root[i])
    for i, j in combinations(range(len(own)), 2):
        both = len(np.intersect1d(pieces[i], pieces[j]))
        if 100 * both >= 80 * (len(pieces[i]) + len(pieces[j]) - both):
            root[max(find(i), find(j))] = min(find(i), find(j))
    table = spark.createDataFrame([(k, 7, len(x), k, k) for k, x in enumerate(pieces)], "rep long, grp long, size long, k1 long, k2 long")
    whole = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(pieces)], "rep long, shingles array<long>")
    met = []
    needs = groups._needs
    monkeypatch.setattr(groups, "_needs", lambda t: met.append(t) or needs(t))
    edges = groups.linked(table, lambda some: some.join(whole, "rep"), 0.8, part)
    found = {r["node"]: r["root"] for r in components(edges).collect()}
    assert [found.get(k, k) for k in range(len(own))] == [find(k) for k in range(len(own))]
    assert part > 60 or len({find(k) for k in range(len(own))}) > 1
    assert bool(met) == (part < 60)


def test_sets_are_of_lower_cased_ascii_words():
    import pyarrow as pa

    got = shingle_arrays(pa.array(["A b", "a B", "É b", "é b", None, " ", "a"]))
    assert [len(x) for x in got] == [1, 1, 1, 1, 0, 0, 1]
    assert got[0].tolist() == got[1].tolist() and got[2].tolist() != got[3].tolist()
