"""Segmentation against all splits, and naive Bayes against counts by hand."""

from __future__ import annotations

import random
from collections import Counter
from itertools import combinations
from math import log

import pytest

from brineframe.llm import url_filter
from brineframe.llm.url_filter import RULES, Rules, joined, marked, placed_runs, split


def every_split(run):
    for k in range(len(run)):
        for cuts in combinations(range(1, len(run)), k):
            yield [run[a:b] for a, b in zip((0, *cuts), (*cuts, len(run)))]


def cost(words, counts, total):
    return sum(log(total / counts[w]) if w in counts else log(total) + 2.3 * len(w) for w in words)


@pytest.mark.parametrize("seed", range(4))
def test_split_is_the_cheapest_of_all(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("ab") for _ in range(rng.randint(1, 6)))
    for _ in range(120):
        counts = {word(): rng.choice([1, 1, 2, 5, 40]) for _ in range(rng.randint(0, 8))}
        total = sum(counts.values()) + rng.randint(1, 50)
        run = "".join(rng.choice("ab") for _ in range(rng.randint(1, 11)))
        known, short = {w: n for w, n in counts.items() if len(w) > url_filter.SHORT}, {w: n for w, n in counts.items() if len(w) <= url_filter.SHORT}
        got = split(run, known, short, total)
        assert "".join(got) == run
        # an unknown word of several letters may also be written as one that the counts hold
        paid = sum(min(cost([w], counts, total), log(total) + 2.3 * len(w)) for w in got)
        assert paid == pytest.approx(min(cost(w, counts, total) for w in every_split(run)))


def test_ties_of_splits():
    # "abab" as ab + ab costs 2 log 4, as abab log 16: the longer last word wins
    assert split("abab", {"abab": 1}, {"ab": 4}, 16) == ["abab"]
    assert split("abab", {"abab": 1}, {"ab": 5}, 16) == ["ab", "ab"]
    # as cheap as unknown is known
    assert split("", {}, {}, 5) == []


@pytest.mark.parametrize("seed", range(3))
def test_joined_is_some_split_of_fitting_words(seed):
    rng = random.Random(seed)
    seen = set()
    for _ in range(200):
        known = {"".join(rng.choice("ab") for _ in range(rng.randint(4, 6))): rng.choice([1, 3, 9]) for _ in range(rng.randint(0, 9))}
        run, n, total = "".join(rng.choice("ab") for _ in range(rng.randint(4, 12))), rng.choice([1, 3, 5]), 60
        if known and rng.random() < 0.5:
            run = "".join(rng.choices(list(known), k=2))
        fits = lambda w: w != run and len(w) >= url_filter.LEAST and known.get(w, 0) >= n
        cheapest = min((sum(log(total / known[w]) for w in words) for words in every_split(run) if len(words) > 1 and all(map(fits, words))), default=None)
        want = cheapest is not None and cheapest < log(total) + 2.3 * len(run)
        assert joined(run, n, known, {}, total) == want
        seen.add(want)
    assert seen == {True, False}


def test_scores_are_those_of_naive_bayes(spark):
    """Classes, counts, odds and verdicts of every page by hand; rules give the labels where one fits."""
    rng = random.Random(2)
    names = ["garden", "casino", "riverbank", "pills", "market"]
    urls = [f"http://{rng.choice(['m', 'www', 'x'])}.{rng.choice(names)}.example.{rng.choice(['com', 'net', 'org', 'edu'])}/{rng.choice(['en', 'de', 'es', 'fr'])}/{rng.randint(0, 99)}" for _ in range(400)]
    # a host whose pages a rule blocks: what it has elsewhere is blocked too, without a seed word
    urls += [f"http://banners.example.org/es/{k}" for k in range(60)] + ["http://banners.example.edu/es/7"]
    pages = spark.createDataFrame([*enumerate(urls), (-1, None)], "page_id long, url string")
    parts = pages.select(url_filter.host_of(pages.url).alias("host"), url_filter.path_of(pages.url).alias("path"))
    words = {r["run"]: r["words"] for r in url_filter.split_runs(url_filter.run_counts(parts)).collect()}
    rules, counts, classes = Rules(RULES), {True: Counter(), False: Counter()}, Counter()
    tokens_of = lambda h, p: [place + w for run, place in placed_runs(h, p) for w in words.get(run, [run])]
    hosts = {r["page_id"]: r for r in pages.select("page_id", url_filter.host_of(pages.url).alias("host"), url_filter.path_of(pages.url).alias("path")).collect()}
    for r in hosts.values():
        verdict = rules.match(r["host"], r["path"])[1]
        bad = verdict == "block" if verdict else marked(r["host"])
        classes[bad] += 1
        counts[bad].update(tokens_of(r["host"], r["path"]))
    size = len(counts[True] | counts[False] | Counter(url_filter.SEEDS))
    more = lambda t: 2 * (t in url_filter.SEEDS)
    odds = lambda t: log((counts[True][t] + more(t) + 1) / (sum(counts[True].values()) + size)) - log((counts[False][t] + 1) / (sum(counts[False].values()) + size))
    prior = log((classes[True] + 1) / (classes[False] + 1))
    got = url_filter.judge_urls(pages).collect()
    assert len(got) == 462
    margins = []
    for r in got:
        verdict = rules.match(r["host"], r["path"])[1]
        score = prior + sum(map(odds, tokens_of(r["host"], r["path"])))
        margins.append(abs(score))
        assert r["verdict"] == (verdict or ("block" if score > 0 else "allow"))
    assert min(margins) > 1e-6
    free = {r["page_id"]: r for r in got if r["rule"] is None}
    assert free[460]["verdict"] == "block" and not marked(free[460]["host"]) and any(r["verdict"] == "allow" for r in free.values())
