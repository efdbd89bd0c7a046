"""Operators of the llm subpackage against brute force, on small documents with every odd case."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from brineframe.llm.words import Words, ranks

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed=0, n=60):
    """Documents with copies, near copies, shared passages, nulls, repeats and ties."""
    rng = random.Random(seed)
    vocab = [rng.choice(["ka", "lo", "mi", "é", "ß", "zu"]) * rng.randint(1, 3) + str(k % 37) for k in range(300)]
    say = lambda k: " ".join(rng.choice(vocab) for _ in range(k))
    passage, line = say(60), "A line that Many documents hold."
    rows = []
    for i in range(n):
        text = say(rng.randint(1, 120))
        if i % 5 == 0:
            text += " " + passage + " " + say(5)
        if i % 3 == 0:
            text = line + "\n" + text + "\n" + "  " + line.upper() + "\t"
        rows.append([i * 3 - 20, text, "en", f"s{i % 3}", len(text)])
    for i in range(0, n, 4):  # copies but for white space, and near copies
        rows.append([1000 + i, rows[i][1].replace(" ", "  "), None, "s1", 1])
        words = rows[i][1].split(" ")
        if len(words) > 40:
            words[len(words) // 2] = "changed"
            rows.append([2000 + i, " ".join(words), "fr", None, 1])
    rows += [[5000, None, "en", "s0", None], [5001, "", "en", None, 0], [5002, " \t\n", None, "s0", 3], [None, rows[0][1], "en", "s0", 1], [None, None, None, None, None]]
    rows += [[6000, rows[3][1], "en", "s2", 1]] * 2 + [[6001, "ab " * 4000 + "end", "en", "s2", 1], [6002, "x", "en", "s0", 1], [6003, "one\n\n two  three", "en", "s0", 1]]
    rng.shuffle(rows)
    return [tuple(r) for r in rows]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def multiset(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_words_equal_regular_expression(rows):
    texts = [r[1] for r in rows] + ["\x1c a\x85b\xa0 c", "a", ""]
    words = Words(pa.array(texts, pa.string()))
    got = words.vocab.take(pa.array(words.codes)).to_pylist()
    assert [w.decode() for w in got] == [w for t in texts for w in WORD.findall(t or "")]
    assert np.diff(words.bounds).tolist() == [len(WORD.findall(t or "")) for t in texts]


def test_ranks_are_equal_for_equal_windows_only():
    codes = np.random.default_rng(0).integers(0, 2, 300)
    for n in (1, 2, 5, 7):
        rank, seen = ranks(codes, n), {}
        for i in range(len(codes) - n + 1):
            assert seen.setdefault(tuple(codes[i : i + n]), rank[i]) == rank[i]
        assert len(set(seen.values())) == len(seen)


def test_exact_dedup(docs, rows):
    from brineframe.llm.exact_dedup import exact_groups

    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "") for r in rows]
    groups = defaultdict(list)
    for r, t in zip(rows, norm):
        groups[t].append(r[0])
    want = Counter()
    for r, t in zip(rows, norm):
        ids = [x for x in groups[t] if x is not None]
        keep = min(ids) if ids else None
        want[(r[0], keep, len(groups[t]), r[0] == keep, sha(t))] += 1
    assert multiset(exact_groups(docs), "doc_id", "keep_id", "group_size", "kept", "text_sha256") == want


def test_exact_dedup_tells_colliding_hashes_apart(spark, monkeypatch):
    from pyspark.sql import functions as F

    from brineframe.llm import exact_dedup

    monkeypatch.setattr(exact_dedup.F, "md5", lambda c: F.lit("00" * 16))
    out = exact_dedup.exact_groups(spark.createDataFrame([(3, "a b"), (1, "c"), (2, "a  b")], "doc_id long, text string"))
    assert {(r[0], r[1], r[2], r[3]) for r in out.collect()} == {(3, 2, 2, False), (2, 2, 2, True), (1, 1, 1, True)}


@pytest.mark.parametrize("bucket", [250_000, 100])
def test_substring_dedup(spark, rows, bucket, monkeypatch):
    """Also with long texts of one word or a few, whose super-k-mers are as long as they are, and with split buckets."""
    from brineframe.llm import substring_dedup as module
    from brineframe.llm.substring_dedup import substring_dedup

    monkeypatch.setattr(module, "BUCKET_WORDS", bucket)
    monkeypatch.setattr(module, "COMBINE", bucket * 10)
    rows = rows + [(7000 + k, "ab " * (30 + 97 * k) + "cd " * k, "en", "s", 1) for k in range(12)] + [(7100 + k, "x y " * (9 * k) + f"z{k}", "en", "s", 1) for k in range(6)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for window, short in ((35, 8), (6, 2)):
        words = [WORD.findall(r[1] or "") for r in rows]
        starts = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
        want = Counter()
        for r, w in zip(rows, words):
            gone = {i + j for i in range(len(w) - window + 1) if starts[tuple(w[i : i + window])] > 1 for j in range(window)}
            want[(r[0], len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))] += 1
        assert multiset(substring_dedup(docs, window, short), "doc_id", "n_words", "n_removed", "kept_sha256") == want


def clean_lines(rows):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    order = lambda i: (i is None, i or 0)
    holders = defaultdict(set)
    for r in rows:
        for x in (r[1] or "").split("\n"):
            holders[key(x)].add(r[0])
    out = []
    for r in rows:
        lines = (r[1] or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or min(holders[key(x)], key=order) == r[0]]
        out.append((r[0], len(lines), len(lines) - len(kept), "\n".join(kept)))
    return Counter(out)


def test_line_dedup(docs, rows):
    from brineframe.llm.line_dedup import line_dedup

    for options in ({"shards": 4}, {"batches": 1}, {"batches": 3, "again": 3}):
        assert multiset(line_dedup(docs, **options), "doc_id", "n_lines", "n_dropped", "kept_text") == clean_lines(rows)


def test_line_dedup_is_incremental_and_reversible(spark, rows, tmp_path):
    from brineframe.llm.line_dedup import LineIndex

    rows = [r for r in {r[0]: r for r in rows}.values()]
    index = LineIndex(spark, str(tmp_path / "index"), shards=3)
    frame = lambda some: spark.createDataFrame(some, SCHEMA)
    index.insert(frame(rows[::2]), "a")
    assert index.looked_up == 0
    index.insert(frame(rows[1::2]), "b")
    assert index.looked_up > 0  # the filters hold lines of the first batch
    index.insert(frame(rows[1::2]), "b")  # committed before: no change
    assert multiset(index.clean(frame(rows)), "doc_id", "n_lines", "n_dropped", "kept_text") == clean_lines(rows)
    gone = sorted((r for r in rows if r[0] is not None), key=lambda r: r[0])[:20]
    index.delete(frame(gone), "c")
    left = [r for r in rows if r not in gone]
    assert multiset(index.clean(frame(left)), "doc_id", "n_lines", "n_dropped", "kept_text") == clean_lines(left)
    index.insert(frame(gone[:7]), "d")
    back = left + gone[:7]
    assert multiset(index.clean(frame(back)), "doc_id", "n_lines", "n_dropped", "kept_text") == clean_lines(back)


def test_line_index_takes_an_id_again(spark, tmp_path):
    """A live id that comes again has the lines of both texts; deleting a null id deletes all of them."""
    from brineframe.llm.line_dedup import LineIndex

    index = LineIndex(spark, str(tmp_path / "index"), shards=3)
    frame = lambda some: spark.createDataFrame(some, "doc_id long, text string")
    state = lambda: {(r["docs"], r["owner"]) for r in index._counts(index.log).collect()}
    index.insert(frame([(1, "a line of one text"), (2, "a line of one text"), (None, "a line of nobody")]), "a")
    index.insert(frame([(1, "a line of one text\nanother of its lines"), (3, "ANOTHER of its lines")]), "b")
    assert state() == {(2, 1), (1, (1 << 63) - 1)}
    assert index.shared().count() == 2
    index.delete(frame([(1, None), (None, None), (77, None)]), "c")
    assert state() == {(1, 2), (1, 3)} and index.shared().count() == 0
    assert LineIndex(spark, str(tmp_path / "index"), shards=9).shards == 3


def test_line_index_opens_touched_folders_only(spark, tmp_path):
    """A small batch gives the same with all folders of earlier batches gone that it does not touch."""
    import shutil

    from brineframe.llm.line_dedup import LineIndex

    frame = lambda some: spark.createDataFrame(some, "doc_id long, text string")
    big = [(i, f"line number {i % 150} of many\nline {i} of its own") for i in range(300)]
    first = LineIndex(spark, str(tmp_path / "one"), shards=32)
    first.insert(frame(big), "big")
    first.delete(frame([(i, None) for i in range(200, 260)]), "early")
    shutil.copytree(tmp_path / "one", tmp_path / "two")
    results = []
    for name in ("one", "two"):
        index = LineIndex(spark, str(tmp_path / name))
        if name == "two":
            left, lost = 0, set()
            for table, by in (("counts", "shard"), ("holders", "shard"), ("filters", "shard"), ("refs", "bucket"), ("gone", "bucket")):
                touched = {p.name for k in (2, 3) for t in (("counts", "filters") if by == "shard" else ("refs", "gone")) for p in (tmp_path / "one" / t / f"seq={k}").glob(f"*/{by}=*")}
                if by == "bucket":  # the documents that may inherit the deleted one's lines
                    touched |= {f"bucket={r[0]}" for r in frame([(157, None), (1000, None)]).select(index._bucket("doc_id")).collect()}
                for k in (0, 1):
                    for p in (tmp_path / "two" / table / f"seq={k}").glob(f"*/{by}=*"):
                        if p.name not in touched:
                            shutil.rmtree(p)
                            lost.add(table)
                left += len(touched)
            assert left < 50 and len(lost) == 5
        index.insert(frame([(1000, "line number 7 of many\na fresh line")]), "small")
        index.delete(frame([(7, None)]), "less")
        rows = index.log.read("counts", index.COUNTS, of={k: v for k, v in index.log.commits().items() if k > 1})
        clean = index.clean(frame([(1000, "line number 7 of many\na fresh line")]), whole=False)
        results.append(({(bytes(r["key"]), r["docs"], r["owner"], r["seq"]) for r in rows.collect()}, [tuple(r) for r in clean.collect()]))
    assert results[0] == results[1] and any(r[1:] == (3, 7, 2) for r in results[0][0]) and any(r[1:] == (2, 157, 3) for r in results[0][0])
    assert results[0][1] == [(1000, "line number 7 of many\na fresh line", 2, 1, "a fresh line")]


def interrupted(log, name, other):
    """``Ledger.begin``, by which ``other`` happens once, after the writer of ``log`` has seen the state for the batch ``name``."""
    from brineframe.sources.ledger import Ledger

    begin, met = Ledger.begin, []

    def held(self, own):
        batch = begin(self, own)
        if own == name and self is log:
            met.append(own)
            if len(met) == 1:
                other()
        return batch

    return held


def test_batches_that_overlap_lose_nothing(spark, tmp_path, monkeypatch):
    """Two writers see the same state; the second to commit begins anew on top of the first."""
    from brineframe.sources.ledger import Ledger
    from brineframe.llm.line_dedup import LineIndex
    from brineframe.llm.token_counts import TokenRollup

    frame = lambda some: spark.createDataFrame(some, "doc_id long, text string, source string, lang string")
    one, two = (TokenRollup(spark, str(tmp_path / "tokens"), {"words": None}) for _ in range(2))
    one.apply("start", frame([(5, "w " * 10, "s", "en"), (6, "w w", "s", "en")]))
    apply = one.log.apply
    # the state is looked at once more when the counts of the batch are made: the other batch comes after that
    monkeypatch.setattr(one.log, "apply", lambda name, work: monkeypatch.setattr(Ledger, "begin", interrupted(one.log, "a", lambda: two.apply("b", frame([(5, "w " * 3, "s", "en"), (7, "w", "s", "en")])))) or apply(name, work))
    assert one.apply("a", frame([(5, "w " * 7, "s", "en")]))
    assert [tuple(r) for r in one.totals().select("docs", "tokens").collect()] == [(3, 10)]
    assert [name for _, (name, _) in sorted(two.log.commits().items())] == ["start", "b", "a"] and not two.apply("a", frame([(5, "w", "s", "en")]))

    line = "a line that three documents hold"
    one, two = (LineIndex(spark, str(tmp_path / "lines"), shards=2) for _ in range(2))
    one.insert(frame([(1, line, "s", "en")]), "start")
    with monkeypatch.context() as m:
        m.setattr(Ledger, "begin", interrupted(one.log, "a", lambda: two.insert(frame([(3, line, "s", "en")]), "b")))
        one.insert(frame([(2, line, "s", "en")]), "a")
    count = lambda: [tuple(r) for r in two._counts(two.log).select("docs", "owner").collect()]
    assert count() == [(3, 1)]
    two.delete(frame([(1, None, None, None), (2, None, None, None)]), "c")
    assert count() == [(1, 3)] and two.clean(frame([(3, line, "s", "en")])).first()["kept_text"] == line


def test_ledger_gives_a_number_once(spark, tmp_path):
    from brineframe.sources.ledger import Ledger

    one, two = Ledger(spark, str(tmp_path / "log")), Ledger(spark, str(tmp_path / "log"))
    a, b = one.begin("a"), two.begin("b")
    rows = lambda *x: spark.createDataFrame([(v,) for v in x], "v long")
    a.write("t", rows(1))
    b.write("t", rows(2))
    assert one.read("t", "v long").count() == 0
    assert b.commit() and not a.commit() and [r["v"] for r in one.read("t", "v long").collect()] == [2]
    assert one.begin("b") is None and one.begin("a").seq == 1
    assert one.fixed("n", 4) == two.fixed("n", 7) == 4
    with pytest.raises(ValueError):
        one.begin("x" * 101)


def test_cuckoo_filter_holds_what_was_put_in():
    from brineframe.llm.line_dedup import CuckooFilter

    rng = np.random.default_rng(1)
    keys, others = rng.integers(0, 1 << 63, 30_000).astype(np.uint64), rng.integers(0, 1 << 63, 30_000).astype(np.uint64)
    own = CuckooFilter(1000)
    own.insert(keys)
    assert own.contains(keys).all() and own.contains(others).mean() < 0.01
    own.remove(keys[:500])
    assert own.contains(keys[500:]).all() and own.contains(keys[:500]).mean() < 0.05


def brute_quality(rows, min_docs, max_share, min_left):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    hosts, docs_of = Counter(r[3] for r in rows), Counter()
    for r in rows:
        docs_of.update({(r[3], key(x)) for x in (r[1] or "").split("\n") if WORD.search(x)})
    often = {k for k, n in docs_of.items() if n > min_docs and n > max_share * hosts[k[0]]}
    out = []
    for r in rows:
        text, w = r[1] or "", WORD.findall(r[1] or "")
        grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        repeat = len({i + j for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for j in range(8)})
        lines = [x for x in text.split("\n") if WORD.search(x)]
        removed = sum(len(WORD.findall(x)) for x in lines if (r[3], key(x)) in often)
        failed = len(w) < 20 or 100 * repeat > 30 * len(w)
        out.append((r[0], len(w), len("".join(w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), repeat, failed, removed, not failed and len(w) - removed >= min_left * len(w)))
    return out, often, key


def test_quality_rules(docs, rows):
    from brineframe.llm.quality_rules import good_documents, quality_rules

    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_removed", "kept"]
    want, often, key = brute_quality(rows, 3, 0.1, 0.9)
    assert often and any(not w[-1] and not w[-3] for w in want)
    assert multiset(quality_rules(docs, min_docs=3, max_share=0.1, min_left=0.9), *columns) == Counter(want)
    kept = Counter()
    for r, w in zip(rows, want):
        if w[-1]:
            text = "\n".join(x for x in r[1].split("\n") if (r[3], key(x)) not in often)
            kept[(r[0], text, r[2], r[3], len(text))] += 1
    assert multiset(good_documents(docs, min_docs=3, max_share=0.1, min_left=0.9), "doc_id", "text", "lang", "source", "n_chars") == kept


def test_near_duplicates(docs, rows):
    from brineframe.llm.ngram_join import near_duplicates, one_of_each

    sets = []
    for r in rows:
        w = WORD.findall(r[1] or "")
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    near = [[a and b and i != j and len(a & b) >= 0.8 * len(a | b) for j, b in enumerate(sets)] for i, a in enumerate(sets)]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if near[i][j] or not sets[i] and not sets[j]:
                a, b = root[i], root[j]
                root = [a if x == b else x for x in root]
    ids = defaultdict(list)
    for r, c in zip(rows, root):
        ids[c].append(r[0])
    least = {c: min((x for x in xs if x is not None), default=None) for c, xs in ids.items()}
    want = Counter((r[0], least[c], sum(map(bool, near[i])), len(ids[c])) for i, (r, c) in enumerate(zip(rows, root)))
    assert any(k[2] > 1 for k in want)
    for block in (512, 2):
        assert multiset(near_duplicates(docs, block=block), "doc_id", "class_id", "n_links", "class_size") == want
    left = one_of_each(docs).collect()
    assert Counter(r["doc_id"] for r in left) == Counter(least.values())
    assert one_of_each(docs).columns == docs.columns


def test_near_duplicates_in_split_nodes(spark, monkeypatch):
    """A group of near copies that is larger than a node and a block loses no link."""
    from brineframe.llm import groups, ngram_join

    rng = random.Random(3)
    base = [f"w{rng.randint(0, 9999)}" for _ in range(120)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = f"x{i}"
        rows.append((i, " ".join(words)))
    monkeypatch.setattr(groups, "NODE", 20)
    out = {r["doc_id"]: r for r in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), block=16).collect()}
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    for i, a in enumerate(sets):
        assert out[i]["n_links"] == sum(len(a & b) >= 0.8 * len(a | b) for b in sets) - 1


def test_sorted_tries(spark):
    """Every label that shares a prefix with any other is found, with the longest such prefix, over all partitions."""
    from brineframe.llm import ngram_join as module

    rng = np.random.default_rng(4)
    sigs = rng.integers(0, 3, (60, module.VALUES)).astype(np.uint16)
    sigs[30:40] = sigs[20]
    reps = spark.createDataFrame([(i, bytes(x.tobytes())) for i, x in enumerate(sigs)], "rep long, sig binary").repartition(3)
    for floor in (1, 3, 6):
        got = {(bytes(r["label"])[0], r["rep"]): max(r["up"], r["down"]) for r in module.sorted_tries(reps, floor).collect()}
        want = {}
        for t, order in enumerate(module._ORDER):
            own = sigs[:, order]
            for i in range(60):
                shared = np.logical_and.accumulate(own == own[i], 1).sum(1)
                shared[i] = 0
                if shared.max() >= floor:
                    want[(t, i)] = shared.max()
        assert got == want


def test_prefixes_are_shortened_to_the_recall(spark, docs):
    """Few links are read at the depth computed for the threshold, close ones at a longer prefix; recall is measured."""
    from brineframe.llm import ngram_join as module

    rng = np.random.default_rng(6)

    def pairs(n, similarity):
        one = rng.integers(0, 60_000, (n, module.VALUES)).astype(np.uint16)
        other = np.where(rng.random(one.shape) < similarity, one, rng.integers(0, 60_000, one.shape)).astype(np.uint16)
        both = np.stack([one, other], 1).reshape(2 * n, -1)
        return both, spark.createDataFrame([(i, x.tobytes()) for i, x in enumerate(both)], "rep long, sig binary")

    depths = {}
    for n, similarity in ((3, 0.8), (6000, 0.83), (6000, 0.97)):
        both, reps = pairs(n, similarity)
        _, d, share = module.meeting_depth(reps, 0.8, 0.999)
        depths[similarity] = d
        same = both[::2] == both[1::2]
        links = same[same.mean(1) >= 0.8]
        met = np.logical_and.accumulate(links[:, module._ORDER], 2).sum(2).max(1) >= d
        assert share >= 0.999 and (met.mean() >= 0.998 or n < 100)
    assert depths[0.8] == 7 and depths[0.83] <= 7 < depths[0.97]
    with pytest.raises(ValueError, match="tries"):
        module.meeting_depth(pairs(3, 0.9)[1], 0.05)


def test_components(spark):
    from brineframe.llm.components import components

    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(40)] + [(rng.randint(100, 160), rng.randint(100, 160)) for _ in range(40)] + [(7, 7)]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    want = {x: find(x) for x in root if any(x in e and e[0] != e[1] for e in edges)}
    assert dict(tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect()) == want
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_mixing(docs, rows):
    from brineframe.llm.mixing import mix_documents, mixed

    out = mixed(docs).collect()
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    assert Counter((r["doc_id"], r["size"]) for r in out) == Counter((r[0], len(WORD.findall(r[1] or ""))) for r in rows)
    taken, longest, targets = Counter(), Counter(), {}
    for r in out:
        assert r["source_size"] == sizes[r["source"]] and r["taken"] <= 2 * r["size"] and r["target"] <= 2 * sizes[r["source"]]
        taken[r["source"]] += r["taken"]
        longest[r["source"]] = max(longest[r["source"]], r["size"])
        targets[r["source"]] = r["target"]
    assert sum(targets.values()) == pytest.approx(1.5 * sum(sizes.values()))
    for s, t in targets.items():
        assert abs(taken[s] - t) <= longest[s] / 2 + 1
    again = [tuple(r) for r in mixed(docs.repartition(5)).collect()]
    assert Counter(again) == Counter(tuple(r) for r in out)
    made = Counter((r["doc_id"], r["text"]) for r in mix_documents(docs).collect())
    words = Counter()
    for (i, text), n in made.items():
        words[i] += n * len(WORD.findall(text))
    want = Counter()
    for r in out:
        want[r["doc_id"]] += r["taken"]
    assert +words == +want


def test_water_fill():
    from brineframe.llm.mixing import water_fill

    assert water_fill([10, 100, 100], [3, 1, 2], 315, 2) == pytest.approx([20, 295 / 3, 590 / 3])
    assert water_fill([10, 10], [3, 1], 30, 2) == pytest.approx([20, 10])
    assert water_fill([], [], 0, 2) == [] and water_fill([0, 0], [1, 2], 0, 2) == [0, 0]


@pytest.fixture(scope="module")
def tokenizer():
    public = pytest.importorskip("public_tokenizers")
    return public.path("byte_bpe_50k.json")


TRICKY = ["", None, " a b", "foo  bar", "x\n\ny", "don't stop.", "end ", "\nhello, World!\nYes?no", "…, é. é.", "<|endoftext|> hi", "a\x1cb c", "\u3000x y", "a\u2028 b", "日本語 テスト。", "e.g. a.b.", "wow!! ok?! 12. x1."]


def test_copies_are_no_boilerplate(spark):
    """A clean text stays however many copies it has; a line of many different texts goes."""
    from brineframe.llm.quality_rules import good_documents

    say = lambda i, k: " ".join(f"w{i}x{j}" for j in range(k))
    clean, line = say("c", 20) + "\n" + say("d", 20), "accept all of our cookies"
    texts = [clean] * 40 + [line + "\n" + say(i, 40) for i in range(30)] + [say(i, 40) for i in range(100, 230)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], SCHEMA)
    got = Counter(r["text"] for r in good_documents(docs).collect())
    assert got == Counter(t.removeprefix(line + "\n") for t in texts) and got[clean] == 40


def test_encoder_equals_tokenizers(tokenizer, rows):
    from brineframe.llm.tokens import Encoder

    own = Encoder(tokenizer)
    assert own.words is not None
    for _ in range(2):
        texts = TRICKY + [r[1] for r in rows]
        ids, bounds = own(pa.array(texts, pa.string()))
        for i, t in enumerate(texts):
            assert ids[bounds[i] : bounds[i + 1]].tolist() == own.tokenizer.encode(t or "", add_special_tokens=False).ids, t


def test_encoder_added_tokens(tokenizer):
    """The strings of added tokens get the ids of the file, as by tokenizers called with add_special_tokens=False."""
    from tokenizers import Tokenizer

    from brineframe.llm.tokens import Encoder

    own, plain = Encoder(tokenizer), Tokenizer.from_file(tokenizer)
    texts = ["a <|endoftext|> hi", "plain words", None, "x<|endof", "text|>y", "", "<|endoftext|>", "b\n<|endoftext|><|endoftext|>c"]
    for _ in range(2):  # new words, then cached ones
        ids, bounds = own(pa.array(texts, pa.large_string()))
        got = [ids[bounds[i] : bounds[i + 1]].tolist() for i in range(len(texts))]
        assert got == [plain.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert got[0] == [64, 220, 50256, 23105]


def test_packing_round_trip(spark, rows, tokenizer):
    from tokenizers import Tokenizer

    from brineframe.llm.packing import pack

    plain = Tokenizer.from_file(tokenizer)
    some = rows + [(10_000 + i, "lorem ipsum " * (i * 7 % 400), "en", "s0", 1) for i in range(200)]
    docs = spark.createDataFrame(some, SCHEMA)
    out = pack(docs, tokenizer, shard_pieces=80).collect()
    pieces = Counter()
    for r in some:
        ids = np.array([*plain.encode(r[1] or "", add_special_tokens=False).ids, 0], "<u4")
        for a in range(0, len(ids), 1024):
            part = ids[a : a + 1024]
            pieces[(r[0], a, len(part), zlib.crc32(part.tobytes()), len(ids))] += 1
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in out) == pieces
    sequences = defaultdict(list)
    for r in out:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(r["length"] for r in out)
    assert len(sequences) <= -(-total // 1024) + 8


def test_best_fit_equals_a_plain_search():
    from brineframe.llm.packing import best_fit

    rng = random.Random(0)
    lengths = sorted((rng.randint(1, 1023) for _ in range(800)), reverse=True)
    room, want = [], []
    for n in lengths:
        fits = [r for r in room if r >= n]
        if fits:
            r = min(fits)
            room.remove(r)
        else:
            r = 1024
        want.append(1024 - r)
        if r > n:
            room.append(r - n)
    assert best_fit(lengths, 1024)[1] == want


def test_token_rollups(spark, rows, tokenizer, tmp_path):
    from brineframe.llm.token_counts import TokenRollup

    rollup = TokenRollup(spark, str(tmp_path / "rollup"), {"bpe": tokenizer, "words": None})
    frame = lambda some: spark.createDataFrame(some, SCHEMA)
    state: list = []

    def want():
        from tokenizers import Tokenizer

        plain = Tokenizer.from_file(tokenizer)
        out = Counter()
        for r in state:
            for version, n in (("bpe", len(plain.encode(r[1] or "", add_special_tokens=False).ids)), ("words", len(WORD.findall(r[1] or "")))):
                for c, v in (("docs", 1), ("tokens", n), ("chars", len(r[1] or ""))):
                    out[(r[3], r[2], version, c)] += v
        return {k: v for k, v in out.items() if v}

    def got():
        return {(r["source"], r["lang"], r["version"], c): r[c] for r in rollup.totals().collect() for c in ("docs", "tokens", "chars") if r[c]}

    assert rollup.apply("one", frame(rows)) and not rollup.apply("one", frame(rows))
    state += rows
    assert got() == want()
    revised = [(r[0], (r[1] or "") + " more", "xx", r[3], 0) for r in rows if r[0] is not None and r[0] % 2 == 0][:10]
    deleted = [r for r in rows if r[0] is not None and r[0] % 2][:10]
    new = [(77_777, "fresh text", "en", "s9", 1), (None, "nobody's", "en", "s9", 1)]
    assert rollup.apply("two", frame(revised + new), frame(deleted + [(424_242, "", "", "", 0)]))
    out = {r[0] for r in revised + deleted}
    state[:] = [r for r in state if r[0] not in out] + revised + new
    assert got() == want()
    assert not rollup.apply("two", frame(revised + new))
    assert got() == want()


def test_isotonic():
    from brineframe.llm.classifier import isotonic

    assert isotonic(np.array([0.1, 0.5, 0.3, 0.9]), np.ones(4)).tolist() == pytest.approx([0.1, 0.4, 0.4, 0.9])
    assert isotonic(np.zeros(0), np.zeros(0)).tolist() == []


def test_quality_scores(spark, rows):
    from brineframe.llm.classifier import quality_scores

    rng = random.Random(2)
    some, marks = [], []
    for i in range(400):
        words = [rng.choice(["ban", "dor", "kel", "mi", "sa"]) + str(rng.randint(0, 50)) for _ in range(rng.randint(30, 90))]
        bad = i % 4 == 0
        some.append((i, " ".join(w + "###" * (bad and rng.random() < 0.5) for w in words), "en", "s", 1))
        marks.append((i, int(not bad)))
    marks += [(3, None), (None, 1), (5, 1), (5, 1), (999_999, 0)]
    out = {r["doc_id"]: r for r in quality_scores(spark.createDataFrame(some, SCHEMA), spark.createDataFrame(marks, "doc_id long, quality int")).collect()}
    assert len(out) == 400 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in out.values())
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in out.items())
    held = [i for i, r in out.items() if r["held_out"]]
    assert np.mean([(out[i]["predicted"] == 1) == (i % 4 != 0) for i in held]) > 0.95
    odd = quality_scores(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([], "doc_id long, quality int")).collect()
    assert len(odd) == len(rows) and all(r["score"] == 0.5 for r in odd)


def test_ridge_equals_a_direct_solution(spark, docs):
    """Summed normal equations give the weights that numpy finds for all rows at once; calibration pools the other fold."""
    from brineframe.llm import classifier

    own = [r["features"] for r in classifier.featured(docs).collect()]
    table = [(f, float((k * 7) % 3 == 0), k % 5) for k, f in enumerate(own)]
    model = classifier.fit(spark.createDataFrame(table, "features array<double>, label double, fold int").repartition(5))
    x, y = np.array([f for f, _, k in table if k != 1]), np.array([v for _, v, k in table if k != 1])
    z = (x - x.mean(0)) / np.where(x.std(0) < 1e-9, 1, x.std(0))
    random_ = np.random.default_rng(0)
    waves, shifts = random_.normal(0, 1 / classifier.SCALE, (x.shape[1], classifier.RANDOM)), random_.uniform(0, 2 * np.pi, classifier.RANDOM)
    design = np.hstack([np.ones((len(z), 1)), np.clip(z, -6, 6), np.cos(np.clip(z, -6, 6) @ waves + shifts) * np.sqrt(2 / classifier.RANDOM)])
    want = np.linalg.solve(design.T @ design + np.diag([1e-9] + [classifier.RIDGE * len(y)] * (design.shape[1] - 1)), design.T @ y)
    assert np.abs(model.design(x) @ model.weights - design @ want).max() < 1e-4
    assert (np.diff(model.levels) >= 0).all() and (np.diff(model.steps) > 0).all()
    fold = np.array([f for f, _, k in table if k == 1])
    assert model.score(fold).mean() == pytest.approx(np.mean([v for _, v, k in table if k == 1]), abs=0.1)


def test_clashing_columns_of_counts_scores_and_urls(spark, rows, tmp_path):
    from pyspark.sql import functions as F

    from brineframe.llm import classifier, token_counts, url_filter

    names = ["folder", "tokens", "docs", "chars", "version", "seq", "features", "score", "label", "fold", "host", "path", "run", "known", "key", "n", "own", "seen", "rest", "verdict", "rule"]
    wide = lambda df: df.select("*", *(F.lit("clash").alias(c) for c in names if c not in df.columns))
    docs = spark.createDataFrame(rows + [(8000, "long " * 200_000, "en", "s0", 1)], SCHEMA)
    labels = spark.createDataFrame([(i, i % 2) for i in range(-20, 150)], "doc_id long, quality int")
    pages = spark.createDataFrame([(k, f"http://{h}.example.org/en/{k}") for k, h in enumerate(["free-bets", "garden", "freebets"] * 4)] + [(None, None)], "page_id long, url string")
    totals = [token_counts.token_counts(d, str(tmp_path / str(k)), {"words": None}, again=3).totals() for k, d in enumerate((docs, wide(docs)))]
    plain = token_counts.TokenRollup(spark, str(tmp_path / "plain"), {"words": None})
    plain.apply("all", docs)
    for a, b in (totals, (totals[0], plain.totals()), [classifier.quality_scores(d, w) for d, w in ((docs, labels), (wide(docs), wide(labels)))], [url_filter.judge_urls(p) for p in (pages, wide(pages))]):
        assert a.columns == b.columns and Counter(map(tuple, a.collect())) == Counter(map(tuple, b.collect()))


def test_url_filter(spark):
    from brineframe.llm.url_filter import RULES, Rules, judge_urls

    urls = [f"https://{w}{i}.example.edu/de/{i}" for i in range(30) for w in ("garden", "library", "weather", "recipes")] + [f"http://casino-win.example.edu/x/{i}?q" for i in range(9)] + [f"http://free-bets.example.edu/x/{i}" for i in range(9)]
    odd = ["http://CasinoWin.example.edu/x/1", "https://freebets.example.edu#x", None, "no url", "http://a.EXAMPLE.com/en/7x?y", "http://b.com/en/8", "ftp://x.example.net/de/81#t", "x://y.net/de/", "http://z.org", "http://z.org/es/?q", "http://notcom/en/", ""]
    out = {r["page_id"]: r for r in judge_urls(spark.createDataFrame(list(enumerate(urls + odd)), "page_id long, url string")).collect()}
    assert [out[i]["verdict"] for i in range(120)] == ["allow"] * 120
    assert {out[i]["verdict"] for i in range(120, 138)} == {"block"}
    last = [tuple(out[len(urls) + k])[1:] for k in range(len(odd))]
    assert last[0] == ("casinowin.example.edu", "/x/1", None, "block") and last[1][3] == "block"
    assert last[2][:3] == ("", "", None) and last[3][:2] == ("", "") and last[11][:2] == ("", "")
    assert last[4] == ("a.example.com", "/en/7x", "example.com/en/7", "allow")
    assert last[5][2:] == ("com/en/", "block") and last[6][2:] == ("example.net/de/8", "block") and last[7][2:] == ("net/de/", "allow")
    assert last[8][1:3] == ("", None) and last[9] == ("z.org", "/es/", "org/es/", "block") and last[10][2] is None
    assert Rules(RULES).match("example.com", "/en/71")[0] == "example.com/en/7"


def test_url_filter_splits_names(spark):
    """Joined names are split and blocked however often they are seen; words that hold others are not."""
    from brineframe.llm import url_filter

    urls = [f"https://{w}{i}.example.edu/de/{i}" for i in range(60) for w in ("garden", "library", "uploads", "alphabets")]
    urls += [f"http://{w}.example.edu/de/{i}" for i in range(9) for w in ("casino-win", "free-bets", "cheap-pills", "poker-royale")]
    names = [f"http://{w}{i}.example.edu/de/{i}" for i in range(30) for w in ("casinowin", "freebets", "CheapPills")] + [f"http://pokerroyale.example.edu/de/{i}" for i in range(8)]
    names += ["http://casinowin.example.edu/"]
    pages = spark.createDataFrame(list(enumerate(urls + names)), "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge_urls(pages).collect()}
    assert [got[i] for i in range(240)] == ["allow"] * 240
    assert [got[i] for i in range(240, len(urls + names))] == ["block"] * (36 + len(names))
    parts = pages.select(url_filter.host_of(pages.url).alias("host"), url_filter.path_of(pages.url).alias("path"))
    words = {r["run"]: r["words"] for r in url_filter.split_runs(url_filter.run_counts(parts)).collect()}
    assert words["casinowin"] == ["casino", "win"] and words["pokerroyale"] == ["poker", "royale"]
    assert all(words[w] == [w] for w in ("uploads", "alphabets", "garden", "example", "download"))


def test_url_filter_reads_the_text_of_pages(spark):
    """Words of the visible text split names of hosts, however often those are seen; words may have any length."""
    from brineframe.llm import url_filter

    assert url_filter.visible(b"a<b>c</b><script>var x = '<p>no</p>';</script><STYLE>p{}</style >d <!-- ad 0 --> 1 < 2 e<script>f").split() == b"a c d 1 < 2 e".split()
    long = "donaudampfschifffahrtsgesellschaft"
    text = f"<p>The river bank, the river; a bank.</p><p>{long} is \"known\" (river.bank.example) &copy; the</p><script>var casinoriver;</script>" * 40
    urls = ["http://riverbank.example.org/x"] * 30 + [f"http://www.{long}bank.example.org/{'q' * 3000}", "http://" + "".join(random.Random(2).choices("abcdefghij", k=20_000)) + "/"]
    pages = spark.createDataFrame([(i, u, text if i % 2 else None, "x") for i, u in enumerate(urls)], "page_id long, url string, html string, verdict string")
    parts = pages.select(url_filter.host_of(pages.url).alias("host"), url_filter.path_of(pages.url).alias("path"))
    counts = url_filter.run_counts(parts, pages.select("html"))
    n = {r["run"]: (r["n"], r["own"]) for r in counts.collect()}
    assert n["river"] == (16 * 40 * 2, 16 * 40 * 2) and "casinoriver" not in n and "copy" not in n and n["riverbank"] == (30, 1)
    words = {r["run"]: r["words"] for r in url_filter.split_runs(counts).collect()}
    assert words["riverbank"] == ["river", "bank"] and words[long + "bank"] == [long, "bank"] and words["q" * 3000] == ["q" * 3000] and words["example"] == ["example"]
    assert all("".join(w) == r for r, w in words.items())
    got = url_filter.judge_urls(pages)
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"] and {r["verdict"] for r in got.collect()} == {"allow"}


def test_url_filter_counts_all(spark):
    """Counts have no limit: verdicts are the same whether scores are held or joined, at any size."""
    from brineframe.llm import url_filter

    rng = random.Random(5)
    name = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(1, 30)))
    seeds = ["casino-", "poker.", ""]
    urls = [f"http://{rng.choice(seeds)}{name()}.example.edu/{name()}/{name()}/{i % 7}" for i in range(300)] * 2 + [None, "", "http://x.edu"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    want = multiset(url_filter.judge_urls(pages), "page_id", "host", "path", "rule", "verdict")
    assert sum(want.values()) == len(urls) and len({k[4] for k in want}) == 2
    for held in (0, 1, 40):
        assert multiset(url_filter.judge_urls(pages, held=held), "page_id", "host", "path", "rule", "verdict") == want
    assert not hasattr(url_filter, "TOKENS")


def test_empty_tables(spark, tokenizer, tmp_path):
    from brineframe.llm import classifier, exact_dedup, line_dedup, mixing, ngram_join, packing, quality_rules, substring_dedup, token_counts, url_filter

    none = spark.createDataFrame([], SCHEMA)
    assert exact_dedup.exact_groups(none).count() == 0
    assert line_dedup.line_dedup(none).count() == 0
    assert substring_dedup.substring_dedup(none).count() == 0
    assert quality_rules.quality_rules(none).count() == 0 and quality_rules.good_documents(none).count() == 0
    assert ngram_join.near_duplicates(none).count() == 0 and ngram_join.one_of_each(none).count() == 0
    assert mixing.mixed(none).count() == 0 and mixing.mix_documents(none).count() == 0
    assert packing.pack(none, tokenizer).count() == 0
    assert classifier.quality_scores(none, spark.createDataFrame([], "doc_id long, quality int")).count() == 0
    assert url_filter.judge_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0
    rollup = token_counts.TokenRollup(spark, str(tmp_path / "none"), {"words": None})
    assert rollup.apply("none", none) and rollup.totals().count() == 0
    with pytest.raises(ValueError, match="name"):
        rollup.apply("n" * 101, none)


def test_clashing_columns(spark, rows, tokenizer):
    """Extra columns named like those that the operators make are passed over or kept, never mixed up."""
    from pyspark.sql import functions as F

    from brineframe.llm import exact_dedup, line_dedup, mixing, ngram_join, packing, quality_rules, substring_dedup

    docs = spark.createDataFrame(rows, SCHEMA)
    names = ["id", "norm", "hash", "row", "piece", "size", "target", "kept", "class_id", "sig", "line", "n_words", "start", "draw", "links", "shard", "key", "doc", "k1", "k2", "gone", "repeats", "packed", "words", "features", "label"]
    wide = docs.select("*", *(F.lit("clash").alias(c) for c in names))
    for f in (exact_dedup.exact_groups, substring_dedup.substring_dedup, quality_rules.quality_rules, ngram_join.near_duplicates, mixing.mixed, lambda d: packing.pack(d, tokenizer).drop("sequence_id", "offset")):
        a, b = f(docs), f(wide)
        drop = [c for c in ("k1", "k2", "class_row") if c in a.columns]  # row numbers depend on the partitions
        assert Counter(map(tuple, a.drop(*drop).collect())) == Counter(map(tuple, b.drop(*drop).collect()))
    for f in (ngram_join.one_of_each, mixing.mix_documents, quality_rules.good_documents):
        out = f(wide)
        assert out.columns == wide.columns and {r["size"] for r in out.select("size").collect()} == {"clash"}
    assert {r["shard"] for r in line_dedup.line_dedup(wide, shards=2).select("shard").collect()} == {"clash"}
