"""URL filters: rules first, then naive Bayes over words that a unigram Viterbi finds in host and path.

Unigrams are the words of the pages' visible text, the runs of letters in hosts (once for
each different host) and paths, and listed words. A run that is several known words
is no word itself. So a name that joins frequent words is split even if it is seen on many pages.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator, Mapping
from math import inf, log

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import prepare, stored
from .words import runs

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host, path): a rule fits its host and all subdomains where the path starts with its own.
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
#: Words that, standing alone in a host or found by segmentation, mark a page to learn blocking from.
SEEDS = ["adult", "ads", "bets", "betting", "casino", "escort", "gambling", "malware", "phishing", "pills", "poker", "porn", "spam", "viagra", "warez", "xxx"]
#: Words of names that the corpus may not spell alone; each counts once more for segmentation.
COMMON = ["best", "blog", "buy", "cheap", "click", "crack", "deal", "download", "farm", "forum", "free", "game", "games", "home", "live", "mail", "market", "mobile", "money", "news", "online", "shop", "site", "slots", "store", "track", "tracker", "video", "web", "win", "world"]
#: Scores that every worker holds, of the most frequent runs; those of all other runs are joined, so no number depends on it.
HELD = 50_000
#: Letters of a word of which so few are possible (18,278) that their counts go to every worker.
SHORT = 3
LISTED = frozenset(SEEDS + COMMON)
#: Letters of the parts of runs that are looked up; longer words are found by their first so many letters.
PREFIX = 24
#: Letters that a word which is not listed has at least, where it shows that a run is several words.
LEAST = 4
_RUN = re.compile("[a-z]+|[0-9]+")
_TAG = re.compile(rb"<(/?)(script|style)?[^<>]*>", re.I)
#: A word of a text: letters alone between white space, quotes and stops (so no part of a name with dots).
_WORD = re.compile(rb"(?<![^\s(\"'])[a-z]+(?=[.,;:!?)\"']*(?:\s|$))")


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


class Rules:
    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        self.by_host: dict[str, list[tuple[str, str]]] = {}
        for verdict, host, path in rules:
            self.by_host.setdefault(host, []).append((path, verdict))

    def match(self, host: str, path: str) -> tuple[str | None, str | None]:
        """The longest rule that fits, as text, and its verdict; of equally long ones that with the longer host."""
        best: tuple[int, int, str | None, str | None] = (-1, -1, None, None)
        parts = host.split(".")
        for k in range(len(parts)):
            own = ".".join(parts[k:])
            for start, verdict in self.by_host.get(own, ()):
                if path.startswith(start):
                    best = max(best, (len(own + start), len(own), own + start, verdict), key=lambda x: x[:2])
        return best[2], best[3]


def _lengths(known: Mapping[str, int], size: int) -> list[int]:
    """Lengths of words that a run of so many letters may hold: those of the known words, and all short ones."""
    return sorted({*range(1, min(SHORT, size) + 1)} | {len(w) for w in known})


def split(run: str, known: Mapping[str, int], short: Mapping[str, int], total: int) -> list[str]:
    """The cheapest split of a run of letters (Viterbi). Of equally cheap splits, the one whose last word is the
    longest of known ones, then known rather than unknown; before it, the same again. Words cost their negative log probability; an
    unknown word of n letters, of any length, costs more the longer it is. ``known``: the words of more than
    SHORT letters that the run holds."""
    lengths = _lengths(known, len(run))
    best, back, open_cost, open_from = [0.0], [0], inf, 0
    for end in range(1, len(run) + 1):
        # an unknown word up to here: one that began before, or with this letter
        if best[-1] + log(total) < open_cost:
            open_cost, open_from = best[-1] + log(total), end - 1
        open_cost += 2.3
        c, b = open_cost, open_from
        for n in lengths:
            if n > end:
                break
            w = run[end - n : end]
            times = known.get(w) or short.get(w)
            if times and (own := best[end - n] + log(total / times)) <= c:
                c, b = own, end - n
        best.append(c)
        back.append(b)
    words, end = [], len(run)
    while end:
        words.append(run[back[end] : end])
        end = back[end]
    return words[::-1]


def runs_of(host: str, path: str) -> tuple[list[str], list[str]]:
    return _RUN.findall(host), _RUN.findall(path.translate(str.maketrans(UPPER, LOWER)))


def placed_runs(host: str, path: str) -> list[tuple[str, str]]:
    """Runs with their place, which marks those of the path; all numbers are one run."""
    return [(x if x.isalpha() else "0", place) for place, own in zip(("", "/"), runs_of(host, path)) for x in own]


def marked(host: str) -> bool:
    return not set(SEEDS).isdisjoint(_RUN.findall(host))


def _run_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found: Counter = Counter()
        for host, path in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist()):
            for own in runs_of(host, path):
                found.update(x for x in own if x.isalpha())
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["run", "n"])


def visible(html: bytes) -> bytes:
    """What is left of a page without its tags, scripts and styles; each is read once."""
    out, at, inside = [], 0, None
    for m in _TAG.finditer(html):
        if inside is None:
            out.append(html[at : m.start()])
        at, name = m.end(), (m[2] or b"").lower()
        if inside is None and name and not m[1]:
            inside = name
        elif name == inside and m[1]:
            inside = None
    if inside is None:
        out.append(html[at:])
    return b" ".join(out)


def _text_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in runs(batch, "html"):
            found: Counter = Counter()
            for html in part.column("html").cast(pa.binary()).to_pylist():
                found.update(_WORD.findall(visible(html or b"").lower()))
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()).cast(pa.string()), pa.array(list(found.values()), pa.int64())], ["run", "n"])


def run_counts(parts: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """run, n, own, seen: of each run of letters in hosts (host) and paths (path), listed words and the words
    of ``texts`` (html): its occurrences; those of them that count for segmentation, which are one for
    each different host; and whether it is listed or in a host or path."""
    spark = parts.sparkSession
    nothing, empty = F.lit(0).cast("long"), F.lit("")
    count = lambda df: df.mapInArrow(_run_counts, "run string, n long")
    pages, paths, hosts = count(parts), count(parts.select(empty.alias("host"), "path")), count(parts.select("host").distinct().withColumn("path", empty))
    every = pages.select("run", "n", nothing.alias("own"), F.lit(True).alias("seen"))
    for df in (paths, hosts):
        every = every.union(df.select("run", nothing, "n", F.lit(False)))
    every = every.union(spark.createDataFrame([(w, 1) for w in SEEDS + COMMON], "run string, n long").select("run", "n", "n", F.lit(True)))
    if texts is not None:
        every = every.union(texts.mapInArrow(_text_counts, "run string, n long").select("run", "n", "n", F.lit(False)))
    return stored(every.groupBy("run").agg(F.sum("n").alias("n"), F.sum("own").alias("own"), F.max("seen").alias("seen")), "url-runs")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every part of a run that is too long for the table of short words, up to PREFIX letters, beside the run's hash."""
    for batch in batches:
        for run, key in zip(batch.column("run").to_pylist(), batch.column("key").to_pylist()):
            step = 4096  # a very long run goes in several batches
            for at in range(0, len(run), step):
                found = {run[k:end] for k in range(at, min(at + step, len(run))) for end in range(k + SHORT + 1, min(k + PREFIX, len(run)) + 1)}
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([key] * len(found), pa.string()), pa.array(list(found), pa.string())], ["key", "piece"])


def joined(run: str, n: int, known: Mapping[str, int], short: Mapping[str, int], total: int) -> bool:
    """Whether a run is several known words: each a listed one, or of LEAST letters and seen as often as
    the run. Its own count says nothing then, so words must be cheaper than an unknown word of its length; as cheap is not joined."""
    if run in LISTED:
        return False
    lengths, best = _lengths(known, len(run)), [0.0] + [inf] * len(run)
    for end in range(1, len(run) + 1):
        for size in lengths:
            if size > end or size == len(run):
                break
            w = run[end - size : end]
            times = known.get(w) or short.get(w, 0)
            if best[end - size] < inf and (w in LISTED or size >= LEAST and times >= n):
                best[end] = min(best[end], best[end - size] + log(total / max(times, 1)))
    return best[-1] < log(total) + 2.3 * len(run)


def _known(column: pa.Array) -> Iterator[dict[str, int]]:
    return ({x["piece"]: x["times"] for x in known or ()} for known in column.to_pylist())


def _joined(short: dict[str, int], total: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column("run").to_pylist(), batch.column("n").to_pylist(), _known(batch.column("known")))
            yield batch.filter(pa.array([joined(r, n, known, short, total) for r, n, known in rows], pa.bool_())).select(["run"])

    return run


def _split(short: dict[str, int], total: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [split(r, known, short, total) for r, known in zip(batch.column("run").to_pylist(), _known(batch.column("known")))]
            yield pa.RecordBatch.from_arrays([batch.column("run"), pa.array(words, pa.list_(pa.string()))], ["run", "words"])

    return run


def split_runs(counts: DataFrame) -> DataFrame:
    """run, words: each run of hosts and paths split by the counts of all runs that are not several words themselves."""
    n, own = (x + 1 for x in counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("own"), F.lit(0))).first())
    short = counts.where(F.length("run") <= SHORT).select("run", "n", "own").collect()
    seen, words = counts.where("seen").withColumn("key", F.md5("run")), counts.where(F.length("run") > SHORT).select(F.col("run").alias("piece"), "n", "own")
    pieces = seen.select("run", "key").mapInArrow(_pieces, "key string, piece string")
    found = pieces.join(words.where(F.length("piece") <= PREFIX), "piece").select("key", "piece", "n", "own")
    longer = words.where(F.length("piece") > PREFIX).withColumnRenamed("piece", "word").withColumn("piece", F.substring("word", 1, PREFIX))
    longer = pieces.where(F.length("piece") == PREFIX).join(longer, "piece").join(seen.select("key", "run"), "key").where(F.contains("run", "word")).select("key", F.col("word").alias("piece"), "n", "own")
    found = stored(found.unionByName(longer), "url-pieces")

    def known(pieces: DataFrame, times: str) -> DataFrame:
        return seen.join(pieces.groupBy("key").agg(F.collect_set(F.struct("piece", F.col(times).alias("times"))).alias("known")), "key", "left")

    several = stored(known(found, "n").mapInArrow(_joined({r["run"]: r["n"] for r in short}, n), "run string"), "url-joined").withColumnRenamed("run", "piece")
    left = known(found.join(several, "piece", "left_anti").where("own > 0"), "own")
    return stored(left.mapInArrow(_split({r["run"]: r["own"] for r in short}, own), "run string, words array<string>"), "url-words")


def unsure(host: str) -> bool:
    """Whether a host holds a seed word only inside of longer runs."""
    return not marked(host) and any(w in host for w in SEEDS)


def _class_counts(rules: Rules):
    """Runs by place and class of their page; pages themselves are counted as null runs. The class is the verdict of
    the page's rule; without one, whether its host is seeded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter = Counter()
            for host, path, seeded in zip(*(batch.column(c).to_pylist() for c in ("host", "path", "seeded"))):
                verdict = rules.match(host, path)[1]
                bad = verdict == "block" if verdict else seeded or marked(host)
                found.update((*x, bad) for x in placed_runs(host, path))
                found[None, "", bad] += 1
            columns = [pa.array([k[i] for k in found], t) for i, t in enumerate((pa.string(), pa.string(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(list(found.values()), pa.int64())], ["run", "place", "bad", "n"])

    return run


def _unsure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([unsure(h) for h in batch.column("host").to_pylist()], pa.bool_())], [*batch.schema.names, "unsure"])


def _host_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [(h, r) for h in batch.column("host").to_pylist() for r in set(_RUN.findall(h))]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.string()) for i in range(2)], ["host", "run"])


def with_seeded(parts: DataFrame, words: DataFrame) -> DataFrame:
    """``parts`` with ``seeded``: whether a run of the host, once split, has a seed word. Only hosts
    that hold a seed inside of a longer run are looked up."""
    urls = parts.mapInArrow(_unsure, "host string, path string, unsure boolean")
    hosts = urls.where("unsure").select("host").distinct().mapInArrow(_host_runs, "host string, run string")
    seeded = hosts.join(words, "run").where(F.arrays_overlap("words", F.array(*map(F.lit, SEEDS)))).select("host").distinct()
    looked = urls.where("unsure").join(seeded.withColumn("seeded", F.lit(True)), "host", "left")
    return urls.where("not unsure").select("host", "path", F.lit(False).alias("seeded")).union(looked.select("host", "path", F.coalesce("seeded", F.lit(False))))


def learn_scores(parts: DataFrame, words: DataFrame, rules: Iterable[tuple[str, str, str]] = ()) -> tuple[DataFrame, int]:
    """run, place, n, score of every run, and the prior, by multinomial naive Bayes over the runs' words.

    A page that a rule fits is an example of the rule's verdict. Of the others, those whose host has a seed word, between
    other characters or once its runs are split, are examples of blocking, and the rest of allowing. A score is the sum of its words' log likelihood ratios of blocking, the
    prior that of the classes; both are whole numbers of 1e-9, so sums don't depend on their order.
    """
    counted = with_seeded(parts, words).mapInArrow(_class_counts(Rules(rules)), "run string, place string, bad boolean, n long")
    both = stored(counted.groupBy("run", "place").agg(*(F.coalesce(F.sum(F.when(F.col("bad") == F.lit(b), F.col("n"))), F.lit(0)).alias(c) for c, b in (("bad", True), ("good", False)))), "url-classes")
    pages = both.where("run is null").first()
    tokens = both.where("run is not null").join(words, "run", "left").select("run", "place", "bad", "good", F.explode(F.coalesce("words", F.array("run"))).alias("word"))
    tokens = tokens.withColumn("token", F.concat("place", "word"))
    # the seeds are known to be bad, seen or not
    seeds = parts.sparkSession.createDataFrame([(w, 0, 0, 2) for w in SEEDS], "token string, bad long, good long, more long")
    table = tokens.select("token", "bad", "good", F.lit(0).cast("long").alias("more")).union(seeds).groupBy("token").agg(*(F.sum(c).alias(c) for c in ("bad", "good", "more")))
    table = stored(table, "url-tokens")
    size, bad, good = table.agg(F.count(F.lit(1)), F.sum("bad"), F.sum("good")).first()
    odds = F.log((F.col("bad") + F.col("more") + 1) / (bad + size)) - F.log((F.col("good") + 1) / (good + size))
    odds = table.select("token", F.round(odds * 1e9).cast("long").alias("odds"))
    scores = tokens.join(odds, "token").groupBy("run", "place").agg(F.sum("odds").alias("score"))
    scores = scores.join(both.select("run", "place", (F.col("bad") + F.col("good")).alias("n")), ["run", "place"])
    n_bad, n_good = (pages["bad"], pages["good"]) if pages else (0, 0)
    return stored(scores.select("run", "place", "n", "score"), "url-scores"), round(log((n_bad + 1) / (n_good + 1)) * 1e9)


def _judged(rules: Rules, held: dict[tuple[str, str], int], prior: int, joined: bool):
    """Verdicts of the pages whose runs are all held, or of those that come with the sum of the other runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rule, verdict = [], [], []
            rest = batch.column("rest").to_pylist() if joined else [0] * batch.num_rows
            for i, (host, path, more) in enumerate(zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), rest)):
                scores = [held.get(x) for x in placed_runs(host, path)]
                if joined or None not in scores:
                    r, v = rules.match(host, path)
                    at.append(i)
                    rule.append(r)
                    verdict.append(v or ("block" if prior + more + sum(x or 0 for x in scores) > 0 else "allow"))
            own = batch.select([0, 1, 2]).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string())], [*own.schema.names, "rule", "verdict"])

    return run


def _others(held: dict[tuple[str, str], int]):
    """The pages that have runs which are not held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([any(x not in held for x in placed_runs(h, p)) for h, p in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist())], pa.bool_()))

    return run


def _other_runs(held: dict[tuple[str, str], int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(h, p, *x) for h, p in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist()) for x in placed_runs(h, p) if x not in held]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.string()) for i in range(4)], ["host", "path", "run", "place"])

    return run


def judge_urls(pages: DataFrame, rules: Iterable[tuple[str, str, str]] = RULES, url: str = "url", key: str = "page_id", held: int = HELD, html: str = "html") -> DataFrame:
    """One row per page: ``key``, host, path, rule (null if none fits), verdict (allow or block).

    A null url, or one without ``://``, has an empty host and path and is judged by naive
    Bayes on no words, that is by the prior. Rows that repeat are judged alike. Of column ``html``, if there, only
    the words of the visible text are counted, as unigrams; nulls have none. Other columns are
    not read. All counts are of all pages; ``held`` only chooses which
    scores go to the workers and which are joined.
    """
    prepare(pages.sparkSession)
    rules = list(rules)
    parts = pages.select(F.col(key), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    urls = parts.select("host", "path")
    texts = pages.select(F.col(f"`{html}`").cast("string").alias("html")) if html in pages.columns else None
    scores, prior = learn_scores(urls, split_runs(run_counts(urls, texts)), rules)
    first = {(r["run"], r["place"]): r["score"] for r in scores.orderBy(F.desc("n"), "run", "place").limit(held).collect()}
    own = f"`{key}` {dict(parts.dtypes)[key]}, host string, path string"
    out = f"{own}, rule string, verdict string"
    judged = parts.mapInArrow(_judged(Rules(rules), first, prior, False), out)
    if len(first) < held:
        return judged
    others = parts.mapInArrow(_others(first), own)
    rest = others.select("host", "path").distinct().mapInArrow(_other_runs(first), "host string, path string, run string, place string")
    rest = rest.join(scores, ["run", "place"]).groupBy("host", "path").agg(F.sum("score").alias("rest"))
    others = others.join(rest, ["host", "path"]).select(F.col(f"`{key}`"), "host", "path", "rest")
    return judged.union(others.mapInArrow(_judged(Rules(rules), first, prior, True), out))
