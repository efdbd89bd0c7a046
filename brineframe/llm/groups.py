"""Groups of similar documents without pairs of them: candidate groups by signatures, links by exact sets.

Both steps cover a group by *leaders*. A member close to a leader is compared to leaders only, and the
triangle inequality (of the Hamming distance, of 1 - Jaccard) says how wide the comparison of
leaders must be so that no pair is lost. A group of near copies has few leaders, so it costs about its
size; large groups are split into salted parts, whose leaders meet in blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .components import components
from .words import runs

#: Members of a node that one task compares at once.
NODE = 1024
#: Rows of nodes and members for which a table that is written in between has a task.
TASK_ROWS = 50_000
#: Members of a node that are held before it is known whether several groups share it.
HELD = 1 << 20
#: Members of a part of a group, and numbers in their sets, that one task compares at once.
PART, PART_VALUES = 512, 1 << 22
#: For rounding of similarities.
SLACK = 1e-9


def grouped(keys: list[str], work: Callable[[pd.DataFrame], pd.DataFrame | None]):
    """For mapInPandas over sorted rows: calls ``work`` with the rows of each key, whatever batches they came in."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def flush() -> Iterator[pd.DataFrame]:
            if held:
                rows = pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]
                held.clear()
                out = work(rows)
                if out is not None and len(out):
                    yield out

        for batch in batches:
            if not len(batch):
                continue
            own = batch[keys].to_numpy()
            change = np.flatnonzero((own[1:] != own[:-1]).any(1)) + 1
            edges = [0, *change.tolist(), len(batch)]
            results = []
            for a, b in zip(edges, edges[1:]):
                if held and (held[-1][keys].iloc[-1].to_numpy() != own[a]).any() if a == 0 else bool(held):
                    results += flush()
                held.append(batch.iloc[a:b])
            if results:
                yield pd.concat(results, ignore_index=True)
        yield from flush()

    return run


def _joined(root: np.ndarray, some: np.ndarray) -> None:
    """Gives members of one set the least root of them."""
    met = np.unique(root[some])
    if len(met) > 1:
        root[np.isin(root, met)] = met[0]


def lead(sig: np.ndarray, close: float, related: float) -> tuple[np.ndarray, list[int]]:
    """For each member of a node the first member that it is connected with, and the members that lead.
    Members that differ from a leader in up to ``close`` values follow it; up to ``related`` they are connected."""
    root, leaders = np.arange(len(sig)), []
    left = np.arange(len(sig))
    while len(left):
        a, rest = left[0], left[1:]
        leaders.append(int(a))
        differ = np.count_nonzero(sig[rest] != sig[a], axis=1) if len(rest) else np.zeros(0)
        _joined(root, np.append(rest[differ <= related], a))
        left = rest[differ > close]
    return root, leaders


def _values(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint16).reshape(len(column), -1)


def _led(close: float, related: float):
    """An edge from each member to the first of its part of the node, and one from each leader to itself."""

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        rep = rows["rep"].to_numpy()
        root, leaders = lead(_values(rows["sig"]), close, related)
        tied = np.flatnonzero(root != np.arange(len(root)))
        return pd.DataFrame({"node": rows["node"].iloc[0], "a": rep[np.append(tied, leaders).astype(int)], "b": rep[np.append(root[tied], leaders).astype(int)]})

    return work


def _related(related: float):
    """An edge from each leader to the first of the leaders that it is connected with; all pairs are looked at."""

    def work(rows: pd.DataFrame) -> pd.DataFrame | None:
        rep, sig = rows["rep"].to_numpy(), _values(rows["sig"])
        root = np.arange(len(sig))
        for i in range(len(sig) - 1):
            if (root == root[0]).all():
                break
            _joined(root, np.append(i + 1 + np.flatnonzero(np.count_nonzero(sig[i + 1 :] != sig[i], axis=1) <= related), i))
        tied = np.flatnonzero(root != np.arange(len(root)))
        return pd.DataFrame({"a": rep[tied], "b": rep[root[tied]]}) if len(tied) else None

    return work


def _shared(batches: Iterator[pa.RecordBatch], most: int = HELD) -> Iterator[pa.RecordBatch]:
    """Of rows (node, rep, root) sorted by node: those of nodes whose members have several roots, numbered within the node.

    Rows stream by. Of the node at the end of a batch, rows are held while all its roots are one, up to ``most`` of them; then
    they go out too, which costs work and loses nothing."""
    last, held, out = None, [], False  # the node in progress: (node, root, rows so far), what is held of it, whether it goes out
    for batch in batches:
        if not batch.num_rows:
            continue
        node, root = batch.column("node").to_numpy(), batch.column("root").to_numpy()
        starts = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
        sizes = np.diff(np.append(starts, len(node)))
        low, high = np.minimum.reduceat(root, starts), np.maximum.reduceat(root, starts)
        mixed, before = low != high, np.zeros(len(starts), np.int64)
        if last and last[0] == node[0]:
            before[0] = last[2]
            mixed[0] |= out or low[0] != last[1]
            if mixed[0]:
                yield from held
                held = []
        else:
            held = []
        place = np.arange(len(node)) - np.repeat(starts - before, sizes)
        go = np.repeat(mixed, sizes)
        yield _numbered(batch, np.flatnonzero(go), place)
        if len(starts) > 1:
            held = []
        out = bool(mixed[-1])
        if not out:
            held.append(_numbered(batch, np.arange(starts[-1], len(node)), place))
            if sum(x.num_rows for x in held) > most:
                yield from held
                held, out = [], True
        last = int(node[-1]), int(low[-1]), int(place[-1]) + 1


def _numbered(batch: pa.RecordBatch, rows: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    own = batch.take(pa.array(rows))
    return pa.RecordBatch.from_arrays([own.column("node"), own.column("rep"), pa.array(place[rows])], ["node", "rep", "place"])


def candidate_groups(rounds: Iterable[Callable[[DataFrame], DataFrame]], sigs: DataFrame, close: float, related: float, apart: float) -> DataFrame:
    """node, root: groups of members of nodes by their signatures in ``sigs`` (rep, sig, others).

    Each of ``rounds`` gives the nodes (rep, root, node) of ``sigs`` with a column root, which is that of the rounds before: of
    a node whose members are in one group already nothing needs to be compared. So of a large group of near copies most nodes
    are passed over after the first round.

    A member that differs from a leader in up to ``close`` values follows it. Two that differ in up to d values are in one group
    if ``related`` is d + close (the leader of one against the other), and ``apart``, which counts between the leaders of a
    split node, d + 2 * close."""
    groups = None
    for nodes_of in rounds:
        if groups is None:
            known = sigs.withColumn("root", F.col("rep"))
        else:
            known = sigs.join(groups.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
        edges = _met(nodes_of(known), sigs, close, related, apart)
        if groups is None or edges is not None:
            before = [] if groups is None else [groups.select(F.col("node").alias("a"), F.col("root").alias("b"))]
            none = sigs.sparkSession.createDataFrame([], "a long, b long")
            groups = components(reduce(DataFrame.unionByName, before, none if edges is None else edges))
    return groups


def _met(at: DataFrame, sigs: DataFrame, close: float, related: float, apart: float) -> DataFrame | None:
    """Edges between members of nodes; None if no node is shared by several groups."""
    spark = at.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # one shuffle of all nodes; what comes out are those that several groups share
    rows = at.select("node", "rep", "root").repartition(parts, "node").sortWithinPartitions("node", "rep").mapInArrow(_shared, "node long, rep long, place long")
    rows = stored(rows.select("node", "rep", F.floor(F.col("place") / NODE).cast("int").alias("salt")), "shared-nodes")
    n = rows.count()
    if not n:
        return None
    # tables from here on are as large as these rows: so many tasks write them
    tasks = max(spark.sparkContext.defaultParallelism, ceil(n / TASK_ROWS))
    kept = lambda df, name: stored(df.coalesce(tasks), name)
    half = lambda salt: F.sum(F.xxhash64(F.lit(salt), "rep").bitwiseAND((1 << 40) - 1))
    nodes = rows.groupBy("node").agg(F.count(F.lit(1)).alias("members"), F.min("rep").alias("low"), half(1).alias("x"), half(2).alias("y"), (F.max("salt") + 1).alias("salts"))
    # of nodes with the same members, one
    nodes = kept(nodes.groupBy("members", "low", "x", "y", "salts").agg(F.min("node").alias("node")).select("node", "salts"), "nodes")
    met = kept(rows.join(nodes.select("node"), "node", "left_semi").join(sigs.select("rep", "sig"), "rep").select("node", "salt", "rep", "sig"), "met")
    first = met.repartition(parts, "node", "salt").sortWithinPartitions("node", "salt", "rep").mapInPandas(grouped(["node", "salt"], _led(close, related)), "node long, a long, b long")
    first = kept(first, "led")
    # the leaders of a split node meet in blocks, two at a time
    leaders = first.where("a = b").select("node", F.col("a").alias("rep")).join(nodes.where("salts > 1").select("node"), "node", "left_semi")
    split = kept(leaders.groupBy("node").agg(F.ceil(F.count(F.lit(1)) / NODE).cast("int").alias("blocks")), "split-nodes")
    edges = first.select("a", "b")
    if not split.head(1):
        return edges
    leaders = leaders.join(split, "node").withColumn("side", F.pmod(F.xxhash64(F.lit(3), "rep"), F.col("blocks")).cast("int"))
    leaders = leaders.join(sigs.select("rep", "sig"), "rep").select("node", "rep", "sig", "side", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    leaders = leaders.select("node", F.least("side", "other").alias("first"), F.greatest("side", "other").alias("second"), "rep", "sig")
    second = leaders.repartition(parts, "node", "first", "second").sortWithinPartitions("node", "first", "second", "rep").mapInPandas(grouped(["node", "first", "second"], _related(apart)), "a long, b long")
    return edges.unionByName(second)


#: Bits of the bitmap of wanted keys for each of them, and the most that it has in all (16 MB).
KEY_BITS, MOST_BITS = 16, 1 << 27
#: Bits of a row of a bitmap: what Spark's bitmap functions make.
ROW_BITS = 32768


def wanted(rows: DataFrame, keys: DataFrame, key: str = "k1") -> DataFrame:
    """``rows`` whose ``key`` (a hash) may be among ``keys``: a bitmap of hashed keys goes to all tasks, so that what no one wants isn't
    shuffled. It has MOST_BITS bits at most, whatever the number of keys; beyond that it lets more rows through, which the join
    that follows takes out."""
    bits = ROW_BITS
    while bits < min(KEY_BITS * keys.count(), MOST_BITS):
        bits *= 2
    place = lambda: F.pmod(F.xxhash64(F.lit(11), key), F.lit(bits)) + 1
    maps = keys.groupBy(F.bitmap_bucket_number(place()).alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place())).alias("__bits"))
    maps = F.broadcast(stored(maps, "wanted-keys"))  # bits / 8 bytes
    at = F.bitmap_bit_position(place())
    byte = F.conv(F.hex(F.substring("__bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    out = rows.withColumn("__bucket", F.bitmap_bucket_number(place())).join(maps, "__bucket")
    return out.where((F.call_function("shiftright", byte, (at % 8).cast("int")).bitwiseAND(1) == 1)).select(*rows.columns)


def _sets(of: Callable[[pa.Array], list[np.ndarray]]):
    """``text`` becomes ``shingles``. A rep that comes again (rows that repeat id and text) is left out; what a
    join hands to several tasks is dropped where the sets meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            reps = batch.column("rep").to_pylist()
            new = [not (r in seen or seen.add(r)) for r in reps]
            batch = batch.filter(pa.array(new, pa.bool_()))
            for part in runs(batch):
                names = [c for c in part.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(of(part.column("text")), pa.list_(pa.int64()))], [*names, "shingles"])

    return run


def shingle_sets(keyed: DataFrame, members: DataFrame, of: Callable[[pa.Array], list[np.ndarray]]) -> DataFrame:
    """``members`` (rep, k1, k2, others) with ``shingles``, the set that ``of`` makes of the text of ``keyed`` (k1, k2, text)."""
    names = [c for c in members.columns if c not in ("k1", "k2")]
    kinds = dict(members.dtypes)
    rows = wanted(keyed.select("k1", "k2", "text"), members).join(members, ["k1", "k2"]).select(*names, "text")
    return rows.mapInArrow(_sets(of), ", ".join(f"{c} {kinds[c]}" for c in names) + ", shingles array<long>")


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of some sets of numbers."""
    n = len(sets)
    sizes = np.fromiter(map(len, sets), np.int64, n)
    owner = np.repeat(np.arange(n), sizes)
    _, code, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[code] > 1  # what one set alone has meets nothing
    number = np.cumsum(times > 1) - 1
    code, owner = number[code[shared]], owner[shared]
    total = np.zeros((n, n), np.float32)
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    width = 4096
    for first in range(0, int(code[-1]) + 1 if len(code) else 0, width):
        lo, hi = np.searchsorted(code, [first, first + width])
        block = np.zeros((n, width), np.float32)
        block[owner[lo:hi], code[lo:hi] - first] = 1
        total += block @ block.T
    return total


def jaccard(sets: list[np.ndarray]) -> np.ndarray:
    """All similarities of some sets; 0 on the diagonal."""
    both = overlaps(sets).astype(np.float64)
    sizes = np.fromiter(map(len, sets), np.float64, len(sets))
    out = both / np.maximum(sizes[:, None] + sizes - both, 1)
    np.fill_diagonal(out, 0)
    return out


def roots(linked: np.ndarray) -> np.ndarray:
    """The first member of each one's component."""
    root = np.arange(len(linked))
    while True:
        new = np.minimum(root, np.where(linked, root, len(root)).min(1, initial=len(root)))
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _part(threshold: float, near: float):
    """Of a part of a group: each member's root by exact links, its leader and how far that is; sets of leaders if there are other parts."""

    def work(rows: pd.DataFrame) -> pd.DataFrame | None:
        rows = rows.drop_duplicates("rep", ignore_index=True)
        rep, several = rows["rep"].to_numpy(), rows["parts"].iloc[0] > 1
        same = jaccard(list(rows["shingles"]))
        root, leader = roots(same >= threshold - SLACK), np.full(len(rep), -1)
        for i in range(len(rep)) if several else ():
            if leader[i] < 0:
                leader[(leader < 0) & (same[i] >= near)] = i
                leader[i] = i
        leader = leader if several else np.arange(len(rep))
        far = np.where(leader == np.arange(len(rep)), 0, 1 - same[np.arange(len(rep)), leader])
        out = pd.DataFrame({"grp": rows["grp"], "rep": rep, "root": rep[root], "leader": rep[leader], "far": far, "several": several})
        out["shingles"] = [x if several and k == j else None for j, (k, x) in enumerate(zip(leader, rows["shingles"]))]
        return out

    return work


def _needs(threshold: float):
    """Of two blocks of leaders: how far a follower of each must be from it to be linked with a follower of one in another component, or
    with that leader itself. Leaders that are too far from all such, or have no followers to ask for, are left out."""

    def work(rows: pd.DataFrame) -> pd.DataFrame | None:
        rows = rows.drop_duplicates("rep", ignore_index=True)
        rep, root, reach = (rows[c].to_numpy() for c in ("rep", "root", "reach"))
        apart = 1 - jaccard(list(rows["shingles"]))
        close = (apart <= 1 - threshold + reach[:, None] + reach + SLACK) & (root[:, None] != root) & (reach[:, None] + reach > 0)
        need = np.where(close, apart - (1 - threshold) - reach, np.inf).min(1, initial=np.inf)
        some = np.isfinite(need)
        return pd.DataFrame({"leader": rep[some], "need": need[some]}) if some.any() else None

    return work


def _all_pairs(threshold: float):
    """Of two blocks of members: an edge from each to the first of those that links connect it with."""

    def work(rows: pd.DataFrame) -> pd.DataFrame | None:
        rows = rows.drop_duplicates("rep", ignore_index=True)
        rep, root = rows["rep"].to_numpy(), roots(jaccard(list(rows["shingles"])) >= threshold - SLACK)
        tied = np.flatnonzero(root != np.arange(len(root)))
        return pd.DataFrame({"a": rep[tied], "b": rep[root[tied]]}) if len(tied) else None

    return work


def _in_blocks(rows: DataFrame, part: int, what: str, salt: int) -> DataFrame:
    """Rows (grp, rep, shingles, others) of a group dealt into blocks of ``part`` members, each row once for each block that its own
    meets: the blocks' numbers are first and second."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = rows.groupBy("grp").agg(F.greatest(F.ceil(F.count(F.lit(1)) / part), F.ceil(F.sum(F.size("shingles")) / PART_VALUES)).cast("int").alias("blocks"))
    rows = rows.join(stored(blocks, what), "grp").withColumn("side", F.pmod(F.xxhash64(F.lit(salt), "rep"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumns({"first": F.least("side", "other"), "second": F.greatest("side", "other")}).drop("blocks", "side", "other")
    return rows.repartition(parts, "grp", "first", "second").sortWithinPartitions("grp", "first", "second", "rep")


def linked(members: DataFrame, sets_of: Callable[[DataFrame], DataFrame], threshold: float, part: int = PART) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of one group with a Jaccard similarity of ``threshold`` or more.

    ``members``: rep, grp, size (of the set), k1, k2; ``sets_of`` adds shingles to rows with rep, k1 and k2. A group of up to
    ``part`` members is compared in one task. Of a larger group each salted part is, and leaves leaders whose
    followers are closer than half of what ``threshold`` allows. Leaders meet in blocks. Where two of different components are
    so close that their followers may be linked, followers that are far enough from their leader meet in blocks too.
    The distance 1 - Jaccard is a metric, so no other pair can be a link between two trees."""
    spark = members.sparkSession
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    near = 1 - (1 - threshold) / 2
    sizes = members.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("values"))
    sizes = stored(sizes.select("grp", F.greatest(F.ceil(F.col("n") / part), F.ceil(F.col("values") / PART_VALUES)).cast("int").alias("parts")), "group-sizes")
    rows = members.select("rep", "grp", "k1", "k2").join(sizes, "grp").withColumn("part", F.pmod(F.xxhash64(F.lit(5), "rep"), F.col("parts")).cast("int"))
    sets = sets_of(rows).repartition(shuffles, "grp", "part").sortWithinPartitions("grp", "part", "rep")
    kind = "grp long, rep long, root long, leader long, far double, several boolean, shingles array<long>"
    led = stored(sets.select("grp", "part", "parts", "rep", "shingles").mapInPandas(grouped(["grp", "part"], _part(threshold, near)), kind), "led-groups")
    edges = led.select(F.col("rep").alias("a"), F.col("root").alias("b"))
    if not sizes.where("parts > 1").head(1):
        return edges

    reach = led.where("several").groupBy("leader").agg(F.max("far").alias("reach"))
    heads = led.where("shingles is not null").select("grp", "rep", "shingles").join(reach.withColumnRenamed("leader", "rep"), "rep")
    met = _in_blocks(heads, part, "leader-blocks", 6).mapInPandas(grouped(["grp", "first", "second"], _all_pairs(threshold)), "a long, b long")
    edges = edges.unionByName(stored(met, "met-leaders"))
    # groups that are several components still
    root = components(edges)
    heads = stored(heads.join(root.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep")), "leaders")
    apart = heads.groupBy("grp").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("grp")
    if not apart.head(1):
        return edges
    needs = _in_blocks(heads.join(apart, "grp", "left_semi"), part, "leader-blocks", 6).mapInPandas(grouped(["grp", "first", "second"], _needs(threshold)), "leader long, need double")
    need = stored(needs.groupBy("leader").agg(F.min("need").alias("need")), "needed")
    if not need.head(1):
        return edges
    followers = led.where("several").select("grp", "rep", "leader", "far").join(need, "leader").where(F.col("far") >= F.col("need") - SLACK).select("grp", "rep")
    followers = stored(followers.join(members.select("rep", "k1", "k2"), "rep"), "followers")
    found = _in_blocks(sets_of(followers), part, "follower-blocks", 8).mapInPandas(grouped(["grp", "first", "second"], _all_pairs(threshold)), "a long, b long")
    return edges.unionByName(stored(found, "linked-followers"))
