"""Iterative graph searches.  Every round is written out, which cuts the lineage."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, release_scratch, scratch_path, scratch_tables
from . import mapped
from .skew import positions

# Accounts of a walk that its row carries; longer walks are stored in parts.
WALK_PART = 6
# Uniform walks read the links from a file that tasks map: from so many links (fewer are joined) to so many (four bytes each).
MAPPED_LINKS = (1_000, 1 << 28)
# Walks of one task, about.
TASK_WALKS = 100_000
# Numbers that a task of betweenness has in one array, about.
SPREAD = 1 << 22
# Betweenness holds about so many (source, account) rows at a time.
ROWS_IN_FLIGHT = 1_000_000_000


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


# --- accounts on short cycles -----------------------------------------------------------


def _hop(front: DataFrame, steps: DataFrame) -> DataFrame:
    """Distinct (source, node) one step further; ``steps`` holds (node, next)."""
    return front.join(steps, "node").select("source", F.col("next").alias("node")).distinct()


def _distances(start: DataFrame, steps: DataFrame, rounds: int) -> DataFrame:
    """(source, node, dist) for dist 1..rounds, breadth first."""
    front = start
    levels = []
    for dist in range(1, rounds + 1):
        front = _hop(front, steps)
        if levels:
            seen = _union([x.select("source", "node") for x in levels])
            front = front.join(seen, ["source", "node"], "left_anti")
        front = materialize(front, "level")
        levels.append(front.withColumn("dist", F.lit(dist)))
        if front.isEmpty():
            break
    return _union(levels)


def _closable(simple: DataFrame) -> DataFrame:
    """Edges that can lie on a cycle: both ends pay and are paid.  Goes on while a tenth falls away."""
    edges = materialize(simple.filter(F.col("src") != F.col("dst")).select("src", "dst"), "simple")
    left = edges.count()
    while True:
        paid, paying = edges.select(F.col("dst").alias("src")).distinct(), edges.select(F.col("src").alias("dst")).distinct()
        edges = materialize(edges.join(paid, "src", "left_semi").join(paying, "dst", "left_semi").select("src", "dst"), "simple")
        before, left = left, edges.count()
        if left >= 0.9 * before:
            return edges


def accounts_on_cycles(simple: DataFrame, max_length: int = 6, hub_pairs: float = 1e8) -> DataFrame:
    """Accounts on a simple cycle of length 2..max_length, without listing cycles.

    An account is on one exactly if it can return to itself in that many steps.  Accounts through
    which more than ``hub_pairs`` two-step paths run are hubs: cycles through them are found from
    the hubs' own distances (one search per hub), all others in the graph without hubs, where
    forward and backward frontiers of each open account meet halfway.
    """
    edges = _closable(simple)
    outs = edges.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("o"))
    ins = edges.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("i"))
    hubs = materialize(outs.join(ins, "node").filter(F.col("o") * F.col("i") > hub_pairs).select("node"), "hubs")
    found = []
    if not hubs.isEmpty():
        start = hubs.select(F.col("node").alias("source"), "node")
        ahead = _distances(start, edges.select(F.col("src").alias("node"), F.col("dst").alias("next")), max_length - 1)
        back = _distances(start, edges.select(F.col("dst").alias("node"), F.col("src").alias("next")), max_length - 1)
        both = ahead.join(back.withColumnRenamed("dist", "back"), ["source", "node"])
        both = both.filter((F.col("dist") + F.col("back") <= max_length) & (F.col("source") != F.col("node")))
        on_hub = both.select(F.explode(F.array("source", "node")).alias("account_id")).distinct()
        found.append(materialize(on_hub, "on_hub"))
        edges = edges.join(hubs.select(F.col("node").alias("src")), "src", "left_anti").join(
            hubs.select(F.col("node").alias("dst")), "dst", "left_anti"
        )
        edges = materialize(edges.select("src", "dst"), "simple")

    forward = edges.select(F.col("src").alias("node"), F.col("dst").alias("next"))
    backward = edges.select(F.col("dst").alias("node"), F.col("src").alias("next"))
    ahead = edges.select(F.col("src").alias("source"), F.col("dst").alias("node"))
    back = edges.select(F.col("dst").alias("source"), F.col("src").alias("node"))
    for done in found:
        ahead = ahead.join(done.select(F.col("account_id").alias("source")), "source", "left_anti")
        back = back.join(done.select(F.col("account_id").alias("source")), "source", "left_anti")
    for length in range(2, max_length + 1):
        met = ahead.join(back, ["source", "node"], "left_semi").select(F.col("source").alias("account_id")).distinct()
        met = materialize(met, "met")
        found.append(met)
        if length == max_length:
            break
        closed = met.select(F.col("account_id").alias("source"))
        ahead, back = ahead.join(closed, "source", "left_anti"), back.join(closed, "source", "left_anti")
        if length % 2 == 0:
            ahead = materialize(_hop(ahead, forward), "ahead")
            stuck = ahead.isEmpty()
        else:
            back = materialize(_hop(back, backward), "back")
            stuck = back.isEmpty()
        if stuck:
            break
    return _union(found).distinct()


def shortest_cycles(simple: DataFrame, accounts: DataFrame, max_length: int = 6) -> DataFrame:
    """The shortest cycle through each requested account, the first by node list among equals.

    Breadth first per account with one smallest path per (account, node): prefixes of the smallest
    shortest path are smallest shortest paths themselves, so nothing else has to be kept.
    """
    edges = _closable(simple)
    steps = edges.select(F.col("src").alias("node"), F.col("dst").alias("next"))
    closers = edges.select(F.col("src").alias("node"), F.col("dst").alias("source"))
    front = accounts.select(F.col("account_id").alias("source"), F.col("account_id").alias("node")).distinct()
    front = front.withColumn("path", F.array("node"))
    seen, cycles = [], []
    for length in range(2, max_length + 1):
        grown = front.join(steps, "node").groupBy("source", F.col("next").alias("node")).agg(
            F.min(F.concat("path", F.array("next"))).alias("path")
        )
        grown = grown.filter(F.col("source") != F.col("node"))
        if seen:
            grown = grown.join(_union(seen), ["source", "node"], "left_anti")
        grown = materialize(grown, "paths")
        closed = grown.join(closers, ["source", "node"], "left_semi").groupBy("source").agg(F.min("path").alias("path"))
        closed = materialize(closed, "closed")
        cycles.append(closed.withColumn("cycle_length", F.lit(length)))
        front = grown.join(closed, "source", "left_anti")
        seen.append(grown.select("source", "node"))
        if front.isEmpty():
            break
    return _union(cycles).select(F.col("source").alias("account_id"), "cycle_length", "path")


# --- betweenness ------------------------------------------------------------------------


def _dependencies(payers: DataFrame, steps: DataFrame) -> list[DataFrame]:
    """(node, share) per level: the shortest paths from ``payers`` through a node, by its weight in each."""
    levels = [payers.select("source", F.col("source").alias("node"), F.lit(1.0).alias("paths"))]
    while True:
        grown = levels[-1].join(steps, "node").groupBy("source", F.col("next").alias("node")).agg(
            F.sum("paths").alias("paths")
        )
        seen = _union([x.select("source", "node") for x in levels])
        grown = materialize(grown.join(seen, ["source", "node"], "left_anti"), "level")
        if grown.isEmpty():
            break
        levels.append(grown)

    shares = []
    deeper = levels[-1].withColumn("share", F.lit(0.0)) if len(levels) > 1 else None
    for level in reversed(levels[1:-1]):
        # Each account hands its share back along the edges that shortest paths use.  The edges are taken
        # from the level's own accounts: those into the deeper ones may come from anywhere.
        units = deeper.select("source", F.col("node").alias("next"), ((1.0 + F.col("share")) / F.col("paths")).alias("unit"))
        gained = level.join(steps, "node").join(units, ["source", "next"]).groupBy("source", "node").agg(
            F.sum(F.col("paths") * F.col("unit")).alias("share")
        )
        deeper = level.join(gained, ["source", "node"], "left").fillna(0.0)
        deeper = materialize(deeper, "shares")
        shares.append(deeper.select("node", "share"))
    return shares


def _spread(nodes: np.ndarray, begin: np.ndarray, near: np.ndarray):
    """(place in ``nodes``, neighbour) of all neighbours, at most about ``SPREAD`` at a time."""
    size = begin[nodes + 1] - begin[nodes]
    ends, first = np.cumsum(size), 0
    while first < len(nodes):
        before = ends[first] - size[first]
        last = max(first + 1, int(np.searchsorted(ends, before + SPREAD, side="right")))
        n = size[first:last]
        at = np.repeat(np.arange(first, last), n)
        yield at, near[np.arange(before, ends[last - 1]) + np.repeat(begin[nodes[first:last]] - (ends[first:last] - n), n)].astype(np.int64)
        first = last


def _added(keys: np.ndarray, values: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """The different keys, all below ``cells``, and the sum of the positive values of each."""
    if 8 * len(keys) < cells:
        keys, place = np.unique(keys, return_inverse=True)
        return keys, np.bincount(place, values, len(keys))
    sums = np.bincount(keys, values, cells)
    keys = np.flatnonzero(sums)
    return keys, sums[keys]


class _Shares:
    """The shares of ``_dependencies`` by number, for a few sources at a time, from arrays of neighbours.

    Only accounts that are paid have numbers; a source comes with the numbers of those that it pays.
    """

    def __init__(self, near: np.ndarray, begin: np.ndarray):
        self.near, self.begin, self.accounts = near, begin, len(begin) - 1
        self.sources = max(1, min(4096, SPREAD // max(1, self.accounts)))
        cells = self.sources * self.accounts
        self.level, self.unit, self.shares = np.full(cells, -1, np.int32), np.zeros(cells), np.zeros(self.accounts)

    def add(self, source: np.ndarray, own: np.ndarray, to: np.ndarray) -> None:
        """Sources numbered from 0, of number ``own`` (-1: none) each, and what they pay: (``source``, ``to``)."""
        cells = len(own) * self.accounts
        named = np.flatnonzero(own >= 0)
        start = named * self.accounts + own[named]
        self.level[start] = 0
        keys, paths = _added(source * self.accounts + to, np.ones(len(to)), cells)
        levels = []
        while len(keys):
            levels.append((keys, paths))
            self.level[keys] = len(levels)
            parts = []
            for at, far in _spread(keys % self.accounts, self.begin, self.near):
                far += keys[at] // self.accounts * self.accounts
                fresh = self.level[far] < 0
                parts.append(_added(far[fresh], paths[at[fresh]], cells))
            keys, paths = parts[0] if len(parts) == 1 else _added(*(np.concatenate(x) for x in zip(*parts)), cells)
        # Each account hands its share back along the edges that shortest paths use.
        for depth in range(len(levels), 0, -1):
            keys, paths = levels[depth - 1]
            share = np.zeros(len(keys))
            if depth < len(levels):
                for at, far in _spread(keys % self.accounts, self.begin, self.near):
                    far += keys[at] // self.accounts * self.accounts
                    deeper = self.level[far] == depth + 1
                    share += np.bincount(at[deeper], self.unit[far[deeper]], len(keys))
                share *= paths
                self.shares += np.bincount(keys % self.accounts, share, self.accounts)
            self.unit[keys] = (1.0 + share) / paths
        for keys, _ in levels:
            self.level[keys] = -1
        self.level[start] = -1


def _mapped_shares(pairs: DataFrame, payers: DataFrame) -> DataFrame:
    """(account_id, share) over all sources in ``payers``: a task takes some sources and all their paths, and reads
    the edges between paid accounts from files that it maps.  Accounts that only pay are on no path but their own."""
    spark = pairs.sparkSession
    named, count = mapped.share_names(pairs.select(F.col("dst").alias("account_id")).distinct(), [F.col("account_id")])
    # Edges of sources that are not paid lead nowhere from a paid account: they have no number, so they are left out.
    near_file, begin_file = mapped.share_links(pairs, named, count)

    def shared(batches):
        names = mapped.mapped_names(named)
        index = pd.Index(names.to_pandas(), dtype=object)
        state = _Shares(np.asarray(mapped.mapped_array(near_file)), np.asarray(mapped.mapped_array(begin_file)))
        last, held, seen = None, [], 0

        def flush(held, most):
            """Takes whole sources in portions; what belongs to source ``most`` or later is left."""
            source, own, to = (np.concatenate(x) for x in zip(*held))
            first = int(source[0])
            while first < most:
                upto = min(first + state.sources, most)
                a, b = np.searchsorted(source, [first, upto])
                numbers, at = np.unique(source[a:b], return_index=True)
                state.add(source[a:b] - first, own[a:b][at], to[a:b])
                first = upto
            a = np.searchsorted(source, most)
            return [(source[a:], own[a:], to[a:])] if a < len(source) else []

        for batch in batches:
            src = batch.column(0).to_pandas().to_numpy()
            if not len(src):
                continue
            new = np.concatenate([[src[0] != last], src[1:] != src[:-1]])
            source = seen - 1 + np.cumsum(new)
            seen, last = int(source[-1]) + 1, src[-1]
            held.append((source, mapped.numbers_of(index, batch.column(0)), mapped.numbers_of(index, batch.column(1)).astype(np.int64)))
            if seen - 1 - held[0][0][0] >= state.sources or sum(len(x[0]) for x in held) > SPREAD:
                held = flush(held, seen - 1)
        if held:
            flush(held, seen)
        some = np.flatnonzero(state.shares)
        yield pa.record_batch([names.take(pa.array(some)), pa.array(state.shares[some])], ["account_id", "share"])

    # More tasks than cores, as the sources of some take longer.
    tasks = 4 * spark.sparkContext.defaultParallelism
    mine = pairs.join(payers, "src", "left_semi").select("src", "dst")
    found = mine.repartition(tasks, "src").sortWithinPartitions("src").mapInArrow(shared, "account_id string, share double")
    return found.groupBy("account_id").agg(F.sum("share").alias("share"))


def betweenness(
    simple: DataFrame, accounts: DataFrame, sources: int | None = None, rows_in_flight: int = ROWS_IN_FLIGHT
) -> DataFrame:
    """Normalised betweenness of every account by per-source path counting.

    Exact with ``sources=None``: the work is accounts x edges.  With a number, that many sources
    are taken by hash and the sums scaled up, an estimate the caller asks for.

    Sources go in waves by hash, about ``rows_in_flight`` / accounts of them at a time, so the levels
    of a wave together hold about ``rows_in_flight`` rows at most.  Between waves only one sum per
    account is kept; the levels are deleted.  A wave has at least one source.

    Over ``MAPPED_LINKS`` edges a task follows all paths of some sources in memory instead, in arrays of ``SPREAD`` numbers.
    """
    spark = simple.sparkSession
    pairs = simple.filter(F.col("src") != F.col("dst")).select("src", "dst")
    if MAPPED_LINKS[0] <= pairs.count() <= MAPPED_LINKS[1]:
        nodes = materialize(accounts.select("account_id").distinct(), "nodes")
        total, scale = nodes.count(), 1.0
        payers = pairs.select("src").distinct()
        if sources is not None and sources < total:
            chosen = nodes.orderBy(F.xxhash64("account_id"), "account_id").limit(sources)
            payers, scale = payers.join(chosen.select(F.col("account_id").alias("src")), "src", "left_semi"), total / sources
        factor = scale / ((total - 1) * (total - 2)) if total > 2 else 1.0
        value = F.coalesce(F.col("share") * factor, F.lit(0.0))
        sums = materialize(_mapped_shares(pairs, payers), "sums")
        return nodes.join(sums, "account_id", "left").select("account_id", value.alias("betweenness_centrality"))
    # Levels hold numbers instead of names.
    ends = pairs.select(F.explode(F.array("src", "dst")).alias("account_id"), F.lit(False).alias("asked"))
    names = accounts.select("account_id", F.lit(True).alias("asked")).unionByName(ends)
    names = names.groupBy("account_id").agg(F.max("asked").alias("asked"))
    nodes = materialize(names.withColumn("node", F.monotonically_increasing_id()), "nodes")
    number = lambda end: nodes.select(F.col("account_id").alias(end), F.col("node").alias(f"{end}_node"))
    edges = pairs.join(number("src"), "src").join(number("dst"), "dst")
    edges = materialize(edges.select(F.col("src_node").alias("src"), F.col("dst_node").alias("dst")), "simple")
    nodes = nodes.filter("asked").drop("asked")
    total = nodes.count()
    payers = edges.select(F.col("src").alias("source")).distinct()
    scale = 1.0
    if sources is not None and sources < total:
        chosen = nodes.orderBy(F.xxhash64("account_id"), "account_id").limit(sources)
        payers = payers.join(chosen.select(F.col("node").alias("source")), "source", "left_semi")
        scale = total / sources
    payers = materialize(payers, "payers")
    steps = edges.select(F.col("src").alias("node"), F.col("dst").alias("next"))

    waves = -(-payers.count() // max(1, rows_in_flight // max(1, total)))
    sums, mark = None, scratch_tables()
    for wave in range(waves):
        mine = payers.filter(F.pmod(F.xxhash64("source"), F.lit(waves)) == wave)
        shares = _dependencies(mine, steps) + ([sums] if sums is not None else [])
        if shares:
            sums = materialize(_union(shares).groupBy("node").agg(F.sum("share").alias("share")), "sums")
        release_scratch(spark, mark, keep=1 if shares else 0)
    factor = scale / ((total - 1) * (total - 2)) if total > 2 else 1.0
    value = F.lit(0.0)
    if sums is not None:
        nodes = nodes.join(sums, "node", "left")
        value = F.coalesce(F.col("share") * factor, F.lit(0.0))
    return nodes.select("account_id", value.alias("betweenness_centrality"))


# --- connected components ---------------------------------------------------------------


def connected_components(vertices: DataFrame, edges: DataFrame, count: int | None = None) -> DataFrame:
    """(id, component): component is the smallest id that can be reached, ignoring direction.

    Every vertex hooks onto the smallest hash within two steps, hooked vertices are contracted, and
    the shrinking edge table goes into the next round.  A hub vanishes in the first round.  ``count``
    is how many edges there are, if that is known; ids then are numbers.
    """
    size = lambda: None if count is None else 64 * count  # of two rows for each edge
    most = size()
    left, right = F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")
    open_edges = edges.filter(F.col("src") != F.col("dst")).select(left, right).distinct()
    hooks = []
    while True:
        open_edges = materialize(open_edges, "open", size())
        if open_edges.isEmpty():
            break
        count = None if count is None else open_edges.count()
        src, dst = F.col("src"), F.col("dst")
        pairs = [(src, dst), (dst, src)]
        ends = open_edges.select(
            F.explode(F.array(*[F.struct(u.alias("u"), v.alias("v")) for u, v in pairs])).alias("e")
        ).select("e.u", "e.v")
        tag = lambda c: F.struct(F.xxhash64(F.lit(len(hooks)), F.col(c)).alias("h"), F.col(c).alias("v"))  # noqa: B023, E731
        # Stored, so that the join below reads two exchanges and a hub's rows can be split.
        near = ends.groupBy("u").agg(F.min(tag("v")).alias("t"))
        near = materialize(near.select("u", F.least("t", tag("u")).alias("t")), "near", size())
        far = ends.join(near.withColumnRenamed("u", "v"), "v").select("u", "t").unionByName(near)
        far = far.groupBy("u").agg(F.min("t").alias("t"))
        hook = materialize(far.select("u", F.col("t.v").alias("to")), "hooks", size())
        hooks.append(hook)
        moved = (
            open_edges.join(hook.select(F.col("u").alias("src"), F.col("to").alias("p")), "src")
            .join(hook.select(F.col("u").alias("dst"), F.col("to").alias("q")), "dst")
            .select(F.col("p").alias("src"), F.col("q").alias("dst"))
        )
        open_edges = moved.filter(src != dst).select(left, right).distinct()

    roots = None
    for hook in reversed(hooks):
        if roots is None:
            roots = hook
        else:
            later = roots.select(F.col("u").alias("to"), F.col("to").alias("_root"))
            roots = hook.join(later, "to", "left").select("u", F.coalesce("_root", "to").alias("to"))
    ids = vertices.select("id").distinct()
    if roots is None:
        return ids.select("id", F.col("id").alias("component"))
    roots = materialize(roots, "roots", most)
    labels = roots.groupBy("to").agg(F.min("u").alias("component"))
    named = roots.join(labels, "to").select(F.col("u").alias("id"), "component")
    return ids.join(named, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


# --- random walks -----------------------------------------------------------------------


def walk_choice(start, walk, step, degree, seed: int):
    """Which neighbour (from 0) a walk takes: a number that any engine can compute."""
    key = F.concat_ws(":", F.lit(str(seed)), start, walk.cast("string"), F.lit(str(step)))
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint") % degree


def random_walks(
    accounts: DataFrame, undirected: DataFrame, walks: int = 200, length: int = 30, seed: int = 42, p: float = 1.0, q: float = 1.0
) -> DataFrame:
    """(start, walk, path): ``walks`` walks of up to ``length`` accounts from every account.

    Uniform walks over up to ``MAPPED_LINKS`` links go on within one task: the neighbours of all accounts lie in a
    file that tasks map, so nothing is shuffled or stored for a step.

    Otherwise a step is one equi join on (account, neighbour number).  The number is spread by a hash, so the
    walks standing on a hub are spread too, and a row carries the degree of where it goes next.  Uniform
    walks carry their last few accounts only; the parts before are stored and put together at the end.

    With ``p`` or ``q`` other than 1 a step depends on the account before: going back weighs 1 / p,
    staying among its neighbours 1, going away from it 1 / q.  Such steps are drawn by rejection: a
    uniform neighbour is proposed, looked up among the neighbours of the account before, and taken with
    its weight over the largest one; walks that took none propose again.
    """
    if (p, q) == (1.0, 1.0) and MAPPED_LINKS[0] <= undirected.count() <= MAPPED_LINKS[1]:
        return _mapped_walks(accounts, undirected, walks, length, seed)
    numbered = positions(undirected.select("src", "dst"), ["src"], [F.col("dst")], "n")
    sizes = undirected.groupBy(F.col("src").alias("dst")).agg(F.count(F.lit(1)).alias("next_degree"))
    links = materialize(
        numbered.join(sizes, "dst").select(
            F.col("src").alias("node"), (F.col("n") - 1).alias("choice"), F.col("dst").alias("next"), "next_degree"
        ),
        "links",
    )
    degree = sizes.select(F.col("dst").alias("account_id"), F.col("next_degree").alias("degree"))
    state = accounts.select("account_id").distinct().join(degree, "account_id", "left").select(
        F.col("account_id").alias("start"),
        F.explode(F.sequence(F.lit(0), F.lit(walks - 1))).alias("walk"),
        F.col("account_id").alias("node"),
        F.coalesce("degree", F.lit(0)).alias("degree"),
        F.array("account_id").alias("path"),
    )
    parts = []
    for step in range(1, length):
        if step > 1 and (p, q) != (1.0, 1.0):
            state = _biased_step(materialize(state, "walks"), links, step, seed, p, q)
            continue
        keyed = state.withColumn(
            "choice", F.when(F.col("degree") > 0, walk_choice(F.col("start"), F.col("walk"), step, F.col("degree"), seed))
        )
        state = _moved(keyed.join(links, ["node", "choice"], "left"))
        if step % WALK_PART == 0 and step < length - 1 and (p, q) == (1.0, 1.0):
            state = materialize(state, "walks")
            parts.append(state.select("start", "walk", "path"))
            state = state.withColumn("path", F.slice("path", 1, 0))
    parts.append(state.select("start", "walk", "path"))
    if len(parts) == 1:
        return parts[0]
    every = _union([part.withColumn("part", F.lit(i)) for i, part in enumerate(parts)])
    whole = every.groupBy("start", "walk").agg(F.array_sort(F.collect_list(F.struct("part", "path"))).alias("parts"))
    return whole.select("start", "walk", F.flatten("parts.path").alias("path"))


def _mapped_walks(accounts: DataFrame, undirected: DataFrame, walks: int, length: int, seed: int) -> DataFrame:
    """Uniform walks, each from its first to its last step in one task."""
    ends = undirected.select(F.explode(F.array("src", "dst")).alias("account_id"))
    names = accounts.select("account_id").unionByName(ends).filter(F.col("account_id").isNotNull()).distinct()
    named, count = mapped.share_names(names, [F.col("account_id")])
    near_file, starts_file = mapped.share_links(undirected, named, count)

    def walked(batches):
        names = mapped.mapped_names(named)
        near, begin = mapped.mapped_array(near_file), mapped.mapped_array(starts_file)
        index = pd.Index(names.to_pandas(), dtype=object)
        for batch in batches:
            keys = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            keys = mapped.Texts([f"{seed}:{start}:{walk}:".encode() for start, walk in keys])
            path = np.full((batch.num_rows, length), -1, np.int64)
            path[:, 0] = mapped.numbers_of(index, batch.column(0))
            rows = np.flatnonzero(path[:, 0] >= 0)
            for step in range(1, length):
                # A walk ends at an account without neighbours, and before one that is no account of its own.
                at = path[rows, step - 1]
                first, size = begin[at], begin[at + 1] - begin[at]
                rows, first, size = rows[size > 0], first[size > 0], size[size > 0]
                to = near[first + keys.numbers(rows, str(step).encode()) % size].astype(np.int64)
                there = (to >= 0) & (begin[to + 1] > begin[to])
                rows, to = rows[there], to[there]
                path[rows, step] = to
            taken = path >= 0
            taken[:, 0] = True
            flat = path[taken]
            spots = names.take(pa.array(flat, mask=flat < 0))
            bounds = pa.array(np.concatenate([[0], np.cumsum(taken.sum(1))]).astype(np.int32))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.ListArray.from_arrays(bounds, spots)], ["start", "walk", "path"])

    # So many partitions, as the rows of the accounts tell nothing about the work.
    tasks = max(accounts.sparkSession.sparkContext.defaultParallelism, -(-count * walks // TASK_WALKS))
    start = accounts.select(F.col("account_id").alias("start")).distinct().repartition(tasks, "start")
    state = start.select("start", F.explode(F.sequence(F.lit(0), F.lit(walks - 1))).alias("walk"))
    return state.mapInArrow(walked, "start string, walk int, path array<string>")


def _moved(proposed: DataFrame) -> DataFrame:
    return proposed.select(
        "start",
        "walk",
        F.coalesce("next", "node").alias("node"),
        F.coalesce("next_degree", F.lit(0)).alias("degree"),
        F.when(F.col("next").isNotNull(), F.concat("path", F.array("next"))).otherwise(F.col("path")).alias("path"),
    )


def _biased_step(state: DataFrame, links: DataFrame, step: int, seed: int, p: float, q: float) -> DataFrame:
    """One step of all walks; the share that proposes again shrinks by the same factor in every round."""
    ways = links.select(F.col("node").alias("before"), F.col("next").alias("known")).withColumn("near", F.lit(True))
    going = state.filter(F.col("degree") > 0).withColumn("before", F.element_at("path", -2))
    done = [state.filter(F.col("degree") == 0)]
    most, tried = max(1 / p, 1.0, 1 / q), 0
    while not going.isEmpty():
        name = f"{step}.{tried}"
        drawn = going.withColumn("choice", walk_choice(F.col("start"), F.col("walk"), name, F.col("degree"), seed))
        met = drawn.join(links, ["node", "choice"]).withColumnRenamed("next", "known").join(ways, ["before", "known"], "left")
        weight = F.when(F.col("known") == F.col("before"), 1 / p).when(F.col("near"), 1.0).otherwise(1 / q)
        luck = walk_choice(F.col("start"), F.col("walk"), name + ".luck", F.lit(1 << 30), seed) / float(1 << 30)
        met = materialize(met.withColumn("taken", luck * most < weight), "proposed")
        done.append(_moved(met.filter("taken").withColumnRenamed("known", "next")))
        going = met.filter("NOT taken").select("start", "walk", "node", "degree", "path", "before")
        tried += 1
    return _union(done)


# --- skip-gram --------------------------------------------------------------------------

# Accounts of one block: a task holds the vectors of two blocks and the pairs between them.
BLOCK_ACCOUNTS = 1024
NEGATIVES = 5
# Accounts of either side that one step of training meets where blocks share many pairs.
TILE = 16
# Blocks whose pairs are fewer than this share of all possible ones, or than this number, are trained pair by pair.
DENSE_SHARE, FEW_PAIRS = 0.01, 1 << 15


def walk_pairs(walks: DataFrame, window: int = 10) -> DataFrame:
    """(account_id, other, n): how often two accounts lie within ``window`` steps of a walk.

    Walks are short, so the pairs of one walk are bounded by its length times the window.  A pair is
    counted from its earlier place on, as (smaller, larger) account, and then listed both ways.
    """
    spots = walks.select(F.posexplode("path").alias("i", "account_id"), "path")
    ahead = spots.select("account_id", F.explode(F.slice("path", F.col("i") + 2, F.lit(window))).alias("other"))
    ahead = ahead.filter(F.col("account_id") != F.col("other"))
    once = ahead.groupBy(F.least("account_id", "other").alias("a"), F.greatest("account_id", "other").alias("b")).agg(
        F.count(F.lit(1)).alias("n")
    )
    ends = [F.struct(F.col(x).alias("account_id"), F.col(y).alias("other")) for x, y in ("ab", "ba")]
    return once.select(F.explode(F.array(*ends)).alias("e"), "n").select("e.account_id", "e.other", "n")


def _summed(rows: np.ndarray, place: np.ndarray, size: int) -> np.ndarray:
    """Sums of the rows of every place; ``place`` is in ascending order."""
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    out = np.zeros((size, rows.shape[1]))
    out[place[first]] = np.add.reduceat(rows, first, axis=0)
    return out


def _packed(values: np.ndarray) -> bytes:
    """Numbers below 2^32: their lowest bytes first, then the next ones, compressed."""
    planes = values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
    return len(values).to_bytes(8, "little") + pa.compress(planes, "zstd", asbytes=True)


def _unpacked(data: bytes) -> np.ndarray:
    size = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(pa.decompress(data[8:], 4 * size, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, size).T).view("<u4")[:, 0].astype(np.int64)


def _block_pairs(walks: DataFrame, named: str, size: int, blocks: int, window: int) -> DataFrame:
    """(p, q, cells, n, total): the pairs of ``walk_pairs`` between blocks p <= q of numbered accounts, packed.

    A cell is the place of the first account in its block times ``size`` plus that of the second one.  Within one
    block the first has the smaller number.  A task packs the pairs of a batch of walks by blocks, in ascending
    order; the batches of two blocks are then added up one after another, so no pair is a row.
    """
    area = size * size

    def listed(batches):
        index = pd.Index(mapped.mapped_names(named).to_pandas(), dtype=object)
        for batch in batches:
            path = batch.column(0)
            walk = np.repeat(np.arange(batch.num_rows), path.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            place, keys = mapped.numbers_of(index, path.flatten()), []
            for ahead in range(1, window + 1):
                one, other = place[:-ahead], place[ahead:]
                good = (walk[:-ahead] == walk[ahead:]) & (one >= 0) & (other >= 0) & (one != other)
                low, high = np.minimum(one, other)[good].astype(np.int64), np.maximum(one, other)[good].astype(np.int64)
                keys.append((low // size * blocks + high // size) * area + low % size * size + high % size)
            keys = np.sort(np.concatenate(keys))
            pair = keys // area
            bounds = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1], [True]])) if len(keys) else [0]
            out = []
            for first, last in zip(bounds[:-1], bounds[1:]):
                out.append((*divmod(int(pair[first]), blocks), _packed(np.diff(keys[first:last] % area, prepend=0))))
            if out:
                yield pa.record_batch([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.binary()))], ["p", "q", "cells"])

    def rows(key, counts):
        cells = np.flatnonzero(counts)
        n = counts[cells]
        out = [[key[0]], [key[1]], [_packed(np.diff(cells, prepend=0))], [_packed(n)], [int(n.sum())], [len(n)], [key[1] - key[0]]]
        kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int32())
        return pa.record_batch([pa.array(x, t) for x, t in zip(out, kinds)], ["p", "q", "cells", "n", "total", "pairs", "gap"])

    def added(batches):
        key, counts = None, None
        for batch in batches:
            for p, q, data in zip(*(column.to_pylist() for column in batch.columns)):
                if key != (p, q):
                    if key is not None:
                        yield rows(key, counts)
                    key, counts = (p, q), np.zeros(area, np.int64)
                cells = np.cumsum(_unpacked(data))
                if len(cells) * 8 > area:
                    counts += np.bincount(cells, minlength=area)
                else:
                    np.add.at(counts, cells, 1)
        if key is not None:
            yield rows(key, counts)

    parts = walks.select("path").mapInArrow(listed, "p int, q int, cells binary")
    ordered = parts.repartition("p", "q").sortWithinPartitions("p", "q")
    schema = "p int, q int, cells binary, n binary, total bigint, pairs bigint, gap int"
    path = scratch_path(walks.sparkSession, "block-pairs")
    ordered.mapInArrow(added, schema).write.partitionBy("gap").parquet(path)
    return walks.sparkSession.read.schema(schema).parquet(path)


def _by_pairs(u, v, gu, gv, a, b, n, weight, rate, passes, rng, batch=2048):
    """Stochastic gradients pair by pair: positives by their counts, negatives drawn by frequency."""
    share = np.cumsum(weight)
    wanted = np.array([1.0] + [0.0] * NEGATIVES)
    for _ in range(passes):
        order = rng.permutation(len(a))
        for at in range(0, len(order), batch):
            now = order[at : at + batch]
            drawn = np.searchsorted(share, rng.random((len(now), NEGATIVES)) * share[-1], side="right")
            right = np.concatenate([b[now, None], np.minimum(drawn, len(v) - 1)], axis=1)
            mine, others = u[a[now]], v[right]
            score = np.clip(np.matmul(others, mine[:, :, None])[:, :, 0], -30, 30)
            step = n[now, None] * (wanted - 1 / (1 + np.exp(-score)))
            by_left, by_right = np.argsort(a[now], kind="stable"), np.argsort(right.ravel(), kind="stable")
            du = _summed(np.matmul(step[:, None, :], others)[by_left, 0], a[now][by_left], len(u))
            pulled = step.ravel()[by_right, None] * mine[by_right // (1 + NEGATIVES)]
            dv = _summed(pulled, right.ravel()[by_right], len(v))
            gu += du * du
            gv += dv * dv
            u += rate * du / np.sqrt(gu + 1e-8)
            v += rate * dv / np.sqrt(gv + 1e-8)


def _by_tiles(u, v, gu, gv, n, weight, rate, passes, rng):
    """The same gradients where most pairs occur, as matrix products: a step takes all pairs of ``TILE`` accounts
    with ``TILE`` others.  Instead of drawing negatives every account is one, with the weight that the draws of all
    pairs give it on average."""
    both = n + NEGATIVES * n.sum(1)[:, None] * (weight / weight.sum())
    across = range(0, len(v), TILE)
    for _ in range(passes):
        left, right = rng.permutation(len(u)), rng.permutation(len(v))
        x, y, gx, gy = u[left], v[right], gu[left], gv[right]
        wanted, all_of = n[np.ix_(left, right)], both[np.ix_(left, right)]
        for turn in range(len(across)):
            for i, a in enumerate(range(0, len(u), TILE)):
                b = across[(i + turn) % len(across)]
                mine, others, sums, other_sums = x[a : a + TILE], y[b : b + TILE], gx[a : a + TILE], gy[b : b + TILE]
                score = np.clip(mine @ others.T, -30, 30)
                step = wanted[a : a + TILE, b : b + TILE] - all_of[a : a + TILE, b : b + TILE] / (1 + np.exp(-score))
                du, dv = step @ others, step.T @ mine
                sums += du * du
                other_sums += dv * dv
                mine += rate * du / np.sqrt(sums + 1e-8)
                others += rate * dv / np.sqrt(other_sums + 1e-8)
        u[left], v[right], gu[left], gv[right] = x, y, gx, gy


def _trained(rate: float, passes: int, seeds: list[int], size: int, dimensions: int, mean: float):
    """Training of one inner block against one outer block; ``kind`` 2 holds their pairs, 3 those of the outer block first."""

    def run(key, rows):
        rows = rows.sort_values("kind")
        state = rows[rows.kind < 2].rename(columns={"kind": "side"})
        found = rows[rows.kind >= 2]
        if len(found) and len(state) == 2:
            (u, v), (gu, gv) = (
                [np.frombuffer(x).reshape(-1, dimensions).copy() for x in state[name]] for name in ("vectors", "gained")
            )
            weight = np.frombuffer(state.weight.iloc[1])
            cells, n = np.cumsum(_unpacked(found.vectors.iloc[0])), _unpacked(found.gained.iloc[0]) / mean
            a, b = cells // size, cells % size
            if found.kind.iloc[0] == 3:
                a, b = b, a
            if state.block.iloc[0] == state.block.iloc[1]:
                a, b, n = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([n, n])
            rng = np.random.default_rng([*seeds, int(key[0])])
            if len(a) < max(FEW_PAIRS, DENSE_SHARE * len(u) * len(v)):
                order = np.lexsort((b, a))
                _by_pairs(u, v, gu, gv, a[order], b[order], n[order], weight, rate, passes, rng)
            else:
                dense = np.zeros((len(u), len(v)))
                dense[a, b] = n
                _by_tiles(u, v, gu, gv, dense, weight, rate, passes, rng)
            state = state.assign(vectors=[u.tobytes(), v.tobytes()], gained=[gu.tobytes(), gv.tobytes()])
        return state[["side", "block", "vectors", "gained", "weight"]]

    return run


def skip_gram(
    walks: DataFrame, dimensions: int = 64, window: int = 10, epochs: int = 5, seed: int = 42, rate: float = 0.05, passes: int = 4
) -> DataFrame:
    """(account_id, vector) of every account on a walk, by skip-gram training with negative samples.

    Accounts are numbered by hash, or by name if they are one block, and dealt into blocks.  In each round a task has the inner vectors of one block,
    the outer vectors of another and the pairs between both, so no two tasks touch one vector; rounds rotate
    the outer blocks until every pair of blocks met, which is an epoch.  Vectors live in tables only, a row for the
    vectors of a block.  Pairs come counted, at most BLOCK_ACCOUNTS^2 in a task.  The same seed gives the same vectors.
    """
    spark = walks.sparkSession
    accounts = walks.select(F.explode("path").alias("account_id")).groupBy("account_id").agg(F.count(F.lit(1)).alias("n"))
    accounts = materialize(accounts, "walked")
    blocks = max(1, -(-accounts.count() // BLOCK_ACCOUNTS))
    hashed = [F.xxhash64(F.lit(seed), F.col("account_id"))] if blocks > 1 else []
    named, count = mapped.share_names(accounts.select("account_id"), [*hashed, F.col("account_id").asc_nulls_last()])
    size = max(1, -(-count // blocks))
    pairs = _block_pairs(walks, named, size, blocks, window)
    sums = pairs.agg(F.sum("total").alias("total"), F.sum("pairs").alias("pairs")).first()
    mean = sums.total / sums.pairs if sums.pairs else 1.0
    # Inner vectors start at hashed values of +-0.5 / dimensions, outer ones at zero.
    value = lambda d: (F.pmod(F.xxhash64(F.lit(seed), "account_id", d), F.lit(1 << 20)) / float(1 << 20) - 0.5) / dimensions
    start = F.transform(F.sequence(F.lit(1), F.lit(dimensions)), value)
    schema = "side int, block int, vectors binary, gained binary, weight binary"

    def numbered(batches):
        names = mapped.mapped_names(named)
        index, unnamed = pd.Index(names.to_pandas(), dtype=object), names.is_null().index(True).as_py()
        for batch in batches:
            number = mapped.numbers_of(index, batch.column(0))
            number = np.where(number < 0, unnamed, number)  # null
            yield pa.record_batch([pa.array(number // size, pa.int32()), pa.array(number, pa.int64()), *batch.columns[1:]], ["block", "number", "weight", "start"])

    def dealt(key, rows):
        rows = rows.sort_values("number")
        inner, weight = np.array(rows.start.tolist(), np.float64), rows.weight.to_numpy(np.float64).tobytes()
        zeros = np.zeros_like(inner).tobytes()
        sides = [(side, key[0], first, zeros, weight) for side, first in ((0, inner.tobytes()), (1, zeros))]
        return pd.DataFrame(sides, columns=["side", "block", "vectors", "gained", "weight"])

    begun = accounts.select("account_id", F.pow("n", F.lit(0.75)).alias("weight"), start.alias("start"))
    begun = begun.mapInArrow(numbered, "block int, number bigint, weight double, start array<double>")
    mark = scratch_tables()
    state = materialize(begun.groupBy("block").applyInPandas(dealt, schema), "vectors")
    for epoch in range(epochs):
        for turn in range(blocks):
            columns = ["block", "vectors", "gained", "weight"]
            meets = F.when(F.col("side") == 0, F.col("block")).otherwise(F.pmod(F.col("block") - turn, F.lit(blocks)))
            met = [state.select(meets.alias("key"), F.col("side").alias("kind"), *columns)]
            for kind, gap, key in ((2, turn, "p"), (3, blocks - turn, "q")):
                held = [F.lit(None).cast("int").alias("block"), F.col("cells").alias("vectors"), F.col("n").alias("gained")]
                held = [F.col(key).alias("key"), F.lit(kind).alias("kind"), *held, F.lit(None).cast("binary").alias("weight")]
                met.append(pairs.filter(F.col("gap") == gap).select(*held))
            # More partitions than blocks, as some blocks share one.
            met = _union(met).repartition(max(64, 2 * blocks), "key").groupBy("key")
            trained = met.applyInPandas(_trained(rate, passes, [seed, epoch, turn], size, dimensions, mean), schema)
            state = materialize(trained, "vectors")
            release_scratch(spark, mark, keep=1)

    def unpacked(batches):
        names = mapped.mapped_names(named)
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                vectors = np.frombuffer(data).astype(np.float32)
                bounds = np.arange(0, len(vectors) + 1, dimensions, dtype=np.int32)
                mine = names.slice(block * size, len(bounds) - 1)
                yield pa.record_batch([mine, pa.ListArray.from_arrays(bounds, pa.array(vectors))], ["account_id", "vector"])

    return state.filter("side = 0").select("block", "vectors").mapInArrow(unpacked, "account_id string, vector array<float>")


def embed_walks(walks: DataFrame, dimensions: int = 64, window: int = 10, seed: int = 42) -> DataFrame:
    """(account_id, vector): log co-occurrence counts within ``window`` steps, summed with hashed signs.

    A cheap stand-in for ``skip_gram`` that needs one pass over the walks.
    """
    counts = walk_pairs(walks, window)
    slot = F.xxhash64(F.lit(seed), F.col("other"))
    sign = F.when(F.pmod(F.shiftright(slot, 32), F.lit(2)) == 0, 1.0).otherwise(-1.0)
    parts = counts.groupBy("account_id", F.pmod(slot, F.lit(dimensions)).cast("int").alias("d")).agg(
        F.sum(F.log1p("n") * sign).alias("x")
    )
    filled = parts.groupBy("account_id").agg(F.map_from_entries(F.collect_list(F.struct("d", "x"))).alias("m"))
    values = F.transform(
        F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda d: F.coalesce(F.col("m")[d], F.lit(0.0)).cast("float")
    )
    projected = filled.select("account_id", values.alias("vector"))
    alone = walks.select(F.col("start").alias("account_id")).distinct().join(projected, "account_id", "left_anti")
    return projected.unionByName(
        alone.withColumn("vector", F.array_repeat(F.lit(0.0).cast("float"), dimensions))
    )
