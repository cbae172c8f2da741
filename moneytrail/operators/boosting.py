"""Regularised boosted trees from histograms: every fold's trees grow in the same passes over the rows.

A level of a tree is one pass: tasks count gradients and hessians by (fold, node, feature, bin), the counts
are summed by key, and only the best split of each node and feature comes to the driver.  A fold trains on all rows but
those of its own group, so validation by groups needs no pass of its own.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from ..session import materialize

# The fold that trains on every row.
ALL = "*"
# Trees after which margins are stored; passes in between work out the newer trees again.
STORED_EVERY = 8
# Folds whose histograms a task holds at a time.
FOLDS_AT_ONCE = 16
ROWS_PER_TASK = 50_000
NO_GAIN = 1e-6


@dataclass(frozen=True)
class Settings:
    """Hyper-parameters."""

    trees: int = 40
    depth: int = 3
    rate: float = 0.08
    row_share: float = 0.8
    column_share: float = 0.8
    l1: float = 0.5
    l2: float = 1.0
    least_hessian: float = 1.0
    bins: int = 256
    seed: int = 42


@dataclass
class Tree:
    """Nodes by place: the children of node i are 2i + 1 and 2i + 2; leaves have feature -1."""

    feature: np.ndarray
    split: np.ndarray
    value: np.ndarray
    cover: np.ndarray
    gain: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> Tree:
        size = 2 ** (depth + 1) - 1
        return cls(np.full(size, -1), np.zeros(size, int), np.zeros(size), np.zeros(size), np.zeros(size))

    def renumbered(self, places: np.ndarray) -> Tree:
        """The same tree with features numbered by their place in ``places``."""
        number = {int(f): i for i, f in enumerate(places)}
        return replace(self, feature=np.array([number.get(int(f), -1) for f in self.feature]))

    def leaf_of(self, bins: np.ndarray) -> np.ndarray:
        """The node that rows of bin numbers stand on."""
        at, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        while True:
            feature = self.feature[at]
            inner = feature >= 0
            if not inner.any():
                return at
            right = bins[rows, np.maximum(feature, 0)] > self.split[at]
            at = np.where(inner, 2 * at + 1 + right, at)


@dataclass
class BoostedTrees:
    """A fitted model: feature names, bin edges of each, and the trees (at most trees * 2^(depth + 1) nodes)."""

    names: list[str]
    edges: list[list[float]]
    settings: Settings
    trees: list[Tree] = field(default_factory=list)

    def node_rows(self) -> list[tuple]:
        """(tree, node, feature, threshold, left, right, value, cover, gain); values are log-odds of leaves."""
        rows = []
        for number, tree in enumerate(self.trees):
            pending = [0]
            while pending:
                i = pending.pop()
                f = int(tree.feature[i])
                inner = f >= 0
                kids = (2 * i + 1, 2 * i + 2) if inner else (-1, -1)
                cut = float(self.edges[f][tree.split[i]]) if inner else 0.0
                rows.append((number, i, f, cut, *kids, float(tree.value[i]), float(tree.cover[i]), float(tree.gain[i])))
                pending += kids if inner else ()
        return rows

    def margin(self) -> Column:
        """Log-odds of a row as one expression: no Python runs where rows are scored."""
        low = F.lit(float("-inf"))
        values = [F.coalesce(F.col(f"`{n}`").cast("double"), low) for n in self.names]

        def node(tree: Tree, i: int) -> Column:
            f = int(tree.feature[i])
            if f < 0:
                return F.lit(float(tree.value[i]))
            cut = F.lit(float(self.edges[f][tree.split[i]]))
            return F.when(values[f] <= cut, node(tree, 2 * i + 1)).otherwise(node(tree, 2 * i + 2))

        total = F.lit(0.0)
        for tree in self.trees:
            total = total + node(tree, 0)
        return total


def shrunk(g, l1: float):
    """A sum of gradients after the L1 penalty."""
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0.0)


def leaf_value(g: float, h: float, settings: Settings) -> float:
    return float(-settings.rate * shrunk(g, settings.l1) / (h + settings.l2)) if h + settings.l2 > 0 else 0.0


def split_gains(g: np.ndarray, h: np.ndarray, settings: Settings) -> np.ndarray:
    """Gain of splitting after each bin (last axis); minus infinity where a side has too little hessian."""
    g_all, h_all = g.sum(axis=-1, keepdims=True), h.sum(axis=-1, keepdims=True)
    gl, hl = np.cumsum(g, axis=-1)[..., :-1], np.cumsum(h, axis=-1)[..., :-1]
    gr, hr = g_all - gl, h_all - hl
    part = lambda a, b: shrunk(a, settings.l1) ** 2 / (b + settings.l2)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = (part(gl, hl) + part(gr, hr) - part(g_all, h_all)) / 2
    return np.where((hl >= settings.least_hessian) & (hr >= settings.least_hessian), gain, -np.inf)


def sampled(hashes: np.ndarray, tree: int, share: float) -> np.ndarray:
    """Which rows a tree trains on: a function of the row's hash and the tree's number alone."""
    x = hashes.astype(np.uint64) + np.uint64((tree + 1) * 0x9E3779B97F4A7C15 % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))) >> np.uint64(11) < np.uint64(int(share * 2**53))


def columns_of(tree: int, count: int, settings: Settings) -> np.ndarray:
    kept = max(1, int(settings.column_share * count))
    return np.sort(np.random.default_rng([settings.seed, tree]).permutation(count)[:kept])


def bin_edges(rows: DataFrame, names: Sequence[str], bins: int) -> list[list[float]]:
    """At most ``bins`` - 1 cuts per feature, at quantiles of its values; the last value is no cut."""
    shares = [(i + 1) / bins for i in range(bins - 1)]
    value = lambda n: F.col(f"`{n}`").cast("double")
    found = rows.agg(
        *[F.percentile_approx(value(n), shares, 100_000).alias(f"q{i}") for i, n in enumerate(names)],
        *[F.max(value(n)).alias(f"m{i}") for i, n in enumerate(names)],
    ).first()
    return [sorted({v for v in found[f"q{i}"] or [] if v < found[f"m{i}"]}) for i in range(len(names))]


def _with(df: DataFrame, name: str) -> StructType:
    return StructType([*df.schema.fields, StructField(name, BinaryType())])


def _binned(rows: DataFrame, names: list[str], edges: list[list[float]], fold: Column, seed: int) -> DataFrame:
    """(row columns, _bins, _y, _fold, _hash, _margins): bin numbers as bytes, so a feature takes one byte."""
    kept = [c for c in rows.columns if c not in names and c != "label"]
    x = F.array(*[F.coalesce(F.col(f"`{n}`").cast("double"), F.lit(float("-inf"))) for n in names])
    plain = rows.select(
        F.struct(*kept).alias("_row"), x.alias("_x"), F.col("label").cast("double").alias("_y"), fold.alias("_fold"),
        F.xxhash64(F.lit(seed), *kept).alias("_hash"),
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            values = np.array(pdf["_x"].tolist(), np.float64).reshape(len(pdf), len(names))
            bins = np.stack([np.searchsorted(e, values[:, i], side="left") for i, e in enumerate(edges)], axis=1).astype(np.uint8)
            yield pdf.drop(columns="_x").assign(_bins=[b.tobytes() for b in bins])

    return plain.mapInPandas(run, _with(plain.drop("_x"), "_bins"))


def _fold_margins(pdf: pd.DataFrame, bins: np.ndarray, folds: int, newer: list[list[Tree]]) -> np.ndarray:
    """Log-odds of every row by every fold's model: what is stored and the trees since then."""
    if "_margins" in pdf:
        margins = np.frombuffer(b"".join(pdf["_margins"]), np.float64).reshape(len(pdf), folds).copy()
    else:
        margins = np.zeros((len(pdf), folds))
    for trees in newer:
        for k, tree in enumerate(trees):
            margins[:, k] += tree.value[tree.leaf_of(bins)]
    return margins


def _bins(pdf: pd.DataFrame, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(pdf["_bins"]), np.uint8).reshape(len(pdf), width)


def _histograms(part: range, folds: list, newer, growing: list[Tree], open_nodes, columns, number: int, width: int, settings: Settings):
    """(fold, node, feature, task, sums): gradient, hessian and row sums of each bin, as bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for pdf in batches:
            bins = _bins(pdf, width)
            margins = _fold_margins(pdf, bins, len(folds), newer)
            y, mine = pdf["_y"].to_numpy(), pdf["_fold"].to_numpy()
            taken = sampled(pdf["_hash"].to_numpy(), number, settings.row_share)
            for k in part:
                at = growing[k].leaf_of(bins)
                use = taken & (mine != folds[k])
                p = 1 / (1 + np.exp(-margins[:, k]))
                for node in open_nodes[k]:
                    rows = use & (at == node)
                    if not rows.any():
                        continue
                    total = sums.setdefault((k, node), np.zeros((len(columns[k]), 3, settings.bins)))
                    g, h = (p - y)[rows], (p * (1 - p))[rows]
                    # The bins of all features in one count: each feature has a range of its own.
                    place = (bins[rows][:, columns[k]] + np.arange(len(columns[k])) * settings.bins).ravel()
                    for j, w in enumerate((g, h, np.ones(len(g)))):
                        counted = np.bincount(place, np.repeat(w, len(columns[k])), minlength=len(columns[k]) * settings.bins)
                        total[:, j] += counted.reshape(len(columns[k]), settings.bins)
        task = TaskContext.get().partitionId()
        found = [(k, node, int(f), task, total[i].tobytes()) for (k, node), total in sums.items() for i, f in enumerate(columns[k])]
        yield pd.DataFrame(found, columns=["fold", "node", "feature", "task", "sums"])

    return run


_BEST = "fold int, node int, feature int, split int, gain double, g double, h double, n double, gl double, hl double, nl double"


def _best_splits(counted: DataFrame, settings: Settings) -> DataFrame:
    """The best split of every fold, node and feature; what the tasks counted is dealt out by these keys."""
    keys = ["fold", "node", "feature"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([*keys, "task"])  # added in the order of tasks: reruns give the same last digits
        sums = np.frombuffer(b"".join(pdf["sums"]), np.float64).reshape(len(pdf), 3, settings.bins)
        named = pdf[keys].to_numpy()
        first = np.flatnonzero(np.concatenate([[True], (named[1:] != named[:-1]).any(axis=1)]))
        total = np.add.reduceat(sums, first, axis=0)
        gains = split_gains(total[:, 0], total[:, 1], settings)
        at = gains.argmax(axis=1)
        rows = np.arange(len(at))
        left = np.cumsum(total, axis=2)[rows, :, at]
        found = pd.DataFrame(named[first], columns=keys).assign(split=at, gain=gains[rows, at])
        whole = total.sum(axis=2)
        return found.assign(**{c: whole[:, i] for i, c in enumerate("ghn")}, **{f"{c}l": left[:, i] for i, c in enumerate("ghn")})

    parts = int(counted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = counted.groupBy(F.pmod(F.xxhash64(*keys), F.lit(parts)))
    return dealt.applyInPandas(run, _BEST)


def fit_sets(rows: DataFrame, sets: dict[str, Sequence[str]], group: str | None = None, whole: bool = True, **changes) -> dict:
    """``(models by fold, scored)`` for each named list of features, all grown in the same passes.

    See ``fit_folds``; a model sees the features of its own list only.
    """
    settings = replace(Settings(), **changes)
    names = list(dict.fromkeys(n for own in sets.values() for n in own))
    values: list = [ALL] if whole or group is None else []
    held: list[int] = [-1] * len(values)
    if group is not None:
        # One model for each: they are the result, and as few.
        found = sorted((r[0] for r in rows.select(group).distinct().collect()), key=lambda v: (v is None, str(v)))
        values, held = values + found, held + list(range(len(found)))
    number = F.lit(-2)
    for k, v in zip(held, values, strict=True):
        if k >= 0:
            number = F.when(F.col(group).eqNullSafe(F.lit(v)), k).otherwise(number)
    edges = bin_edges(rows, names, settings.bins)
    state = materialize(_binned(rows, names, edges, number, settings.seed), "binned")
    # Few rows need few tasks: each of the many passes starts them all.
    state = state.coalesce(max(1, state.count() // ROWS_PER_TASK))
    models = [BoostedTrees(list(own), [edges[names.index(n)] for n in own], settings) for own in sets.values() for _ in values]
    places = [np.array([names.index(n) for n in own]) for own in sets.values() for _ in values]
    folds = held * len(sets)
    newer: list[list[Tree]] = []
    for t in range(settings.trees):
        columns = [np.sort(p[columns_of(t, len(p), settings)]) for p in places]
        growing = _grown(state, folds, newer, t, columns, len(names), settings)
        for model, place, tree in zip(models, places, growing, strict=True):
            model.trees.append(tree.renumbered(place))
        newer.append(growing)
        if len(newer) == STORED_EVERY or t == settings.trees - 1:
            state, newer = _stored(state, folds, newer, len(names)), []

    def margin(first: int) -> Column:
        def own(fold: pd.Series, margins: pd.Series) -> pd.Series:
            table = np.frombuffer(b"".join(margins), np.float64).reshape(len(margins), len(folds))
            offset = len(values) - len([k for k in held if k >= 0])
            return pd.Series(table[np.arange(len(margins)), first + np.where(fold >= 0, fold + offset, 0)])

        return F.pandas_udf(own, "double")("_fold", "_margins") if settings.trees else F.lit(0.0)

    result = {}
    for i, name in enumerate(sets):
        first = i * len(values)
        probability = (1 / (1 + F.exp(-margin(first)))).alias("model_probability")
        scored = state.select("_row.*", F.col("_y").cast("int").alias("label"), probability)
        result[name] = dict(zip(values, models[first : first + len(values)], strict=True)), scored
    return result


def fit_folds(rows: DataFrame, names: Sequence[str], group: str | None = None, whole: bool = True, **changes):
    """``(models by fold, scored)``: models without each group's rows, and, as fold ``ALL``, on all rows.

    ``rows`` has the feature columns and the 0/1 column ``label``.  ``scored`` has its other columns, the
    label and ``model_probability``: of the model that did not see the row, or of the one on all rows if
    there is no ``group``.  Null features count as lower than all values; a null group is a group.
    """
    return fit_sets(rows, {"": names}, group, whole, **changes)[""]


def _grown(state: DataFrame, folds: list, newer, number: int, columns: list, width: int, settings: Settings) -> list[Tree]:
    """The next tree of every fold."""
    growing = [Tree.empty(settings.depth) for _ in folds]
    totals: list[dict[int, tuple[float, float, float]]] = [{} for _ in folds]
    open_nodes: list[list[int]] = [[0] for _ in folds]
    for _ in range(settings.depth):
        found = []
        for first in range(0, len(folds), FOLDS_AT_ONCE):
            part = range(first, min(first + FOLDS_AT_ONCE, len(folds)))
            if any(open_nodes[k] for k in part):
                counted = state.mapInPandas(
                    _histograms(part, folds, newer, growing, open_nodes, columns, number, width, settings),
                    "fold int, node int, feature int, task int, sums binary",
                )
                found += _best_splits(counted, settings).collect()  # a row per open node and feature, whatever the rows
        open_nodes = [[] for _ in folds]
        leading: dict[tuple[int, int], Row] = {}
        for b in sorted(found, key=lambda b: (-b.gain, b.feature)):
            leading.setdefault((b.fold, b.node), b)
        for _, b in sorted(leading.items()):
            tree, total = growing[b.fold], totals[b.fold]
            total.setdefault(b.node, (b.g, b.h, b.n))
            if b.gain > NO_GAIN:
                tree.feature[b.node], tree.split[b.node], tree.gain[b.node] = b.feature, b.split, b.gain
                total[2 * b.node + 1] = (b.gl, b.hl, b.nl)
                total[2 * b.node + 2] = (b.g - b.gl, b.h - b.hl, b.n - b.nl)
                open_nodes[b.fold] += [2 * b.node + 1, 2 * b.node + 2]
    for tree, total in zip(growing, totals, strict=True):
        for node, (g, h, n) in total.items():
            tree.value[node], tree.cover[node] = leaf_value(g, h, settings), n
    return growing


def _stored(state: DataFrame, folds: list, newer, width: int) -> DataFrame:
    count = len(folds)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            margins = _fold_margins(pdf, _bins(pdf, width), count, newer)
            yield pdf.assign(_margins=[m.tobytes() for m in margins])

    return materialize(state.mapInPandas(run, _with(state.drop("_margins"), "_margins")), "margins")


def root_splits(rows: DataFrame, names: Sequence[str], **changes) -> DataFrame:
    """(feature, threshold, gain): the best first split of every feature, on all rows and columns."""
    settings = replace(Settings(), row_share=1.0, column_share=1.0, **changes)
    names = list(names)
    edges = bin_edges(rows, names, settings.bins)
    state = _binned(rows, names, edges, F.lit(-2), settings.seed)
    grow = _histograms(range(1), [-1], [], [Tree.empty(1)], [[0]], [np.arange(len(names))], 0, len(names), settings)
    best = _best_splits(state.mapInPandas(grow, "fold int, node int, feature int, task int, sums binary"), settings)
    label = F.array(*[F.lit(n) for n in names])[F.col("feature")]
    cuts = F.array(*[F.array(*[F.lit(float(v)) for v in e]).cast("array<double>") for e in edges])
    usable = best.filter(F.col("gain") > F.lit(float("-inf")))
    return usable.select(label.alias("feature"), cuts[F.col("feature")][F.col("split")].alias("threshold"), "gain")
