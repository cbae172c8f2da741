"""Isolation forest: sampling and training as grouped jobs, scoring next to the data."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from . import metrics
from .skew import quantiles

NODES = "tree int, node int, feature int, threshold double, left int, right int, size bigint, depth int"


def tree_samples(matrix: DataFrame, trees: int = 200, size: int = 256, seed: int = 42) -> DataFrame:
    """The ``size`` rows of smallest hash for every tree.

    A row is offered to a tree only if its hash is small enough to have a fair chance, so nearly all
    rows are dropped before the shuffle; the rank limit does the rest.  Should a tree come up short,
    more rows are offered.
    """
    rows = matrix.count()
    h = F.xxhash64(F.lit(seed), F.col("tree"), F.col("account_id"))
    exploded = matrix.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).withColumn("_h", h)
    share = 8.0 * size / max(rows, 1)
    while share < 1.0:
        offered = materialize(exploded.filter(F.col("_h") < F.lit(int(-(2**63) + share * 2**64))), "offered")
        counts = [r.n for r in offered.groupBy("tree").agg(F.count(F.lit(1)).alias("n")).collect()]
        if len(counts) == trees and min(counts) >= size:
            break
        share *= 4
    else:
        offered = exploded
    rank = F.row_number().over(Window.partitionBy("tree").orderBy("_h", "account_id"))
    return offered.withColumn("_r", rank).filter(F.col("_r") <= size).drop("_h", "_r")


def _grow(tree: int, x: np.ndarray, seed: int) -> pd.DataFrame:
    """Random splits down to single rows, equal rows or the depth limit."""
    rng = np.random.default_rng([seed, tree])
    limit = max(1, math.ceil(math.log2(max(2, len(x)))))
    rows, pending = [], [(0, x, 0)]
    count = 1
    while pending:
        node, part, depth = pending.pop()
        low, high = part.min(axis=0), part.max(axis=0)
        usable = np.flatnonzero(high > low)
        if depth >= limit or len(part) <= 1 or not len(usable):
            rows.append((tree, node, -1, 0.0, -1, -1, len(part), depth))
            continue
        feature = int(rng.choice(usable))
        # Rounding may draw the upper end where both ends are neighbours: both sides must get rows.
        threshold = min(float(rng.uniform(low[feature], high[feature])), float(np.nextafter(high[feature], -np.inf)))
        goes_left = part[:, feature] <= threshold
        left, right = count, count + 1
        count += 2
        rows.append((tree, node, feature, threshold, left, right, len(part), depth))
        pending += [(left, part[goes_left], depth + 1), (right, part[~goes_left], depth + 1)]
    return pd.DataFrame(rows, columns=["tree", "node", "feature", "threshold", "left", "right", "size", "depth"])


def fit_forest(matrix: DataFrame, names: Sequence[str], trees: int = 200, size: int = 256, seed: int = 42) -> DataFrame:
    """The forest as a node table.  Each tree is grown from its own sample of at most ``size`` rows."""
    samples = tree_samples(matrix.select("account_id", *names), trees, size, seed)

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("account_id")
        return _grow(int(pdf["tree"].iloc[0]), pdf[list(names)].to_numpy(dtype=np.float64), seed)

    return materialize(samples.groupBy("tree").applyInPandas(grow, NODES), "forest")


def average_path(n):
    """Expected path length of an unsuccessful search among ``n`` rows."""
    n = np.asarray(n, dtype=np.float64)
    steps = 2.0 * (np.log(np.maximum(n - 1.0, 1.0)) + np.euler_gamma) - 2.0 * (n - 1.0) / np.maximum(n, 1.0)
    return np.where(n > 2, steps, np.where(n == 2, 1.0, 0.0))


class Forest:
    """The node table as arrays: trees * 2 * size entries at most, whatever the number of accounts."""

    def __init__(self, nodes: DataFrame):
        table = nodes.toPandas()
        shape = (int(table["tree"].max()) + 1, int(table["node"].max()) + 1)
        at = (table["tree"].to_numpy(), table["node"].to_numpy())
        self.feature, self.left, self.right = (np.full(shape, -1, dtype=np.int32) for _ in range(3))
        self.threshold, self.length = np.zeros(shape), np.zeros(shape)
        for name in ("feature", "left", "right", "threshold"):
            getattr(self, name)[at] = table[name].to_numpy()
        self.length[at] = table["depth"].to_numpy() + average_path(table["size"].to_numpy())
        self.levels = int(table["depth"].max())
        self.sample = int(table.loc[table["node"] == 0, "size"].max())

    def score(self, x: np.ndarray) -> np.ndarray:
        rows = np.arange(len(x))
        total = np.zeros(len(x))
        for tree in range(len(self.feature)):
            at = np.zeros(len(x), dtype=np.int32)
            for _ in range(self.levels):
                feature = self.feature[tree, at]
                goes_left = x[rows, np.maximum(feature, 0)] <= self.threshold[tree, at]
                step = np.where(goes_left, self.left[tree, at], self.right[tree, at])
                at = np.where(feature < 0, at, step)
            total += self.length[tree, at]
        return 2.0 ** (-(total / len(self.feature)) / max(float(average_path(self.sample)), 1e-12))


def isolation_scores(nodes: DataFrame, matrix: DataFrame, names: Sequence[str]) -> DataFrame:
    """(account_id, isolation_score): between 0 and 1, higher is more unusual."""
    forest, width = Forest(nodes), len(names)

    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        return pd.Series(forest.score(np.array(x.tolist(), dtype=np.float64).reshape(len(x), width)))

    x = F.array(*[F.col(n).cast("double") for n in names])
    return matrix.select("account_id", score(x).alias("isolation_score"))


def threshold(background_scores: DataFrame, contamination: float = 0.05) -> float:
    """The score that the given share of background accounts exceeds."""
    return quantiles(background_scores, "isolation_score", [1.0 - contamination]).first().q0


def attributions(nodes: DataFrame, matrix: DataFrame, names: Sequence[str], baselines: DataFrame) -> DataFrame:
    """How much each feature adds: the score less the score with the feature at its background median.

    (account_id, feature, value, median, score_delta, iqr_deviation, direction).  ``baselines`` has one
    row per feature.
    """
    forest, width = Forest(nodes), len(names)
    base = {r.feature: r for r in baselines.collect()}
    medians = np.array([base[n].median for n in names])

    @F.pandas_udf("array<double>")
    def deltas(x: pd.Series) -> pd.Series:
        values = np.array(x.tolist(), dtype=np.float64).reshape(len(x), width)
        score = forest.score(values)
        out = np.empty(values.shape)
        for i in range(width):
            changed = values.copy()
            changed[:, i] = medians[i]
            out[:, i] = score - forest.score(changed)
        return pd.Series(list(out))

    def constants(pick):
        return F.array(*[F.lit(pick(n)) for n in names])

    x = F.array(*[F.col(n).cast("double") for n in names])
    rows = matrix.select("account_id", x.alias("value")).withColumn("score_delta", deltas("value"))
    zipped = F.arrays_zip(
        constants(lambda n: n).alias("feature"), F.col("value"), F.col("score_delta"),
        constants(lambda n: float(base[n].median)).alias("median"), constants(lambda n: float(base[n].iqr)).alias("iqr"),
    )
    long = rows.select("account_id", F.explode(zipped).alias("z")).select("account_id", "z.*")
    gap = F.col("value") - F.col("median")
    return long.select(
        "account_id", "feature", "value", "median", "score_delta", (gap / F.col("iqr")).alias("iqr_deviation"),
        F.when(gap > 0, "elevated").when(gap < 0, "depressed").otherwise("normal").alias("direction"),
    )


def top_attributions(long: DataFrame, k: int = 4) -> DataFrame:
    """Largest score change first, ties by distance from the median."""
    order = [F.round("score_delta", 5).desc(), F.abs(F.round("iqr_deviation", 2)).desc(), F.col("feature")]
    return metrics.top_per_account(long, order, k)
