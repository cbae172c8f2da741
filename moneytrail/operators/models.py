"""Supervised scoring with boosted trees: training, batch scoring, explanation, validation."""

from __future__ import annotations

import itertools
import json
import math
from collections.abc import Sequence
from dataclasses import asdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize
from . import boosting, metrics
from .boosting import BoostedTrees
from .rules import EVIDENCE_SCHEMA, RESULT_SCHEMA, shaped, text_map

NODES = "tree int, node int, feature int, threshold double, left int, right int, value double, cover double, gain double"


def fit_classifier(rows: DataFrame, names: Sequence[str], **changes) -> BoostedTrees:
    """Boosted trees on the named feature columns and the 0/1 column ``label``."""
    found, _ = boosting.fit_folds(rows.select("label", *[c for c in rows.columns if c != "label"]), names, **changes)
    return found[boosting.ALL]


def score_accounts(model: BoostedTrees, matrix: DataFrame, cut: float = 0.5) -> DataFrame:
    """account_id, model_probability, predicted_label for every row of the matrix."""
    missing = [n for n in model.names if n not in matrix.columns]
    if missing:
        raise ValueError(f"missing feature columns: {missing}")
    scored = matrix.withColumn("model_probability", 1.0 / (1.0 + F.exp(-model.margin())))
    return scored.select(
        "account_id", "model_probability", (F.col("model_probability") >= cut).cast("int").alias("predicted_label")
    )


def save_model(model: BoostedTrees, path: str, **metadata) -> None:
    """The nodes as a table, and a JSON row with feature order, settings and any further facts."""
    tree_nodes(model).coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
    facts = {"feature_names": model.names, "edges": model.edges, "settings": asdict(model.settings), **metadata}
    SparkSession.active().createDataFrame([(json.dumps(facts, sort_keys=True),)], "value string").write.mode("overwrite").text(
        f"{path}/metadata"
    )


def load_model(path: str) -> tuple[BoostedTrees, dict]:
    spark = SparkSession.active()
    facts = json.loads(spark.read.text(f"{path}/metadata").first().value)
    settings = boosting.Settings(**facts.pop("settings"))
    model = BoostedTrees(facts["feature_names"], facts.pop("edges"), settings)
    model.trees = [boosting.Tree.empty(settings.depth) for _ in range(settings.trees)]
    for n in spark.read.parquet(f"{path}/nodes").collect():  # trees * 2^(depth + 1) rows at most
        tree = model.trees[n.tree]
        tree.feature[n.node], tree.value[n.node], tree.cover[n.node], tree.gain[n.node] = n.feature, n.value, n.cover, n.gain
        if n.feature >= 0:
            tree.split[n.node] = model.edges[n.feature].index(n.threshold)
    return model, facts


def tree_nodes(model: BoostedTrees) -> DataFrame:
    """The trees as rows: tree, node, feature (number), threshold, left, right, value, cover, gain."""
    return SparkSession.active().createDataFrame(model.node_rows(), NODES)


def score_by_nodes(nodes: DataFrame, matrix: DataFrame, names: Sequence[str], depth: int, trees: int) -> DataFrame:
    """The same probabilities from a stored node table, for models too large for one expression.

    One lookup join per tree level; the table has at most trees * 2^(depth + 1) rows, so it is broadcast.
    """
    small = F.broadcast(nodes.select("tree", F.col("node").alias("at"), "feature", "threshold", "left", "right", "value"))
    at = matrix.select(
        "account_id",
        F.array(*[F.col(n).cast("double") for n in names]).alias("x"),
        F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"),
        F.lit(0).alias("at"),
    )
    for _ in range(depth):
        step = at.join(small, ["tree", "at"])
        goes_left = F.coalesce(F.col("x")[F.greatest("feature", F.lit(0))], F.lit(float("-inf"))) <= F.col("threshold")
        child = F.when(F.col("left") < 0, F.col("at")).when(goes_left, F.col("left")).otherwise(F.col("right"))
        at = step.select("account_id", "x", "tree", child.alias("at"))
    margins = at.join(small, ["tree", "at"]).groupBy("account_id").agg(F.sum("value").alias("m"))
    return margins.select("account_id", (1.0 / (1.0 + F.exp(-F.col("m")))).alias("model_probability"))


# --- explanation ------------------------------------------------------------------------


def _leaf_paths(nodes: Sequence) -> list[tuple[float, dict[int, tuple[float, float, float]]]]:
    """Every leaf: its log-odds and, per feature on its path, (above, up to, share of the training rows)."""
    found = []
    by_tree: dict[int, dict] = {}
    for n in nodes:
        by_tree.setdefault(n.tree, {})[n.node] = n
    for tree in by_tree.values():
        pending = [(0, {})]
        while pending:
            at, path = pending.pop()
            n = tree[at]
            if n.left < 0:
                found.append((n.value, path))
                continue
            low, high, share = path.get(n.feature, (-math.inf, math.inf, 1.0))
            left, right = tree[n.left].cover / n.cover, tree[n.right].cover / n.cover
            pending.append((n.left, {**path, n.feature: (low, min(high, n.threshold), share * left)}))
            pending.append((n.right, {**path, n.feature: (max(low, n.threshold), high, share * right)}))
    return found


def _shapley_table(value: float, shares: Sequence[float]) -> np.ndarray:
    """Shapley values of one leaf by which of its features follow its path: bit i of the row number is feature i.

    A leaf has few features, so all their subsets are summed.
    """
    d = len(shares)
    follows = (np.arange(1 << d)[:, None] >> np.arange(d) & 1).astype(bool)
    phi = np.zeros((1 << d, d))
    for i in range(d):
        others = [j for j in range(d) if j != i]
        total = np.zeros(1 << d)
        for k in range(d):
            weight = math.factorial(k) * math.factorial(d - k - 1) / math.factorial(d)
            for known in itertools.combinations(others, k):
                term = np.full(1 << d, weight)
                for j in others:
                    term = term * (follows[:, j] if j in known else shares[j])
                total += term
        phi[:, i] = value * total * (follows[:, i] - shares[i])
    return phi


def _leaf_tables(leaves) -> list[tuple[list[tuple[int, float, float]], np.ndarray]]:
    """For each leaf the (feature, above, up to) of its path and its Shapley values."""
    return [([(f, *p[:2]) for f, p in path.items()], _shapley_table(v, [p[2] for p in path.values()])) for v, path in leaves]


def _contributions(x: np.ndarray, tables) -> np.ndarray:
    """Shapley values of the path-dependent expectation: every leaf looks them up by the features that follow its path."""
    columns = np.ascontiguousarray(x.T)
    phi = np.zeros(columns.shape)
    for path, table in tables:
        number = np.zeros(len(x), np.int64)
        for i, (f, above, up_to) in enumerate(path):
            number += ((columns[f] > above) & (columns[f] <= up_to)).astype(np.int64) << i
        for i, (f, *_) in enumerate(path):
            phi[f] += table[number, i]
    return phi.T


def expected_log_odds(nodes: DataFrame) -> float:
    """The log-odds when nothing is known about an account."""
    return float(sum(v * math.prod(p[2] for p in path.values()) for v, path in _leaf_paths(nodes.collect())))


def feature_contributions(nodes: DataFrame, matrix: DataFrame, names: Sequence[str]) -> DataFrame:
    """(account_id, feature, value, contribution, impact) in log-odds, for all accounts.

    The node table is bounded by the number and depth of the trees and travels with the tasks.
    """
    tables = _leaf_tables(_leaf_paths(nodes.collect()))

    @F.pandas_udf("array<double>")
    def contributions(x: pd.Series) -> pd.Series:
        values = np.array(x.tolist(), dtype=np.float64).reshape(len(x), len(names))
        return pd.Series(list(_contributions(values, tables)))

    x = F.array(*[F.col(n).cast("double") for n in names])
    labels = F.array(*[F.lit(n) for n in names])
    rows = matrix.select("account_id", x.alias("x")).withColumn("phi", contributions("x"))
    long = rows.select("account_id", F.explode(F.arrays_zip(labels.alias("feature"), F.col("x").alias("value"), F.col("phi").alias("contribution"))).alias("c"))
    long = long.select("account_id", "c.feature", "c.value", "c.contribution")
    c = F.col("contribution")
    return long.withColumn("impact", F.when(c > 0, "suspicious").when(c < 0, "legitimate").otherwise("neutral"))


def mean_absolute(long: DataFrame, column: str = "contribution") -> DataFrame:
    """Global importance: mean absolute contribution of every feature."""
    return long.groupBy("feature").agg(F.avg(F.abs(column)).alias("mean_absolute"))


# --- model findings as rule results -----------------------------------------------------


def model_results(
    scores: DataFrame,
    score: str,
    threshold,
    top: DataFrame,
    rule_id: str,
    rule_name: str,
    category: str,
    role: str,
) -> tuple[DataFrame, DataFrame]:
    """Scores and their top features in the shape of rule results and evidence.

    ``top`` holds account_id, feature, value, contribution, note and rank, a few rows per account.
    """
    cut = threshold if not isinstance(threshold, (int, float)) else F.lit(float(threshold))
    drivers = top.groupBy("account_id").agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("rank", "feature", "value", "note"))),
                lambda t: F.format_string("%s=%.2f (%s)", t["feature"], t["value"], t["note"]),
            ),
            "; ",
        ).alias("_drivers"),
        F.count(F.lit(1)).alias("_n"),
    )
    rows = scores.join(drivers, "account_id", "left").withColumn("_cut", cut)
    over = F.col(score) >= F.col("_cut")
    results = shaped(
        rows,
        RESULT_SCHEMA,
        rule_id=rule_id,
        rule_name=rule_name,
        detection_category=category,
        triggered=over,
        entity_type="Account",
        entity_id=F.col("account_id"),
        account_id=F.col("account_id"),
        result_key=F.col("account_id"),
        record_count=F.coalesce("_n", F.lit(0)),
        metrics=text_map(score=F.round(score, 4), threshold=F.round("_cut", 4)),
        thresholds=text_map(score=F.round("_cut", 4)),
        explanation=F.concat(
            F.lit(f"{rule_name}: score "), F.format_string("%.4f", score),
            F.when(over, " EXCEEDS").otherwise(" below"), F.lit(" threshold "), F.format_string("%.4f", "_cut"),
            F.lit(". Top features: "), F.coalesce("_drivers", F.lit("unspecified")), F.lit("."),
        ),
    )
    evidence = shaped(
        top,
        EVIDENCE_SCHEMA,
        rule_id=rule_id,
        result_key=F.col("account_id"),
        source_dataset="feature_matrix",
        record_type="AccountFeature",
        record_id=F.col("account_id"),
        role=role,
        details=text_map(feature=F.col("feature"), value=F.col("value"), contribution=F.col("contribution"), note=F.col("note")),
    )
    return results, evidence


# --- validation -------------------------------------------------------------------------


def leave_one_group_out(rows: DataFrame, names: Sequence[str], group: str, **changes) -> DataFrame:
    """Out-of-fold probabilities: every group is scored by a model that never saw it; all of them grow together."""
    _, scored = boosting.fit_folds(rows, names, group, whole=False, **changes)
    return scored.select("scenario_id", "account_id", "label", F.col(group).alias("fold"), "model_probability")


def quality_table(out_of_fold: DataFrame, cut: float = 0.5) -> DataFrame:
    """(measure, value, standard_error) of pooled out-of-fold probabilities."""
    ranked = metrics.ranking_table(out_of_fold, "label", "model_probability")
    ranking = metrics.ranking_quality(ranked)
    at_cut = metrics.cut_quality(out_of_fold, "label", "model_probability", cut)

    def long(df):
        pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).alias("value")) for c in df.columns]))
        return df.select(pairs.alias("p")).select("p.*")

    errors = metrics.jackknife(out_of_fold, "label", "model_probability", cut)
    return long(ranking).unionByName(long(at_cut)).join(errors, "measure", "left")


def fixed_holdout(rows: DataFrame, names: Sequence[str], held: Sequence[str], **changes) -> DataFrame:
    """Train without the named scenarios and score them."""
    rows = materialize(rows, "holdout")
    inside = F.col("scenario_id").isin(*held)
    model = fit_classifier(rows.filter(~inside), names, **changes)
    probability = 1.0 / (1.0 + F.exp(-model.margin()))
    return rows.filter(inside).select("scenario_id", "account_id", "label", probability.alias("model_probability"))


def compare_feature_sets(rows: DataFrame, feature_sets: dict[str, Sequence[str]], group: str, **changes) -> DataFrame:
    """The quality table for each named feature list; the models of all lists and folds grow together."""
    found = None
    for name, (_, scored) in boosting.fit_sets(rows, feature_sets, group, whole=False, **changes).items():
        table = materialize(quality_table(materialize(scored, "folds")).withColumn("feature_set", F.lit(name)), "quality")
        found = table if found is None else found.unionByName(table)
    return found
