"""Queries over supervised and unsupervised account models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import boosting, density, features, graph_search, isolation, metrics, models
from ..operators.graph import undirected_edges
from ..session import materialize, scratch_path
from . import feature_queries
from .feature_queries import ACCOUNT_RELATIONS, ACCOUNTS, FEATURE_RELATIONS, FEATURES, matrix, rounded
from .graph_queries import account_nodes, sent
from .oracle import sql
from .quality_queries import _LONG, BASELINE_FEATURES
from .rule_queries import rule_results

NAMES = features.SIGNAL_FEATURES
TREES, DEPTH, FOREST = boosting.Settings.trees, boosting.Settings.depth, 200


def stored_matrix(s):
    return materialize(matrix(s), "matrix")


def training_rows(s, full, names=NAMES):
    """Scenario rows with their label, written once: training reads them many times."""
    return materialize(features.labeled_rows(full, s.scenarios(), names), "training")


_fitted: dict[tuple[str, str], tuple] = {}


def fitted(s):
    """The classifier on all scenarios and the stored matrix: one fit for all queries of a session and folder."""
    key = (s.spark.sparkContext.applicationId, s.folder)
    if key not in _fitted:
        full = stored_matrix(s)
        _fitted[key] = models.fit_classifier(training_rows(s, full), NAMES), full
    return _fitted[key]


def classifier_scores(s):
    model, full = fitted(s)
    return models.score_accounts(model, full)


def tree_row_scores(s):
    model, full = fitted(s)
    rows = models.score_by_nodes(models.tree_nodes(model), full, NAMES, DEPTH, TREES)
    both = rows.join(models.score_accounts(model, full).withColumnRenamed("model_probability", "p"), "account_id")
    return both.select("account_id", (F.abs(F.col("p") - F.col("model_probability")) < 1e-9).alias("same"))


def contributions(s):
    model, full = fitted(s)
    return models.feature_contributions(models.tree_nodes(model), full, NAMES)


def top_contributions(s):
    long = contributions(s)
    return metrics.top_per_account(long, [F.abs("contribution").desc(), F.col("feature")], 5)


def contribution_sums(s):
    """Do the contributions and the expectation add up to the model's log-odds?"""
    model, full = fitted(s)
    nodes = models.tree_nodes(model)
    base = models.expected_log_odds(nodes)
    sums = models.feature_contributions(nodes, full, NAMES).groupBy("account_id").agg(F.sum("contribution").alias("c"))
    p = F.col("model_probability")
    odds = models.score_accounts(model, full).withColumn("odds", F.log(p / (1 - p)))
    return sums.join(odds, "account_id").select("account_id", (F.abs(F.col("c") + base - F.col("odds")) < 1e-6).alias("adds_up"))


def feature_importance(s):
    return models.mean_absolute(contributions(s))


def mean_absolute_deviation(s):
    stored = materialize(matrix(s).select("account_id", *BASELINE_FEATURES), "matrix")
    return rounded(models.mean_absolute(metrics.long_features(stored, BASELINE_FEATURES), "value"))


def model_reload(s):
    model, full = fitted(s)
    path = scratch_path(s.spark, "model")
    codes = features.country_codes(s.customers()).count()
    models.save_model(model, path, countries=codes, excluded=["is_laundering", "scenario_type"])
    again, facts = models.load_model(path)
    before = models.score_accounts(model, full).withColumnRenamed("model_probability", "p")
    after = models.score_accounts(again, full).drop("predicted_label").withColumnRenamed("model_probability", "q")
    return before.join(after, "account_id").select(
        "account_id", (F.abs(F.col("p") - F.col("q")) <= 1e-6).alias("same"),
        F.lit(len(facts["feature_names"])).alias("features"),
    )


def group_validation(s):
    rows = training_rows(s, stored_matrix(s))
    return models.leave_one_group_out(rows, NAMES, "employee_id")


def validation_quality(s):
    return models.quality_table(materialize(group_validation(s), "folds"))


def fixed_holdout(s):
    rows = training_rows(s, stored_matrix(s))
    return models.fixed_holdout(rows, NAMES, ["S0", "S1"])


def feature_set_comparison(s):
    """The 41 features without rule flags, the 44 with them, and the ten signals."""
    results, _ = rule_results(s)
    full = materialize(matrix(s, results), "matrix")
    every = [c for c in full.columns if c != "account_id"]
    rows = training_rows(s, full, every)
    plain = [c for c in every if c not in features.FEATURE_GROUPS["rules"]]
    sets = {"41 features": plain, "44 features": every, "10 signals": list(NAMES)}
    return models.compare_feature_sets(rows, sets, "employee_id")


def root_splits(s):
    """The best first split of each signal feature, with its gain under both penalties."""
    return rounded(boosting.root_splits(rounded(training_rows(s, stored_matrix(s))), NAMES))


def forest(s):
    full = stored_matrix(s)
    suspicious = s.scenarios().filter(F.col("scenario_type") == "suspicious")
    background, _ = features.split_background(full, suspicious)
    background = materialize(background, "background")
    names = [c for c in full.columns if c != "account_id" and c not in features.FEATURE_GROUPS["customer"]]
    return isolation.fit_forest(background, names, FOREST), background, full, names


def forest_nodes(s):
    return forest(s)[0]


def isolation_scores(s):
    nodes, background, full, names = forest(s)
    cut = isolation.threshold(isolation.isolation_scores(nodes, background, names))
    scores = isolation.isolation_scores(nodes, full, names)
    return scores.withColumn("is_isolation_flagged", F.col("isolation_score") >= cut)


def isolation_attributions(s):
    nodes, background, full, names = forest(s)
    baselines = metrics.feature_baselines(background, names)
    return isolation.top_attributions(isolation.attributions(nodes, full, names, baselines))


def model_results(s):
    model, full = fitted(s)
    long = models.feature_contributions(models.tree_nodes(model), full, NAMES)
    top = metrics.top_per_account(long, [F.abs("contribution").desc(), F.col("feature")], 4)
    top = top.withColumn("note", F.concat(F.format_string("SHAP %+.3f, pushes ", "contribution"), "impact"))
    first, first_proof = models.model_results(
        models.score_accounts(model, full), "model_probability", 0.5, top, "ML.XGBOOST",
        "Supervised AML classifier", "ML_SUPERVISED", "ml_discriminator",
    )
    nodes, background, full, names = forest(s)
    cut = isolation.threshold(isolation.isolation_scores(nodes, background, names))
    own = isolation.top_attributions(isolation.attributions(nodes, full, names, metrics.feature_baselines(background, names)))
    own = own.withColumns({"contribution": F.col("score_delta"), "note": F.col("direction")})
    second, second_proof = models.model_results(
        isolation.isolation_scores(nodes, full, names), "isolation_score", cut, own, "ML.ISOLATION_FOREST",
        "Isolation forest anomaly detection", "ML_ANOMALY", "anomaly_contributor",
    )
    counted = first_proof.unionByName(second_proof).groupBy("rule_id", "result_key").agg(F.count(F.lit(1)).alias("evidence"))
    return first.unionByName(second).join(counted, ["rule_id", "result_key"], "left").select(
        "rule_id", "account_id", "triggered", "record_count", "evidence", "explanation"
    )


def account_embeddings(s):
    links = materialize(undirected_edges(sent(s)), "links")
    return graph_search.skip_gram(materialize(graph_search.random_walks(account_nodes(s), links), "walks"))


def embedding_clusters(s):
    points = account_embeddings(s).select(F.col("account_id").alias("id"), "vector")
    return density.cluster_table(density.dbscan(points, [1.5]))


def _every_account(columns):
    """Checks that must hold for every account."""
    return sql(f"SELECT account_id, {columns} FROM accounts", *ACCOUNT_RELATIONS, **ACCOUNTS)


_ROWS = feature_queries.QUERIES["labeled_dataset"][1]
_SIGNALS = ", ".join(NAMES)
# All rows start at probability 0.5: gradient 0.5 - label, hessian 0.25; L1 0.5, L2 1, least hessian 1.
ROOT_SPLITS = f"""
WITH long AS (SELECT label, feature, value FROM ({_ROWS}) UNPIVOT (value FOR feature IN ({_SIGNALS}))),
e AS (SELECT DISTINCT feature, unnest(q) AS edge, top FROM (SELECT feature, max(value) AS top, quantile_disc(value,
    [{", ".join(f"{i + 1}/256.0::DOUBLE" for i in range(255))}]) AS q FROM long GROUP BY feature)),
s AS (SELECT feature, edge, sum(0.5 - label) FILTER (value <= edge) AS gl, 0.25 * count(*) FILTER (value <= edge) AS hl,
    sum(0.5 - label) AS g, 0.25 * count(*) AS h FROM long JOIN e USING (feature) WHERE edge < top GROUP BY feature, edge),
k AS (SELECT feature, edge, (greatest(abs(gl) - 0.5, 0) ** 2 / (hl + 1) + greatest(abs(g - gl) - 0.5, 0) ** 2 / (h - hl + 1)
    - greatest(abs(g) - 0.5, 0) ** 2 / (h + 1)) / 2 AS gain FROM s WHERE hl >= 1 AND h - hl >= 1)
SELECT feature, round(edge + 1e-9, 6) AS threshold, round(gain + 1e-9, 6) AS gain FROM k
QUALIFY row_number() OVER (PARTITION BY feature ORDER BY round(gain, 9) DESC, edge) = 1
"""

QUERIES = {
    "classifier_scores": (classifier_scores, None),
    "tree_row_scores": (tree_row_scores, _every_account("true AS same")),
    "feature_contributions": (contributions, None),
    "top_contributions": (top_contributions, None),
    "contribution_sums": (contribution_sums, _every_account("true AS adds_up")),
    "feature_importance": (feature_importance, None),
    "mean_absolute_deviation": (
        mean_absolute_deviation,
        sql(
            f"SELECT feature, round(avg(abs(value)) + 1e-9, 6) AS mean_absolute FROM ({_LONG}) GROUP BY 1",
            *FEATURE_RELATIONS, **FEATURES,
        ),
    ),
    "model_reload": (model_reload, _every_account("true AS same, 10 AS features")),
    "group_validation": (group_validation, None),
    "validation_quality": (validation_quality, None),
    "fixed_holdout": (fixed_holdout, None),
    "feature_set_comparison": (feature_set_comparison, None),
    "root_splits": (root_splits, ROOT_SPLITS),
    "forest_nodes": (forest_nodes, None),
    "isolation_scores": (isolation_scores, None),
    "isolation_attributions": (isolation_attributions, None),
    "model_results": (model_results, None),
    "account_embeddings": (account_embeddings, None),
    "embedding_clusters": (embedding_clusters, None),
}
