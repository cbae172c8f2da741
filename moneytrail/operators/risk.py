"""Graph score, fused risk, tiers, alerts and cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import split_ids
from .skew import quantiles

# Tiers in rising order, their lower bounds, and the fusion weights.
TIERS = ("Low", "Medium", "High", "Critical")
CALIBRATED_BOUNDS = (0.30, 0.55, 0.75)
BASELINE_BOUNDS = (0.30, 0.55, 0.80)
CALIBRATED_WEIGHTS = {"rule_score": 0.16, "model_probability": 0.50, "isolation_score": 0.14, "graph_anomaly_score": 0.20}
BASELINE_WEIGHTS = {"rule_score": 0.35, "model_probability": 0.25, "isolation_score": 0.20, "graph_anomaly_score": 0.20}


def tier(score: Column, bounds=CALIBRATED_BOUNDS) -> Column:
    result = F.lit(TIERS[0])
    for bound, name in zip(bounds, TIERS[1:]):
        result = F.when(score >= bound, name).otherwise(result)
    return result


def tier_rank(name: Column) -> Column:
    """Position of a tier; null when the name is unknown."""
    position = F.array_position(F.array(*[F.lit(t) for t in TIERS]), F.initcap(name))
    return F.when(position > 0, position - 1)


def graph_scores(structure: DataFrame, clusters: DataFrame) -> DataFrame:
    """graph_anomaly_score in [0, 1] and the factors behind it, for accounts with a cluster."""
    merged = structure.join(clusters, "account_id")
    central, dense = F.col("betweenness_centrality"), F.col("clustering_coefficient")
    scale = quantiles(merged.filter(central > 0), "betweenness_centrality", [0.9])
    scale = scale.select(F.when(F.col("q0") > 0, F.col("q0"))).scalar()
    flow = F.least(F.lit(1.0), central / F.coalesce(scale, F.lit(1e-5)))
    close = F.least(F.lit(1.0), dense)
    size, staff = F.col("cluster_size"), F.col("num_connected_employees")
    volume = F.col("in_degree") + F.col("out_degree")
    small = ~F.col("is_outlier") & (size <= 10)

    def part(condition, weight):
        return F.when(condition, weight).otherwise(F.lit(0.0))

    score = (
        part(F.col("is_on_any_cycle"), F.lit(0.35))
        + part(central > 0, flow * 0.20)
        + part(dense > 0, close * 0.15)
        + part(F.col("is_outlier"), F.lit(0.20))
        + part(small, F.lit(0.10))
        + part(staff >= 2, F.lit(0.05))
        + part(volume > 50, F.lit(0.05))
    )
    # Fixed formats of the factors.
    factors = F.concat_ws(
        "; ",
        F.when(F.col("is_on_any_cycle"), "participates in circular transfer cycle"),
        F.when((central > 0) & (flow >= 0.4), F.format_string("high flow betweenness centrality (bc=%.2e)", central)),
        F.when((dense > 0) & (close >= 0.05), F.format_string("elevated clustering coefficient (cc=%.3f)", dense)),
        F.when(F.col("is_outlier"), "topological outlier in Node2Vec space (DBSCAN outlier)"),
        F.when(small, F.format_string("isolated micro-cluster (size=%d)", size)),
        F.when(staff >= 2, F.format_string("multiple connected employees (%d internal contacts)", staff)),
        F.when(volume > 50, F.format_string("high transaction volume (in=%d, out=%d)", "in_degree", "out_degree")),
    )
    return merged.select(
        "account_id",
        F.least(F.lit(1.0), F.round(score, 4)).alias("graph_anomaly_score"),
        F.when(factors == "", "baseline structural profile; no graph anomalies detected")
        .otherwise(factors)
        .alias("contributing_factors"),
    )


def scenario_accounts(scenarios: DataFrame) -> DataFrame:
    """(scenario, account, position) for every account listed by a scenario."""
    return scenarios.select(
        "scenario_id", "scenario_type", F.posexplode(split_ids(F.col("account_id"))).alias("position", "account_id")
    )


def scenario_clusters(scenarios: DataFrame, clusters: DataFrame, small: int = 15) -> DataFrame:
    """Cluster of each scenario account; unknown accounts are outliers of their own."""
    joined = scenario_accounts(scenarios).join(clusters, "account_id", "left")
    size = F.coalesce("cluster_size", F.lit(1).cast("bigint"))
    outlier = F.coalesce("is_outlier", F.lit(True))
    return joined.select(
        "scenario_id",
        "scenario_type",
        "account_id",
        F.coalesce("cluster_label", F.lit(-1)).alias("cluster_label"),
        size.alias("cluster_size"),
        outlier.alias("is_outlier"),
        (outlier | (size <= small)).alias("is_small_or_outlier"),
    )


def cluster_shares(placed: DataFrame) -> DataFrame:
    return placed.groupBy("scenario_type").agg(
        F.count(F.lit(1)).alias("accounts"),
        F.count_if("is_outlier").alias("outliers"),
        F.count_if("is_small_or_outlier").alias("small_or_outliers"),
        (F.count_if("is_small_or_outlier") * 100.0 / F.count(F.lit(1))).alias("small_or_outlier_percent"),
    )


def scenario_scores(scenarios: DataFrame, scores: DataFrame) -> DataFrame:
    """Highest graph score among a scenario's accounts; the first account wins a tie."""
    joined = scenario_accounts(scenarios).join(scores, "account_id", "left")
    score = F.coalesce("graph_anomaly_score", F.lit(0.0))
    best = F.max_by(
        F.struct("account_id", score.alias("score"), F.coalesce("contributing_factors", F.lit("no data")).alias("factors")),
        F.struct(score, -F.col("position")),
    )
    return joined.groupBy("scenario_id", "scenario_type").agg(best.alias("b")).select(
        "scenario_id", "scenario_type", F.col("b.account_id").alias("account_id"),
        F.col("b.score").alias("graph_anomaly_score"), F.col("b.factors").alias("contributing_factors"),
    )


def weighted(weights: dict[str, float]) -> Column:
    total = F.lit(0.0)
    for name, weight in weights.items():
        total = total + F.col(name) * weight
    return F.round(total, 4)


def fused_risk(
    spine: DataFrame,
    fired: DataFrame,
    probabilities: DataFrame,
    isolation: DataFrame,
    graph: DataFrame,
    decision: float = 0.5,
) -> DataFrame:
    """Component scores, calibrated and baseline risk, and tiers, for every account at once."""
    joined = (
        spine.select("account_id")
        .join(fired.select("account_id", "fired_rules", "rule_score"), "account_id", "left")
        .join(probabilities.select("account_id", "model_probability"), "account_id", "left")
        .join(isolation.select("account_id", "isolation_score", "is_isolation_flagged"), "account_id", "left")
        .join(graph.select("account_id", "graph_anomaly_score"), "account_id", "left")
        .withColumn("fired_rules", F.coalesce("fired_rules", F.array().cast("array<string>")))
        .fillna(0.0)
        .fillna(False)
    )
    return (
        joined.withColumn("is_model_flagged", F.col("model_probability") >= decision)
        .withColumn("risk_score", weighted(CALIBRATED_WEIGHTS))
        .withColumn("baseline_score", weighted(BASELINE_WEIGHTS))
        .withColumn("risk_tier", tier(F.col("risk_score")))
        .withColumn("baseline_tier", tier(F.col("baseline_score"), BASELINE_BOUNDS))
    )


def tier_table(risk: DataFrame, scenarios: DataFrame, column: str = "risk_tier") -> DataFrame:
    """Accounts per tier for each scenario type."""
    kinds = scenario_accounts(scenarios).filter("position = 0").select("account_id", "scenario_type")
    return risk.join(kinds, "account_id").groupBy("scenario_type").pivot(column, list(TIERS)).count().fillna(0)


def alert_queue(
    risk: DataFrame, minimum: str = "Medium", scenarios: DataFrame | None = None, scenario_type: str | None = None
) -> DataFrame:
    """Alerts of at least the minimum tier (an unknown one means Medium), highest risk first."""
    floor = TIERS.index(minimum.capitalize()) if minimum.capitalize() in TIERS else 1
    kept = risk.filter(F.coalesce(tier_rank(F.col("risk_tier")), F.lit(0)) >= floor)
    if scenarios is not None:
        kinds = scenario_accounts(scenarios).filter("position = 0").select("account_id", "scenario_id", "scenario_type")
        kept = kept.join(kinds, "account_id")
        if scenario_type:
            kept = kept.filter(F.lower("scenario_type") == scenario_type.lower())
    return kept.withColumn("alert_id", F.concat(F.lit("ALT-"), "account_id")).orderBy(
        F.desc("risk_score"), "account_id"
    )


def search_alerts(alerts: DataFrame, query: str) -> DataFrame:
    """Alerts whose account, alert or scenario id, or any fired rule, contains the query."""
    wanted = F.lit(query.lower())
    texts = [c for c in ("account_id", "alert_id", "scenario_id") if c in alerts.columns]
    found = F.exists("fired_rules", lambda r: F.contains(F.lower(r), wanted))
    for name in texts:
        found = found | F.contains(F.lower(name), wanted)
    return alerts.filter(found)


def current_cases(events: DataFrame, risk: DataFrame) -> DataFrame:
    """Latest state of each case from an append-only event table.

    ``events``: case_id, account_id, event (create or assign), title, notes, assigned_to, priority,
    at, and event_id where events have one: it orders those of one instant.  Missing values get
    defaults; a null priority follows the tier of the account.
    """
    made = F.col("event") == "create"
    place = F.struct("at", "event_id") if "event_id" in events.columns else F.struct("at", "event", "assigned_to")

    def first(name):
        return F.min_by(F.when(made, F.col(name)), F.when(made, place)).alias(name)

    assigned = F.when(F.col("assigned_to").isNotNull(), place)
    state = events.groupBy("case_id").agg(
        first("account_id"), first("title"), first("notes"), first("priority"),
        F.max_by(F.trim("assigned_to"), assigned).alias("assigned_to"),
        F.min("at").alias("created_at"),
        F.max("at").alias("updated_at"),
    )
    joined = state.join(risk.select("account_id", "risk_tier", "risk_score"), "account_id", "left")
    known = F.coalesce("risk_tier", F.lit("Unknown"))
    # The defaults of a new case.
    return joined.select(
        "case_id",
        "account_id",
        F.concat(F.lit("ALT-"), "account_id").alias("alert_id"),
        F.coalesce("title", F.format_string("Investigation into Account %s (%s Risk)", F.col("account_id"), known)).alias("title"),
        F.coalesce("notes", F.lit("Initial case created from detection alert.")).alias("notes"),
        F.coalesce("assigned_to", F.lit("Unassigned")).alias("assigned_to"),
        F.coalesce("priority", F.when(known == "Critical", "CRITICAL").otherwise("HIGH")).alias("priority"),
        F.lit("OPEN").alias("status"),
        known.alias("risk_tier"),
        F.coalesce("risk_score", F.lit(0.0)).alias("risk_score"),
        "created_at",
        "updated_at",
    )
