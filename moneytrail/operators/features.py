"""Account features in seven groups, and their assembly into one leakage-checked matrix."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import split_ids
from .clean import assert_no_labels, drop_labels
from .entities import explode_ids

# Feature names by group.
FEATURE_GROUPS = {
    "activity": (
        "real_txn_count", "synthetic_txn_count", "total_transaction_count", "has_linked_customer", "bank_id_encoded",
        "account_age_days", "activity_span_days", "txn_density", "synthetic_fraction",
    ),
    "amounts": (
        "mean_amount", "std_amount", "max_amount", "min_amount", "wire_fraction", "ach_fraction",
        "cross_currency_fraction", "cross_bank_ratio", "unique_counterparties_out", "unique_counterparties_in",
        "total_sent_amount", "total_received_amount", "sub_threshold_fraction", "amount_cv",
        "counterparty_diversity", "max_amount_zscore",
    ),
    "access": (
        "access_event_count", "modify_count", "revoke_count", "grant_count", "unique_employee_accessors",
        "access_event_rate",
    ),
    "profile": (
        "profile_change_count", "high_risk_field_change_count", "limit_field_change_count",
        "unique_profile_change_employees", "profile_change_rate",
    ),
    "staff": ("managing_employee_count", "has_approver", "has_account_manager"),
    "customer": ("risk_rating_encoded", "country_encoded"),
    "rules": ("privilege_change_triggered", "circular_transfer_triggered", "transaction_splitting_triggered"),
}

# The ten features of the supervised model.
SIGNAL_FEATURES = (
    "txn_density", "max_amount_zscore", "cross_currency_fraction", "unique_counterparties_out",
    "sub_threshold_fraction", "profile_change_rate", "total_transaction_count", "mean_amount", "wire_fraction",
    "access_event_rate",
)

# Profile fields that matter for risk.
HIGH_RISK_FIELDS = ("spending_limit", "wire_transfer_limit", "risk_rating", "beneficial_owner", "account_type")
LIMIT_FIELDS = ("spending_limit", "wire_transfer_limit")

# Rule id of every rule flag.
RULE_FLAGS = {
    "INSIDER.PRIVILEGE_CHANGE": "privilege_change_triggered",
    "AML.CIRCULAR_TRANSFER": "circular_transfer_triggered",
    "AML.TRANSACTION_SPLITTING": "transaction_splitting_triggered",
}


def _is(column: str, value: str):
    return F.lower(F.col(column)) == value


def _as_double(df: DataFrame) -> DataFrame:
    return df.select("account_id", *[F.col(c).cast("double").alias(c) for c in df.columns if c != "account_id"])


def activity_features(accounts: DataFrame) -> DataFrame:
    seconds = (F.unix_micros("last_seen") - F.unix_micros("first_seen")) / 1e6
    age = F.coalesce(F.greatest(seconds / 86400.0, F.lit(0.0)), F.lit(0.0))
    total = F.col("total_transaction_count")
    return _as_double(
        accounts.select(
            "account_id",
            "real_txn_count",
            "synthetic_txn_count",
            "total_transaction_count",
            F.col("linked_customer_id").isNotNull().alias("has_linked_customer"),
            F.coalesce("bank_id", F.lit(0)).alias("bank_id_encoded"),
            age.alias("account_age_days"),
            age.alias("activity_span_days"),
            (total / (age + 1.0)).alias("txn_density"),
            (F.col("synthetic_txn_count") / F.greatest(total, F.lit(1))).alias("synthetic_fraction"),
        )
    )


def amount_features(ledger: DataFrame, accounts: DataFrame, boundary: float = 10000.0) -> DataFrame:
    """Sender and receiver aggregates over the whole ledger, aligned to the account spine."""
    df = drop_labels(ledger).withColumn("amount_paid", F.coalesce("amount_paid", F.lit(0.0)))
    overall = df.agg(F.avg("amount_paid").alias("m"), F.stddev_samp("amount_paid").alias("s"))
    mean = overall.select(F.coalesce("m", F.lit(0.0))).scalar()
    spread = overall.select(F.when(F.col("s") > 0, F.col("s")).otherwise(1.0)).scalar()

    n = F.count("transaction_id")

    def share(condition):
        return F.count_if(condition) / F.greatest(n, F.lit(1))

    sent = df.groupBy(F.col("from_account").alias("account_id")).agg(
        F.avg("amount_paid").alias("mean_amount"),
        F.coalesce(F.stddev_samp("amount_paid"), F.lit(0.0)).alias("std_amount"),
        F.max("amount_paid").alias("max_amount"),
        F.min("amount_paid").alias("min_amount"),
        share(_is("payment_format", "wire")).alias("wire_fraction"),
        share(_is("payment_format", "ach")).alias("ach_fraction"),
        share(F.coalesce(F.lower("payment_currency"), F.lit("nan")) != "us dollar").alias("cross_currency_fraction"),
        share(~F.col("from_bank").eqNullSafe(F.col("to_bank"))).alias("cross_bank_ratio"),
        F.count_distinct("to_account").alias("unique_counterparties_out"),
        F.sum("amount_paid").alias("total_sent_amount"),
        share(F.col("amount_paid") < boundary).alias("sub_threshold_fraction"),
    )
    received = df.groupBy(F.col("to_account").alias("account_id")).agg(
        F.sum("amount_paid").alias("total_received_amount"),
        F.count_distinct("from_account").alias("unique_counterparties_in"),
    )
    spine = accounts.select("account_id", F.col("total_transaction_count").alias("_total"))
    joined = spine.join(sent, "account_id", "left").join(received, "account_id", "left").fillna(0)
    joined = joined.withColumns(
        {
            "amount_cv": F.col("std_amount") / (F.col("mean_amount") + 1e-6),
            "counterparty_diversity": F.col("unique_counterparties_out") / F.greatest("_total", F.lit(1)),
            "max_amount_zscore": (F.col("max_amount") - mean) / spread,
        }
    )
    return _as_double(joined.select("account_id", *FEATURE_GROUPS["amounts"]))


def access_features(access_events: DataFrame, activity: DataFrame, split_targets: bool = False) -> DataFrame:
    """Access-event counts per target.  Lists of targets stay whole unless ``split_targets``."""
    df = drop_labels(access_events)
    if split_targets:
        df = explode_ids(df, "target_account_id")
    else:
        df = df.withColumn("account_id", F.col("target_account_id"))
    counts = df.groupBy("account_id").agg(
        F.count("event_id").alias("access_event_count"),
        F.count_if(_is("action", "modify")).alias("modify_count"),
        F.count_if(_is("action", "revoke")).alias("revoke_count"),
        F.count_if(_is("action", "grant")).alias("grant_count"),
        F.count_distinct("employee_id").alias("unique_employee_accessors"),
    )
    joined = activity.select("account_id", "account_age_days").join(counts, "account_id", "left").fillna(0)
    rate = F.col("access_event_count") / (F.col("account_age_days") + 1.0)
    return _as_double(joined.withColumn("access_event_rate", rate).select("account_id", *FEATURE_GROUPS["access"]))


def profile_features(profile_changes: DataFrame, activity: DataFrame) -> DataFrame:
    field = F.lower("field_changed")
    counts = drop_labels(profile_changes).groupBy(F.col("customer_id").alias("account_id")).agg(
        F.count("change_id").alias("profile_change_count"),
        F.count_if(field.isin(*HIGH_RISK_FIELDS)).alias("high_risk_field_change_count"),
        F.count_if(field.isin(*LIMIT_FIELDS)).alias("limit_field_change_count"),
        F.count_distinct("changed_by_employee_id").alias("unique_profile_change_employees"),
    )
    joined = activity.select("account_id", "account_age_days").join(counts, "account_id", "left").fillna(0)
    rate = F.col("profile_change_count") / (F.col("account_age_days") + 1.0)
    return _as_double(joined.withColumn("profile_change_rate", rate).select("account_id", *FEATURE_GROUPS["profile"]))


def staff_features(employee_map: DataFrame, accounts: DataFrame) -> DataFrame:
    counts = drop_labels(employee_map).groupBy(F.col("customer_id").alias("account_id")).agg(
        F.count_distinct("employee_id").alias("managing_employee_count"),
        F.max(_is("relationship_type", "approver").cast("int")).alias("has_approver"),
        F.max(_is("relationship_type", "account_manager").cast("int")).alias("has_account_manager"),
    )
    return _as_double(accounts.select("account_id").join(counts, "account_id", "left").fillna(0))


def country_codes(customers: DataFrame) -> DataFrame:
    """country, code: rank of the country among all countries, from 1.

    There are at most a few hundred countries, so ordering the distinct names takes one small task.
    """
    countries = customers.select("country").filter(F.col("country").isNotNull()).distinct()
    return countries.select("country", F.row_number().over(Window.orderBy("country")).cast("double").alias("code"))


def customer_features(customers: DataFrame, accounts: DataFrame, codes: DataFrame | None = None) -> DataFrame:
    """Ordinal risk rating and country code; ``codes`` may be a stored table."""
    codes = country_codes(customers) if codes is None else codes
    rating = F.lower("risk_rating")
    encoded = (
        drop_labels(customers)
        .join(codes, "country", "left")
        .select(
            F.col("customer_id").alias("linked_customer_id"),
            F.when(rating == "medium", 1.0).when(rating == "high", 2.0).otherwise(0.0).alias("risk_rating_encoded"),
            F.col("code").alias("country_encoded"),
        )
    )
    joined = accounts.select("account_id", "linked_customer_id").join(encoded, "linked_customer_id", "left")
    return _as_double(joined.select("account_id", *FEATURE_GROUPS["customer"]).fillna(0))


def rule_features(results: DataFrame, accounts: DataFrame) -> DataFrame:
    """One flag per rule: did it fire for the account?"""
    fired = results.filter("triggered").groupBy("account_id").pivot("rule_id", list(RULE_FLAGS)).agg(F.count(F.lit(1)))
    for rule_id, name in RULE_FLAGS.items():
        fired = fired.withColumn(name, (F.coalesce(F.col(f"`{rule_id}`"), F.lit(0)) > 0).cast("int")).drop(f"{rule_id}")
    joined = accounts.select("account_id").join(fired, "account_id", "left").fillna(0)
    return _as_double(joined.select("account_id", *FEATURE_GROUPS["rules"]))


def feature_matrix(
    accounts: DataFrame,
    ledger: DataFrame,
    access_events: DataFrame,
    profile_changes: DataFrame,
    employee_map: DataFrame,
    customers: DataFrame | None = None,
    rule_results: DataFrame | None = None,
    boundary: float = 10000.0,
) -> DataFrame:
    """All feature groups for every account: 39 columns, 41 with customers, 44 with rules too.

    Every part is keyed by account, so the joins reuse the partitioning of the aggregates.
    """
    activity = activity_features(accounts)
    matrix = activity
    parts = [
        amount_features(ledger, accounts, boundary),
        access_features(access_events, activity),
        profile_features(profile_changes, activity),
        staff_features(employee_map, accounts),
    ]
    if customers is not None:
        parts.append(customer_features(customers, accounts))
    if rule_results is not None:
        parts.append(rule_features(rule_results, accounts))
    for part in parts:
        matrix = matrix.join(part, "account_id")
    return assert_no_labels(matrix.fillna(0.0))


def select_features(matrix: DataFrame, names: Sequence[str]) -> DataFrame:
    missing = [n for n in names if n not in matrix.columns]
    if missing:
        raise ValueError(f"unknown features: {missing}")
    return matrix.select("account_id", *names)


def labeled_scenarios(scenarios: DataFrame) -> DataFrame:
    """Add the first account and a 0/1 label; any other scenario type is an error."""
    kind = F.lower("scenario_type")
    label = (
        F.when(kind == "suspicious", 1)
        .when(kind == "legitimate", 0)
        .otherwise(F.raise_error(F.lit("scenario_type must be 'suspicious' or 'legitimate'")).cast("int"))
    )
    first = F.element_at(split_ids(F.col("account_id")), 1)
    return scenarios.withColumns({"primary_account_id": first, "label": label})


def labeled_rows(matrix: DataFrame, scenarios: DataFrame, names: Sequence[str]) -> DataFrame:
    """One training row per scenario: the features of its first account, and its label."""
    marked = labeled_scenarios(scenarios).select(
        "scenario_id", "scenario_type", "employee_id", F.col("primary_account_id").alias("account_id"), "label"
    )
    return marked.join(select_features(matrix, names), "account_id")


def split_background(matrix: DataFrame, scenarios: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(accounts of no scenario, accounts of a scenario)``."""
    marked = labeled_scenarios(scenarios).select(F.col("primary_account_id").alias("account_id")).distinct()
    return matrix.join(marked, "account_id", "left_anti"), matrix.join(marked, "account_id", "left_semi")
