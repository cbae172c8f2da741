"""The investigation history of accounts, as row tables keyed by account.

Nothing is gathered into one row per account: a busy account may own a large share of the
ledger.  Order within an account is given by a position column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .entities import account_payments, explode_ids
from .skew import HOT_ROWS, positions


def last_record(df: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """The last record of every non-blank key."""
    row = F.struct(*[F.col(c) for c in df.columns])
    known = df.filter(F.coalesce(F.trim(key), F.lit("")) != "")
    return known.groupBy(F.col(key).alias("_key")).agg(F.max_by(row, F.struct(*order)).alias("_row")).select("_row.*")


def linked_employees(
    accounts: DataFrame, customers: DataFrame, employee_map: DataFrame, employees: DataFrame
) -> DataFrame:
    """Account to customer to relationship to employee; unknown employees keep id and relationship."""
    known = customers.select(F.col("customer_id").alias("linked_customer_id"))
    relation = employee_map.withColumnRenamed("customer_id", "linked_customer_id")
    chain = accounts.select("account_id", "linked_customer_id").join(known, "linked_customer_id", "left_semi")
    chain = chain.join(relation, "linked_customer_id")
    roster = employees.select("employee_id", "name", "role")
    return chain.join(roster, "employee_id", "left").select(
        "account_id", "employee_id", "relationship_type", "name", "role"
    )


def account_access_events(access_events: DataFrame) -> DataFrame:
    """Access events by target account, each event once per account."""
    exploded = explode_ids(access_events, "target_account_id")
    return exploded.dropDuplicates(["account_id", "event_id"])


def ledger_counts(ledger: DataFrame) -> DataFrame:
    return account_payments(ledger).groupBy("account_id").agg(
        F.count(F.lit(1)).alias("total_transactions"),
        F.count_if("is_synthetic").alias("synthetic_transactions"),
        F.count_if(~F.col("is_synthetic")).alias("real_transactions"),
        *[F.count_if(F.col("account_role") == r).alias(f"{r}_count") for r in ("sender", "receiver", "self")],
    )


def history_summary(
    accounts: DataFrame,
    ledger: DataFrame,
    access_events: DataFrame,
    profile_changes: DataFrame,
    employee_map: DataFrame,
    customers: DataFrame,
) -> DataFrame:
    """How many records of every kind each account has."""
    known = customers.select(F.col("customer_id").alias("linked_customer_id"), F.lit(True).alias("_known"))
    staff = employee_map.groupBy(F.col("customer_id").alias("linked_customer_id")).agg(F.count(F.lit(1)).alias("_staff"))
    changes = profile_changes.groupBy(F.col("customer_id").alias("linked_customer_id")).agg(
        F.count(F.lit(1)).alias("_changes")
    )
    events = account_access_events(access_events).groupBy("account_id").agg(F.count(F.lit(1)).alias("_events"))
    joined = (
        accounts.select("account_id", "linked_customer_id")
        .join(known, "linked_customer_id", "left")
        .join(staff, "linked_customer_id", "left")
        .join(changes, "linked_customer_id", "left")
        .join(events, "account_id", "left")
        .join(ledger_counts(ledger), "account_id", "left")
    )
    linked = F.coalesce("_known", F.lit(False))
    counts = (
        "total_transactions synthetic_transactions real_transactions sender_count receiver_count self_count"
    ).split()
    return joined.select(
        "account_id",
        linked.alias("has_linked_customer"),
        F.when(linked, F.coalesce("_staff", F.lit(0))).otherwise(0).alias("linked_employee_count"),
        F.coalesce("_events", F.lit(0)).alias("access_event_count"),
        F.coalesce("_changes", F.lit(0)).alias("profile_change_count"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in counts],
    )


def reconcile(accounts: DataFrame, ledger: DataFrame) -> DataFrame:
    """Do the counts of the account table equal those of the ledger?"""
    joined = accounts.join(ledger_counts(ledger), "account_id", "left")
    found = {c: F.coalesce(c, F.lit(0)) for c in ("total_transactions", "real_transactions", "synthetic_transactions")}
    same = (
        (F.col("total_transaction_count") == found["total_transactions"])
        & (F.col("real_txn_count") == found["real_transactions"])
        & (F.col("synthetic_txn_count") == found["synthetic_transactions"])
    )
    return joined.select(
        "account_id",
        F.col("total_transaction_count").alias("account_total"),
        found["total_transactions"].alias("ledger_total"),
        same.alias("reconciled"),
    )


def account_history(
    accounts: DataFrame,
    ledger: DataFrame,
    access_events: DataFrame,
    profile_changes: DataFrame,
    customers: DataFrame,
    employee_map: DataFrame,
    employees: DataFrame,
    limit: int = HOT_ROWS,
) -> DataFrame:
    """Every record of every account in time order; records without a time come first."""
    wanted = accounts.select("account_id")

    def rows(df, kind, record, detail, ts="ts"):
        return df.select(
            "account_id",
            F.lit(kind).alias("record_type"),
            record.alias("record_id"),
            (F.col(ts) if ts else F.lit(None).cast("timestamp")).alias("ts"),
            detail.alias("detail"),
        )

    payments = account_payments(ledger).join(wanted, "account_id", "left_semi")
    events = account_access_events(access_events).join(wanted, "account_id", "left_semi")
    owned = accounts.select("account_id", F.col("linked_customer_id").alias("customer_id"))
    changes = profile_changes.join(owned, "customer_id")
    staff = linked_employees(accounts, customers, employee_map, employees)
    history = (
        rows(payments, "transaction", F.col("transaction_id"), F.col("account_role"))
        .unionByName(rows(events, "access_event", F.col("event_id"), F.col("action")))
        .unionByName(rows(changes, "profile_change", F.col("change_id"), F.col("field_changed")))
        .unionByName(
            rows(staff, "employee", F.concat_ws(":", "employee_id", "relationship_type"), F.col("name"), ts=None)
        )
    )
    order = [F.col("ts").asc_nulls_first(), F.col("record_type"), F.col("record_id")]
    return positions(history, ["account_id"], order, limit=limit)


def ledger_preview(ledger: DataFrame, senders: int = 10, selfs: int = 3) -> DataFrame:
    """A reading sample per account: the first payments sent, the first self-transfers, every
    payment received and every injected payment."""
    rows = account_payments(ledger)
    everything = F.col("is_synthetic") | (F.col("account_role") == "receiver")
    # The rank test is right on the row number, so each task keeps only the first few rows
    # of a group before the shuffle.
    first = Window.partitionBy("account_id", "account_role").orderBy("ts", "transaction_id")
    ranked = rows.filter(F.col("account_role") != "receiver").withColumn("_rn", F.row_number().over(first))
    kept = ranked.filter(F.col("_rn") <= max(senders, selfs)).filter(
        ~F.col("is_synthetic")
        & (F.col("_rn") <= F.when(F.col("account_role") == "sender", F.lit(senders)).otherwise(selfs))
    )
    return rows.filter(everything).unionByName(kept.drop("_rn"))
