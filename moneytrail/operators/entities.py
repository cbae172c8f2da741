"""Accounts and customers in scope, and what the ledger says about them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import account_role, split_ids


def explode_ids(df: DataFrame, column: str, name: str = "account_id", separators: str = ";") -> DataFrame:
    """One row per item of a delimited id list."""
    return df.withColumn(name, F.explode(split_ids(F.col(column), separators)))


def distinct_ids(*columns: tuple[DataFrame, str], name: str = "account_id") -> DataFrame:
    """Union of id columns (delimited lists allowed), each id once.  Columns of one table share a scan."""
    tables: dict[int, tuple[DataFrame, list[str]]] = {}
    for df, column in columns:
        tables.setdefault(id(df), (df, []))[1].append(column)
    parts = [
        df.select(F.explode(F.concat(*[split_ids(F.col(c)) for c in names])).alias(name)) for df, names in tables.values()
    ]
    return reduce(DataFrame.unionByName, parts).distinct()


def ledger_touching(ledger: DataFrame, accounts: DataFrame) -> DataFrame:
    """Ledger rows whose sender or receiver is among ``accounts``.

    Two equi joins to a flag: a join on ``a or b`` would become a nested loop.  Whether the
    account set is broadcast is left to its measured size.
    """
    ids = accounts.select("account_id").distinct()
    sender = ids.select(F.col("account_id").alias("from_account"), F.lit(True).alias("_sender"))
    receiver = ids.select(F.col("account_id").alias("to_account"), F.lit(True).alias("_receiver"))
    flagged = ledger.join(sender, "from_account", "left").join(receiver, "to_account", "left")
    return flagged.filter("_sender is not null or _receiver is not null").select(*ledger.columns)


def account_payments(ledger: DataFrame) -> DataFrame:
    """One row per payment and account it touches, with the account's role; self-transfers once."""
    sender, receiver = F.col("from_account"), F.col("to_account")
    touched = F.when(sender == receiver, F.array(sender)).otherwise(F.array(sender, receiver))
    rows = ledger.withColumn("account_id", F.explode(touched))
    return rows.withColumn("account_role", account_role(F.col("account_id"), sender, receiver))


def account_stats(real: DataFrame, injected: DataFrame) -> DataFrame:
    """Per account: rows by origin, first and last time, home bank and laundering rows.

    Bank: the earliest payment sent, else received; real payments before injected ones; of several
    payments at one time the lowest bank.  Time and bank are packed into one number, so that the
    aggregate stays a hash aggregate: with rows or texts as buffers it would sort the ledger.
    """
    columns = ["transaction_id", "ts", "from_bank", "from_account", "to_bank", "to_account", "is_laundering"]
    ledger = real.select(*columns, F.lit(False).alias("is_synthetic")).unionByName(
        injected.select(*columns, F.lit(True).alias("is_synthetic"))
    )
    rows = account_payments(ledger)
    sends = F.col("account_role").isin("sender", "self")
    receives = F.col("account_role").isin("receiver", "self")
    real_row = ~F.col("is_synthetic")

    digits = 10**10
    time = F.unix_micros("ts").cast("decimal(20,0)") * F.lit(digits).cast("decimal(11,0)")

    def first_bank(side, bank, origin):
        earliest = F.min(F.when(side & origin, time + F.col(bank)))
        return F.pmod(earliest, F.lit(digits).cast("decimal(11,0)")).cast("int")

    return rows.groupBy("account_id").agg(
        F.coalesce(
            first_bank(sends, "from_bank", real_row),
            first_bank(receives, "to_bank", real_row),
            first_bank(sends, "from_bank", ~real_row),
            first_bank(receives, "to_bank", ~real_row),
        ).alias("bank_id"),
        F.min("ts").alias("first_seen"),
        F.max("ts").alias("last_seen"),
        F.count_if(real_row).alias("real_txn_count"),
        F.count_if(~real_row).alias("synthetic_txn_count"),
        F.count(F.lit(1)).alias("total_transaction_count"),
        F.count_if(real_row & (F.col("is_laundering") == 1)).alias("background_real_laundering_count"),
    )


def scoped_customers(employee_map: DataFrame, profile_changes: DataFrame) -> DataFrame:
    return distinct_ids((employee_map, "customer_id"), (profile_changes, "customer_id"), name="customer_id")


def scoped_accounts(
    access_events: DataFrame, scenarios: DataFrame, injected: DataFrame, customer_ids: DataFrame
) -> DataFrame:
    return distinct_ids(
        (access_events, "target_account_id"),
        (scenarios, "account_id"),
        (injected, "from_account"),
        (injected, "to_account"),
        (customer_ids, "customer_id"),
    )


def build_accounts(
    real: DataFrame, injected: DataFrame, accounts: DataFrame, customer_ids: DataFrame
) -> DataFrame:
    """The account table: one row per account in scope, with its statistics and customer."""
    linked = customer_ids.select(
        F.col("customer_id").alias("account_id"), F.col("customer_id").alias("linked_customer_id")
    )
    counts = [
        "real_txn_count",
        "synthetic_txn_count",
        "total_transaction_count",
        "background_real_laundering_count",
    ]
    joined = accounts.join(linked, "account_id", "left").join(account_stats(real, injected), "account_id", "left")
    return joined.select(
        "account_id",
        "linked_customer_id",
        "bank_id",
        "first_seen",
        "last_seen",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in counts],
    )
