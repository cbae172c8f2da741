"""Queries over sources, cleaning, projections and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import (
    WHITESPACE,
    account_role,
    clean_text,
    contains_any,
    parse_timestamp,
    safe_double,
)
from ..operators import clean, entities, features, rule_config
from ..session import scratch_path
from ..sources import io
from .oracle import sql


def ts_us():
    return F.unix_micros("ts").alias("ts_us")


def _ledger_rows(df):
    return df.select(
        "transaction_id", ts_us(), "from_bank", "from_account", "to_bank", "to_account", "amount_paid",
        "payment_currency", "payment_format", "is_laundering",
    )


LEDGER_COLUMNS = (
    "transaction_id, epoch_us(ts) AS ts_us, from_bank, from_account, to_bank, to_account, amount_paid, "
    "payment_currency, payment_format, is_laundering"
)


def scan_ledger(s):
    return _ledger_rows(s.ledger())


def targets(s):
    return entities.distinct_ids((s.access_events(), "target_account_id"))


def scan_in_scope(s):
    return _ledger_rows(entities.ledger_touching(s.real(), targets(s)))


def standard_header(s):
    raw = s.trade_ledger().select("transaction_id", "from_account", "to_account", "amount_paid")
    raw = raw.toDF(" Transaction-ID", "Account2", "Account4", "Amount Paid ")
    return io.standardize_columns(raw)


def sequential_ids(s):
    df = s.ledger().select("transaction_id", "ts", "from_account")
    return clean.sequential_ids(df, [F.col("ts"), F.col("transaction_id")]).select(
        "row_id", "transaction_id", "from_account"
    )


def column_profile(s):
    df = s.trade_ledger().select("transaction_id", "from_account", "to_account", "amount_paid")
    profile = clean.column_profile(df.withColumn("amount_paid", F.round(df.amount_paid * 100).cast("bigint")))
    return profile.drop("data_type")


def table_round_trip(s):
    path = scratch_path(s.spark, "accounts")
    df = entities.account_stats(s.real(), s.injected()).select(
        "account_id", "real_txn_count", "synthetic_txn_count", "total_transaction_count"
    )
    return s.spark.read.parquet(io.write_table(df, path))


TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages",
    "benchmark", "labels", "conversations",
)


def table_inventory(s):
    paths = {n: f"{s.folder}/{n}.parquet" for n in TABLES}
    return io.inventory(s.spark, {**paths, "absent": f"{s.folder}/absent.parquet"})


def normalized_text(s):
    padded = F.concat(F.lit(" 　\t"), F.col("text"), F.lit(" \n"))
    cleaned, blanked = clean_text(padded), clean_text(F.when(F.col("doc_id") % 5 != 0, padded))
    return s.table("documents").select(
        "doc_id", F.md5(cleaned).alias("text_md5"), F.length(cleaned).alias("n"), F.length(blanked).alias("n_with_nulls")
    )


def usable_payments(s):
    df = clean.usable_payments(s.raw_ledger())
    return df.select("transaction_id", ts_us(), "from_account", "to_account", "amount_paid", "payment_format")


def usable_transfers(s):
    df = clean.usable_payments(s.raw_ledger(), needs_amount=False)
    return df.select("transaction_id", ts_us(), "from_account", "to_account")


def parsed_timestamps(s):
    return s.raw_ledger().select(
        "from_account", "timestamp", F.unix_micros(parse_timestamp(F.col("timestamp"))).alias("ts_us")
    )


def safe_numbers(s):
    return s.raw_ledger().select(
        "transaction_id", "from_account", "timestamp", safe_double(F.col("amount_paid")).alias("amount")
    )


def label_guard(s):
    kept = clean.assert_no_labels(clean.drop_labels(s.ledger().withColumn("source", F.lit("bank"))))
    return kept.select("transaction_id", ts_us(), "from_account", "to_account", "amount_paid").withColumn(
        "kept_columns", F.lit(len(kept.columns))
    )


TERMS = rule_config.ADMINISTRATIVE_TERMS


def keyword_events(s):
    df = s.access_events()
    return df.filter(contains_any([df.action, df.old_value, df.new_value], TERMS)).select(
        "event_id", "action", "old_value", "new_value"
    )


def exploded_targets(s):
    return entities.explode_ids(s.access_events(), "target_account_id").select("event_id", "account_id", "employee_id")


def payment_roles(s):
    df = s.ledger()
    return df.select(
        "transaction_id",
        account_role(F.lit("A7"), df.from_account, df.to_account).alias("role_of_a7"),
        account_role(df.from_account, df.from_account, df.to_account).alias("role_of_sender"),
    )


def scenario_labels(s):
    return features.labeled_scenarios(s.scenarios()).select(
        "scenario_id", F.col("primary_account_id").alias("account_id"), "label"
    )


def ordinal_codes(s):
    accounts = s.customers().select(
        F.col("customer_id").alias("account_id"), F.col("customer_id").alias("linked_customer_id")
    )
    return features.customer_features(s.customers(), accounts)


def unified_ledger(s):
    real = s.real().select("transaction_id", "from_account", "to_account", "amount_paid")
    injected = s.injected().select("transaction_id", "from_account", "to_account", "amount_paid", "scenario_id")
    return real.unionByName(injected, allowMissingColumns=True)


def scoped_accounts(s):
    customers = entities.scoped_customers(s.employee_map(), s.profile_changes())
    return entities.scoped_accounts(s.access_events(), s.scenarios(), s.injected(), customers)


def external_counterparties(s):
    ledger = s.trade_ledger()
    known = s.ledger().select(F.col("from_account").alias("account_id")).distinct()
    return entities.distinct_ids((ledger, "from_account"), (ledger, "to_account")).join(
        known, "account_id", "left_anti"
    )


def shared_keys(s):
    left = entities.distinct_ids((s.access_events(), "target_account_id"))
    return left.join(s.ledger().select(F.col("from_account").alias("account_id")).distinct(), "account_id", "left_semi")


def merged_sources(s):
    extra = s.ledger().filter(F.col("is_laundering") == 1).withColumn("amount_paid", F.lit(-1.0))
    merged = clean.merge_sources(
        [
            ("injected", "injected_transaction", s.injected().drop("scenario_id")),
            ("bank", "real_transaction", s.real()),
            ("bank", "in_scope_transaction", extra.drop("is_synthetic", "scenario_id")),
        ]
    )
    return merged.select("transaction_id", "amount_paid", "source_dataset", "record_type")


def unique_relationships(s):
    orders = s.table("orders").select(
        F.concat(F.lit("E"), (F.col("o_custkey") % 5).cast("string")).alias("employee_id"),
        F.concat(F.lit("A"), (F.col("o_custkey") % 150).cast("string")).alias("customer_id"),
        "o_orderkey",
        "o_orderpriority",
    )
    return clean.keep_first(orders, ["employee_id", "customer_id"], [F.col("o_orderkey")]).select(
        "employee_id", "customer_id", "o_orderkey", "o_orderpriority"
    )


_BLANKS = " || ".join(f"chr({ord(c)})" for c in WHITESPACE)


def _text(value):
    return f"coalesce(trim({value}, {_BLANKS}), '')"


_PARSED = "try_strptime(timestamp, ['%Y/%m/%d %H:%M', '%Y-%m-%d %H:%M:%S', '%Y-%m-%d %H:%M'])"

_STATS = """SELECT account_id, count(*) FILTER (NOT is_synthetic) AS real_txn_count,
    count(*) FILTER (is_synthetic) AS synthetic_txn_count, count(*) AS total_transaction_count
    FROM touch GROUP BY account_id"""

_TERM_TEST = " OR ".join(f"contains(txt, '{t}')" for t in TERMS)

_RAW_USABLE = f"""SELECT {_text('transaction_id')} AS transaction_id, epoch_us({_PARSED}) AS ts_us,
    {_text('from_account')} AS from_account, {_text('to_account')} AS to_account,
    TRY_CAST(amount_paid AS DOUBLE) AS amount_paid, payment_format FROM raw_ledger"""

QUERIES = {
    "scan_ledger": (scan_ledger, sql(f"SELECT {LEDGER_COLUMNS} FROM ledger", "ledger")),
    "scan_in_scope_ledger": (
        scan_in_scope,
        sql(
            f"SELECT {LEDGER_COLUMNS} FROM real_tx WHERE from_account IN (SELECT account_id FROM targets) "
            "OR to_account IN (SELECT account_id FROM targets)",
            "real_tx", "targets",
        ),
    ),
    "standard_header": (
        standard_header,
        sql("SELECT transaction_id, from_account, to_account, amount_paid FROM trade", "trade"),
    ),
    "sequential_ids": (
        sequential_ids,
        sql(
            "SELECT 'TXN_' || lpad('' || row_number() OVER (ORDER BY ts, transaction_id), 7, '0') AS row_id, "
            "transaction_id, from_account FROM ledger",
            "ledger",
        ),
    ),
    "column_profile": (
        column_profile,
        sql(
            "SELECT column_name, count(v) AS non_null_count, (count(*) - count(v)) * 100.0::DOUBLE / count(*) AS "
            "null_percent, count(DISTINCT v) AS distinct_count, substr(min(v), 1, 50) AS sample_value FROM ("
            + " UNION ALL ".join(
                f"SELECT '{c}' AS column_name, {e} AS v FROM trade"
                for c, e in (
                    ("transaction_id", "transaction_id"), ("from_account", "from_account"),
                    ("to_account", "to_account"), ("amount_paid", "'' || CAST(round(amount_paid * 100) AS BIGINT)"),
                )
            )
            + ") GROUP BY column_name",
            "trade",
        ),
    ),
    "table_round_trip": (table_round_trip, sql(_STATS, "touch")),
    "table_inventory": (
        table_inventory,
        " UNION ALL ".join(
            f"SELECT '{n}' AS table_name, 'OK' AS status, count(*) AS row_count, (SELECT CAST(count(*) AS INTEGER) FROM "
            f"information_schema.columns WHERE table_name = '{n}') AS column_count FROM {n}"
            for n in TABLES
        )
        + " UNION ALL SELECT 'absent', 'MISSING', NULL, NULL",
    ),
    "normalized_text": (
        normalized_text,
        "SELECT doc_id, md5(t) AS text_md5, CAST(length(t) AS INTEGER) AS n, CAST(CASE WHEN doc_id % 5 = 0 THEN length(e) "
        "ELSE length(t) END AS INTEGER) AS n_with_nulls FROM (SELECT doc_id, "
        + _text("' ' || chr(12288) || chr(9) || text || chr(160) || chr(10)")
        + " AS t, "
        + _text("CAST(NULL AS VARCHAR)")
        + " AS e FROM documents)",
    ),
    "usable_payments": (
        usable_payments,
        sql(
            f"SELECT * FROM ({_RAW_USABLE}) WHERE transaction_id <> '' AND to_account <> '' AND ts_us IS NOT NULL "
            "AND amount_paid IS NOT NULL AND payment_format <> ''",
            "raw_ledger",
        ),
    ),
    "usable_transfers": (
        usable_transfers,
        sql(
            f"SELECT transaction_id, ts_us, from_account, to_account FROM ({_RAW_USABLE}) "
            "WHERE transaction_id <> '' AND to_account <> '' AND ts_us IS NOT NULL",
            "raw_ledger",
        ),
    ),
    "parsed_timestamps": (
        parsed_timestamps,
        sql(f"SELECT from_account, timestamp, epoch_us({_PARSED}) AS ts_us FROM raw_ledger", "raw_ledger"),
    ),
    "safe_numbers": (
        safe_numbers,
        sql(
            "SELECT transaction_id, from_account, timestamp, coalesce(TRY_CAST(amount_paid AS DOUBLE), 0) AS amount "
            "FROM raw_ledger",
            "raw_ledger",
        ),
    ),
    "label_guard": (
        label_guard,
        sql(
            "SELECT transaction_id, epoch_us(ts) AS ts_us, from_account, to_account, amount_paid, 9 AS kept_columns "
            "FROM ledger",
            "ledger",
        ),
    ),
    "keyword_events": (
        keyword_events,
        sql(
            "SELECT event_id, action, old_value, new_value FROM (SELECT *, lower(action || ' ' || old_value || ' ' || "
            f"new_value) AS txt FROM access_events) WHERE {_TERM_TEST}",
            "access_events",
        ),
    ),
    "exploded_targets": (exploded_targets, sql("SELECT event_id, account_id, employee_id FROM targets", "targets")),
    "payment_roles": (
        payment_roles,
        sql(
            "SELECT transaction_id, CASE WHEN from_account = 'A7' AND to_account = 'A7' THEN 'self' "
            "WHEN from_account = 'A7' THEN 'sender' WHEN to_account = 'A7' THEN 'receiver' ELSE 'unrelated' END AS "
            "role_of_a7, CASE WHEN from_account = to_account THEN 'self' ELSE 'sender' END AS role_of_sender FROM ledger",
            "ledger",
        ),
    ),
    "scenario_labels": (
        scenario_labels,
        sql(
            "SELECT scenario_id, account_id, CASE WHEN scenario_type = 'suspicious' THEN 1 ELSE 0 END AS label "
            "FROM scenario_accounts WHERE pos = 1",
            "scenario_accounts",
        ),
    ),
    "ordinal_codes": (
        ordinal_codes,
        sql(
            "SELECT customer_id AS account_id, CASE risk_rating WHEN 'Low' THEN 0 WHEN 'Medium' THEN 1 ELSE 2 "
            "END::DOUBLE AS risk_rating_encoded, dense_rank() OVER (ORDER BY country)::DOUBLE AS country_encoded "
            "FROM customers",
            "customers",
        ),
    ),
    "unified_ledger": (
        unified_ledger,
        sql("SELECT transaction_id, from_account, to_account, amount_paid, scenario_id FROM ledger", "ledger"),
    ),
    "scoped_accounts": (
        scoped_accounts,
        sql(
            "SELECT account_id FROM targets UNION SELECT account_id FROM scenario_accounts UNION SELECT from_account "
            "FROM injected UNION SELECT to_account FROM injected UNION SELECT customer_id FROM emp_map UNION SELECT "
            "customer_id FROM profile_changes",
            "targets", "scenario_accounts", "injected", "emp_map", "profile_changes",
        ),
    ),
    "external_counterparties": (
        external_counterparties,
        sql(
            "(SELECT from_account AS account_id FROM trade UNION SELECT to_account FROM trade) "
            "EXCEPT SELECT from_account FROM ledger",
            "trade", "ledger",
        ),
    ),
    "shared_keys": (
        shared_keys,
        sql("SELECT account_id FROM targets INTERSECT SELECT from_account FROM ledger", "targets", "ledger"),
    ),
    "merged_sources": (
        merged_sources,
        sql(
            "SELECT transaction_id, amount_paid, CASE WHEN is_synthetic THEN 'injected' ELSE 'bank' END AS "
            "source_dataset, CASE WHEN is_synthetic THEN 'injected_transaction' ELSE 'real_transaction' END AS "
            "record_type FROM ledger",
            "ledger",
        ),
    ),
    "unique_relationships": (
        unique_relationships,
        "SELECT employee_id, customer_id, o_orderkey, o_orderpriority FROM (SELECT 'E' || (o_custkey % 5) AS "
        "employee_id, 'A' || (o_custkey % 150) AS customer_id, o_orderkey, o_orderpriority, row_number() OVER "
        "(PARTITION BY o_custkey % 5, o_custkey % 150 ORDER BY o_orderkey) AS rn FROM orders) WHERE rn = 1",
    ),
}
