"""Queries over entity tables, joins and account features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import entities, features, history
from ..session import materialize
from .oracle import sql
from .table_queries import ts_us

# The amounts of the event ledger are small, so the reporting boundary of the queries is too.
BOUNDARY = 5.0


def rounded(df, digits=6):
    """Round doubles, so that sums taken in another order compare equal.

    The tiny shift moves values off the rounding boundary (means of cents often lie on it).
    """
    return df.select([F.round(F.col(c) + 1e-9, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def r6(*names, digits=6):
    return ", ".join(f"round({n} + 1e-9::DOUBLE, {digits}) AS {n}" for n in names)


def accounts(s):
    customers = entities.scoped_customers(s.employee_map(), s.profile_changes())
    scope = entities.scoped_accounts(s.access_events(), s.scenarios(), s.injected(), customers)
    return entities.build_accounts(s.real(), s.injected(), scope, customers)


def stored_accounts(s):
    """The account table, written once: the feature groups all start from it."""
    return materialize(accounts(s), "accounts")


ACCOUNTS = {
    "cust": "SELECT customer_id FROM emp_map UNION SELECT customer_id FROM profile_changes",
    "scope": "SELECT account_id FROM targets UNION SELECT account_id FROM scenario_accounts UNION SELECT from_account "
    "FROM injected UNION SELECT to_account FROM injected UNION SELECT customer_id FROM cust",
    "stats": """SELECT account_id,
        coalesce(arg_min(from_bank, (ts, from_bank)) FILTER (NOT is_synthetic AND account_role <> 'receiver'),
            arg_min(to_bank, (ts, to_bank)) FILTER (NOT is_synthetic AND account_role <> 'sender'),
            arg_min(from_bank, (ts, from_bank)) FILTER (is_synthetic AND account_role <> 'receiver'),
            arg_min(to_bank, (ts, to_bank)) FILTER (is_synthetic AND account_role <> 'sender')) AS bank_id,
        min(ts) AS first_seen, max(ts) AS last_seen, count(*) FILTER (NOT is_synthetic) AS real_txn_count,
        count(*) FILTER (is_synthetic) AS synthetic_txn_count, count(*) AS total_transaction_count,
        count(*) FILTER (NOT is_synthetic AND is_laundering = 1) AS background_real_laundering_count
        FROM touch GROUP BY account_id""",
    "accounts": """SELECT s.account_id, c.customer_id AS linked_customer_id, t.bank_id, t.first_seen, t.last_seen,
        coalesce(t.real_txn_count, 0) AS real_txn_count, coalesce(t.synthetic_txn_count, 0) AS synthetic_txn_count,
        coalesce(t.total_transaction_count, 0) AS total_transaction_count,
        coalesce(t.background_real_laundering_count, 0) AS background_real_laundering_count
        FROM scope s LEFT JOIN cust c ON c.customer_id = s.account_id LEFT JOIN stats t ON t.account_id = s.account_id""",
}
ACCOUNT_RELATIONS = ("targets", "scenario_accounts", "injected", "emp_map", "profile_changes", "touch", "customers")

FEATURES = {
    **ACCOUNTS,
    "activity": """SELECT account_id, real_txn_count::DOUBLE AS real_txn_count,
        synthetic_txn_count::DOUBLE AS synthetic_txn_count, total_transaction_count::DOUBLE AS total_transaction_count,
        CASE WHEN linked_customer_id IS NOT NULL THEN 1 ELSE 0 END::DOUBLE AS has_linked_customer,
        coalesce(bank_id, 0)::DOUBLE AS bank_id_encoded, age AS account_age_days, age AS activity_span_days,
        total_transaction_count / (age + 1.0::DOUBLE) AS txn_density,
        synthetic_txn_count::DOUBLE / greatest(total_transaction_count, 1) AS synthetic_fraction
        FROM (SELECT *, coalesce(greatest((epoch_us(last_seen) - epoch_us(first_seen)) / 1e6::DOUBLE / 86400.0::DOUBLE, 0), 0)
        AS age FROM accounts)""",
    "overall": "SELECT avg(amount_paid) AS m, stddev_samp(amount_paid) AS s FROM ledger",
    "sent": f"""SELECT from_account AS account_id, avg(amount_paid) AS mean_amount,
        coalesce(stddev_samp(amount_paid), 0) AS std_amount, max(amount_paid) AS max_amount,
        min(amount_paid) AS min_amount,
        count(*) FILTER (payment_format = 'Wire')::DOUBLE / count(*) AS wire_fraction,
        count(*) FILTER (payment_format = 'ACH')::DOUBLE / count(*) AS ach_fraction,
        count(*) FILTER (payment_currency <> 'US Dollar')::DOUBLE / count(*) AS cross_currency_fraction,
        count(*) FILTER (from_bank <> to_bank)::DOUBLE / count(*) AS cross_bank_ratio,
        count(DISTINCT to_account)::DOUBLE AS unique_counterparties_out, sum(amount_paid) AS total_sent_amount,
        count(*) FILTER (amount_paid < {BOUNDARY})::DOUBLE / count(*) AS sub_threshold_fraction
        FROM ledger GROUP BY 1""",
    "received": """SELECT to_account AS account_id, count(DISTINCT from_account)::DOUBLE AS unique_counterparties_in,
        sum(amount_paid) AS total_received_amount FROM ledger GROUP BY 1""",
    "amounts": """SELECT a.account_id, coalesce(mean_amount, 0) AS mean_amount, coalesce(std_amount, 0) AS std_amount,
        coalesce(max_amount, 0) AS max_amount, coalesce(min_amount, 0) AS min_amount,
        coalesce(wire_fraction, 0) AS wire_fraction, coalesce(ach_fraction, 0) AS ach_fraction,
        coalesce(cross_currency_fraction, 0) AS cross_currency_fraction, coalesce(cross_bank_ratio, 0) AS cross_bank_ratio,
        coalesce(unique_counterparties_out, 0) AS unique_counterparties_out,
        coalesce(unique_counterparties_in, 0) AS unique_counterparties_in,
        coalesce(total_sent_amount, 0) AS total_sent_amount, coalesce(total_received_amount, 0) AS total_received_amount,
        coalesce(sub_threshold_fraction, 0) AS sub_threshold_fraction,
        coalesce(std_amount, 0) / (coalesce(mean_amount, 0) + 1e-6::DOUBLE) AS amount_cv,
        coalesce(unique_counterparties_out, 0) / greatest(total_transaction_count, 1) AS counterparty_diversity,
        (coalesce(max_amount, 0) - m) / s AS max_amount_zscore
        FROM accounts a LEFT JOIN sent USING (account_id) LEFT JOIN received USING (account_id), overall""",
    "access": """SELECT a.account_id, coalesce(n, 0)::DOUBLE AS access_event_count, coalesce(mo, 0)::DOUBLE AS modify_count,
        coalesce(re, 0)::DOUBLE AS revoke_count, coalesce(gr, 0)::DOUBLE AS grant_count,
        coalesce(em, 0)::DOUBLE AS unique_employee_accessors,
        coalesce(n, 0) / (account_age_days + 1.0::DOUBLE) AS access_event_rate FROM activity a LEFT JOIN (
        SELECT target_account_id AS account_id, count(*) AS n, count(*) FILTER (action = 'modify') AS mo,
        count(*) FILTER (action = 'revoke') AS re, count(*) FILTER (action = 'grant') AS gr,
        count(DISTINCT employee_id) AS em FROM access_events GROUP BY 1) USING (account_id)""",
    "profile": """SELECT a.account_id, coalesce(n, 0)::DOUBLE AS profile_change_count,
        coalesce(hi, 0)::DOUBLE AS high_risk_field_change_count, coalesce(li, 0)::DOUBLE AS limit_field_change_count,
        coalesce(em, 0)::DOUBLE AS unique_profile_change_employees,
        coalesce(n, 0) / (account_age_days + 1.0::DOUBLE) AS profile_change_rate FROM activity a LEFT JOIN (
        SELECT customer_id AS account_id, count(*) AS n, count(*) FILTER (field_changed IN ('spending_limit',
        'wire_transfer_limit', 'risk_rating', 'beneficial_owner', 'account_type')) AS hi,
        count(*) FILTER (field_changed IN ('spending_limit', 'wire_transfer_limit')) AS li,
        count(DISTINCT changed_by_employee_id) AS em FROM profile_changes GROUP BY 1) USING (account_id)""",
    "staff": """SELECT a.account_id, coalesce(n, 0)::DOUBLE AS managing_employee_count,
        coalesce(ap, 0)::DOUBLE AS has_approver, coalesce(am, 0)::DOUBLE AS has_account_manager
        FROM accounts a LEFT JOIN (SELECT customer_id AS account_id, count(DISTINCT employee_id) AS n,
        max(CAST(relationship_type = 'approver' AS INTEGER)) AS ap,
        max(CAST(relationship_type = 'account_manager' AS INTEGER)) AS am FROM emp_map GROUP BY 1) USING (account_id)""",
    "custf": """SELECT a.account_id, coalesce(CASE risk_rating WHEN 'Low' THEN 0 WHEN 'Medium' THEN 1 WHEN 'High' THEN 2
        END, 0)::DOUBLE AS risk_rating_encoded, coalesce(code, 0)::DOUBLE AS country_encoded FROM accounts a
        LEFT JOIN (SELECT customer_id, risk_rating, dense_rank() OVER (ORDER BY country) AS code FROM customers) c
        ON c.customer_id = a.linked_customer_id""",
}
FEATURE_RELATIONS = ACCOUNT_RELATIONS + ("ledger", "access_events")


def account_table(s):
    return accounts(s).withColumns(
        {"first_seen": F.unix_micros("first_seen"), "last_seen": F.unix_micros("last_seen")}
    )


def activity_features(s):
    return rounded(features.activity_features(accounts(s)))


def amount_features(s):
    return rounded(features.amount_features(s.ledger(), accounts(s), BOUNDARY))


def access_features(s):
    return rounded(features.access_features(s.access_events(), features.activity_features(accounts(s))))


def profile_features(s):
    return rounded(features.profile_features(s.profile_changes(), features.activity_features(accounts(s))))


def staff_features(s):
    return features.staff_features(s.employee_map(), accounts(s))


def customer_features(s):
    return features.customer_features(s.customers(), accounts(s))


def matrix(s, rule_results=None):
    return features.feature_matrix(
        stored_accounts(s), s.ledger(), s.access_events(), s.profile_changes(), s.employee_map(), s.customers(),
        rule_results, BOUNDARY,
    )


def feature_matrix(s):
    return rounded(matrix(s))


def signal_features(s):
    return rounded(features.select_features(matrix(s), features.SIGNAL_FEATURES))


def labeled_dataset(s):
    return rounded(features.labeled_rows(matrix(s), s.scenarios(), features.SIGNAL_FEATURES))


def background_split(s):
    background, evaluation = features.split_background(
        features.activity_features(accounts(s)), s.scenarios().filter(F.col("scenario_type") == "suspicious")
    )
    return background.select("account_id", F.lit("background").alias("part")).unionByName(
        evaluation.select("account_id", F.lit("evaluation").alias("part"))
    )


def account_customer(s):
    return accounts(s).join(
        s.customers().withColumnRenamed("customer_id", "linked_customer_id"), "linked_customer_id", "left"
    ).select("account_id", "linked_customer_id", "name", "country", "risk_rating")


def linked_employees(s):
    return history.linked_employees(accounts(s), s.customers(), s.employee_map(), s.employees())


def account_ledger(s):
    return entities.account_payments(s.ledger()).select(
        "account_id", "transaction_id", ts_us(), "account_role", "is_synthetic"
    )


def account_access_events(s):
    return history.account_access_events(s.access_events()).select("account_id", "event_id", "employee_id", "action")


def employee_roster(s):
    raw = s.employees().withColumn("employee_id", F.concat(F.lit("E"), F.substring("employee_id", 2, 1)))
    return history.last_record(raw, "employee_id", [F.col("name")]).select("employee_id", "name", "role")


def history_summary(s):
    return history.history_summary(
        stored_accounts(s), s.ledger(), s.access_events(), s.profile_changes(), s.employee_map(), s.customers()
    )


def reconciliation(s):
    return history.reconcile(accounts(s), s.ledger())


def account_history(s):
    return history.account_history(
        stored_accounts(s), s.ledger(), s.access_events(), s.profile_changes(), s.customers(), s.employee_map(), s.employees()
    ).withColumn("ts", F.unix_micros("ts"))


def ledger_preview(s):
    return history.ledger_preview(s.ledger()).select("account_id", "transaction_id", "account_role", "is_synthetic", ts_us())


_LINKED = """SELECT a.account_id, m.employee_id, m.relationship_type, e.name, e.role FROM accounts a
    JOIN customers c ON c.customer_id = a.linked_customer_id
    JOIN emp_map m ON m.customer_id = a.linked_customer_id LEFT JOIN employees e ON e.employee_id = m.employee_id"""

_ACCESS_BY_ACCOUNT = "SELECT DISTINCT account_id, event_id, employee_id, action, ts FROM targets"

_SUMMARY = """SELECT a.account_id, c.customer_id IS NOT NULL AS has_linked_customer,
    coalesce(l.n, 0) AS linked_employee_count, coalesce(v.n, 0) AS access_event_count,
    coalesce(p.n, 0) AS profile_change_count, coalesce(t.n, 0) AS total_transactions,
    coalesce(t.syn, 0) AS synthetic_transactions, coalesce(t.n - t.syn, 0) AS real_transactions,
    coalesce(t.se, 0) AS sender_count, coalesce(t.re, 0) AS receiver_count, coalesce(t.sf, 0) AS self_count
    FROM accounts a LEFT JOIN customers c ON c.customer_id = a.linked_customer_id
    LEFT JOIN (SELECT account_id, count(*) AS n FROM linked GROUP BY 1) l USING (account_id)
    LEFT JOIN (SELECT account_id, count(*) AS n FROM aev GROUP BY 1) v USING (account_id)
    LEFT JOIN (SELECT customer_id, count(*) AS n FROM profile_changes GROUP BY 1) p ON p.customer_id = a.linked_customer_id
    LEFT JOIN (SELECT account_id, count(*) AS n, count(*) FILTER (is_synthetic) AS syn,
        count(*) FILTER (account_role = 'sender') AS se, count(*) FILTER (account_role = 'receiver') AS re,
        count(*) FILTER (account_role = 'self') AS sf FROM touch GROUP BY 1) t ON t.account_id = a.account_id"""

_HISTORY = """SELECT account_id, record_type, record_id, epoch_us(ts) AS ts, detail,
    row_number() OVER (PARTITION BY account_id ORDER BY ts NULLS FIRST, record_type, record_id) AS position FROM (
    SELECT account_id, 'transaction' AS record_type, transaction_id AS record_id, ts, account_role AS detail FROM touch
        WHERE account_id IN (SELECT account_id FROM accounts)
    UNION ALL SELECT account_id, 'access_event', event_id, ts, action FROM aev
        WHERE account_id IN (SELECT account_id FROM accounts)
    UNION ALL SELECT a.account_id, 'profile_change', change_id, ts, field_changed FROM profile_changes p
        JOIN accounts a ON a.linked_customer_id = p.customer_id
    UNION ALL SELECT account_id, 'employee', employee_id || ':' || relationship_type, NULL, name FROM linked)"""

_PREVIEW = """SELECT account_id, transaction_id, account_role, is_synthetic, epoch_us(ts) AS ts_us FROM (
    SELECT *, row_number() OVER (PARTITION BY account_id, account_role ORDER BY ts, transaction_id) AS rn FROM touch)
    WHERE is_synthetic OR account_role = 'receiver' OR (account_role = 'sender' AND rn <= 10)
    OR (account_role = 'self' AND rn <= 3)"""

ALL_FEATURES = (
    "activity JOIN amounts USING (account_id) JOIN access USING (account_id) JOIN profile USING (account_id) "
    "JOIN staff USING (account_id) JOIN custf USING (account_id)"
)
_G = features.FEATURE_GROUPS


def _features(body):
    return sql(body, *FEATURE_RELATIONS, **FEATURES)


MATRIX_COLUMNS = [c for g in ("activity", "amounts", "access", "profile", "staff", "customer") for c in _G[g]]

QUERIES = {
    "account_table": (
        account_table,
        sql(
            "SELECT * REPLACE (epoch_us(first_seen) AS first_seen, epoch_us(last_seen) AS last_seen) FROM accounts",
            *ACCOUNT_RELATIONS, **ACCOUNTS,
        ),
    ),
    "activity_features": (activity_features, _features(f"SELECT account_id, {r6(*_G['activity'])} FROM activity")),
    "amount_features": (amount_features, _features(f"SELECT account_id, {r6(*_G['amounts'])} FROM amounts")),
    "access_features": (access_features, _features(f"SELECT account_id, {r6(*_G['access'])} FROM access")),
    "profile_features": (profile_features, _features(f"SELECT account_id, {r6(*_G['profile'])} FROM profile")),
    "staff_features": (staff_features, _features("SELECT * FROM staff")),
    "customer_features": (customer_features, _features("SELECT * FROM custf")),
    "feature_matrix": (feature_matrix, _features(f"SELECT account_id, {r6(*MATRIX_COLUMNS)} FROM {ALL_FEATURES}")),
    "signal_features": (
        signal_features, _features(f"SELECT account_id, {r6(*features.SIGNAL_FEATURES)} FROM {ALL_FEATURES}")
    ),
    "labeled_dataset": (
        labeled_dataset,
        sql(
            "SELECT scenario_id, scenario_type, employee_id, account_id, CASE WHEN scenario_type = 'suspicious' THEN 1 "
            f"ELSE 0 END AS label, {r6(*features.SIGNAL_FEATURES)} FROM scenario_accounts JOIN (SELECT scenario_id, "
            f"employee_id FROM scenarios) USING (scenario_id) JOIN ({'SELECT * FROM ' + ALL_FEATURES}) USING (account_id) "
            "WHERE pos = 1",
            *FEATURE_RELATIONS, **FEATURES,
        ),
    ),
    "background_split": (
        background_split,
        sql(
            "SELECT account_id, CASE WHEN account_id IN (SELECT account_id FROM scenario_accounts WHERE pos = 1 AND "
            "scenario_type = 'suspicious') THEN 'evaluation' ELSE 'background' END AS part FROM accounts",
            *ACCOUNT_RELATIONS, **ACCOUNTS,
        ),
    ),
    "account_customer": (
        account_customer,
        sql(
            "SELECT account_id, linked_customer_id, name, country, risk_rating FROM accounts a LEFT JOIN customers c "
            "ON c.customer_id = a.linked_customer_id",
            *ACCOUNT_RELATIONS, **ACCOUNTS,
        ),
    ),
    "linked_employees": (linked_employees, sql(_LINKED, *ACCOUNT_RELATIONS, "employees", **ACCOUNTS)),
    "account_ledger": (
        account_ledger,
        sql(
            "SELECT account_id, transaction_id, epoch_us(ts) AS ts_us, account_role, is_synthetic FROM touch", "touch"
        ),
    ),
    "account_access_events": (
        account_access_events,
        sql(f"SELECT account_id, event_id, employee_id, action FROM ({_ACCESS_BY_ACCOUNT})", "targets"),
    ),
    "employee_roster": (
        employee_roster,
        sql(
            "SELECT employee_id, name, role FROM (SELECT 'E' || substr(employee_id, 2, 1) AS employee_id, name, role, "
            "row_number() OVER (PARTITION BY substr(employee_id, 2, 1) ORDER BY name DESC) AS rn FROM employees) "
            "WHERE rn = 1",
            "employees",
        ),
    ),
    "history_summary": (
        history_summary,
        sql(_SUMMARY, *ACCOUNT_RELATIONS, "employees", **ACCOUNTS, linked=_LINKED, aev=_ACCESS_BY_ACCOUNT),
    ),
    "reconciliation": (
        reconciliation,
        sql(
            "SELECT account_id, total_transaction_count AS account_total, coalesce(n, 0) AS ledger_total, "
            "real_txn_count = coalesce(n - syn, 0) AND synthetic_txn_count = coalesce(syn, 0) AND "
            "total_transaction_count = coalesce(n, 0) AS reconciled FROM accounts LEFT JOIN (SELECT account_id, "
            "count(*) AS n, count(*) FILTER (is_synthetic) AS syn FROM touch GROUP BY 1) USING (account_id)",
            *ACCOUNT_RELATIONS, **ACCOUNTS,
        ),
    ),
    "account_history": (
        account_history,
        sql(_HISTORY, *ACCOUNT_RELATIONS, "employees", **ACCOUNTS, linked=_LINKED, aev=_ACCESS_BY_ACCOUNT),
    ),
    "ledger_preview": (ledger_preview, sql(_PREVIEW, "touch")),
}
