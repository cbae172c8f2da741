"""The same domain tables as SQL, to write check queries with."""

from __future__ import annotations

# Every relation below is read from the driver's own tables.
RELATIONS = {
    "ev": (
        (),
        "SELECT event_id, ts, user_id, event_type, value, "
        "CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
    ),
    "ledger": (
        ("ev",),
        """SELECT CAST(event_id AS VARCHAR) AS transaction_id, ts, CAST(user_id % 10 AS INTEGER) AS from_bank,
            'A' || user_id AS from_account, CAST(k % 10 AS INTEGER) AS to_bank, 'A' || k AS to_account,
            value AS amount_paid, CASE WHEN event_id % 4 = 0 THEN 'Euro' ELSE 'US Dollar' END AS payment_currency,
            CASE event_type WHEN 'click' THEN 'ACH' WHEN 'view' THEN 'Wire' WHEN 'purchase' THEN 'Cheque'
                WHEN 'signup' THEN 'Credit Card' ELSE 'Cash' END AS payment_format,
            CAST(event_id % 50 = 0 AS INTEGER) AS is_laundering, event_id % 10 = 0 AS is_synthetic,
            CASE WHEN event_id % 10 = 0 THEN 'S' || ((event_id // 20) * 2) END AS scenario_id FROM ev""",
    ),
    "real_tx": (("ledger",), "SELECT * FROM ledger WHERE NOT is_synthetic"),
    "injected": (("ledger",), "SELECT * FROM ledger WHERE is_synthetic"),
    "raw_ledger": (
        ("ev",),
        """SELECT event_id, CASE WHEN event_id % 13 = 0 THEN '  ' ELSE ' ' || event_id END AS transaction_id,
            CASE WHEN event_id % 17 = 0 THEN 'not a time'
                WHEN event_id % 3 = 0 THEN strftime(ts, '%Y/%m/%d %H:%M')
                WHEN event_id % 3 = 1 THEN strftime(ts, '%Y-%m-%d %H:%M:%S')
                ELSE strftime(ts, '%Y-%m-%d %H:%M') END AS timestamp,
            'A' || user_id || chr(160) AS from_account,
            CASE WHEN event_id % 19 = 0 THEN NULL ELSE 'A' || k END AS to_account,
            CASE WHEN event_id % 11 = 0 THEN 'n/a' ELSE CAST(value AS VARCHAR) END AS amount_paid,
            CASE WHEN event_id % 23 = 0 THEN '' ELSE event_type END AS payment_format FROM ev""",
    ),
    "trade": (
        (),
        """SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS transaction_id,
            l_shipdate AS ts, 'A' || o_custkey AS from_account, 'A' || l_suppkey AS to_account,
            l_extendedprice AS amount_paid FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    ),
    "access_events": (
        ("ev",),
        """SELECT 'EVT_' || event_id AS event_id, 'E' || (user_id % 5) AS employee_id,
            CASE event_id % 3 WHEN 0 THEN 'grant' WHEN 1 THEN 'modify' ELSE 'revoke' END AS action,
            CASE WHEN event_id % 7 = 0 THEN 'A' || (k % 20) || '; A' || ((k + 1) % 20)
                ELSE 'A' || (k % 20) END AS target_account_id,
            CASE WHEN event_id % 3 = 1 THEN 'transfer_limit=' || k ELSE '' END AS old_value,
            CASE event_id % 4 WHEN 0 THEN 'wire_transfer' WHEN 1 THEN 'api_access' WHEN 2 THEN 'address'
                ELSE 'phone' END AS new_value,
            date_trunc('hour', ts) AS ts FROM ev WHERE event_type IN ('signup', 'error')""",
    ),
    "targets": (
        ("access_events",),
        """SELECT a.*, trim(t.x) AS account_id FROM access_events a,
            unnest(string_split(target_account_id, ';')) AS t(x) WHERE trim(t.x) <> ''""",
    ),
    "profile_changes": (
        ("ev",),
        """SELECT 'CHG_' || event_id AS change_id, 'A' || (k % 20) AS customer_id,
            CASE event_id % 5 WHEN 0 THEN 'spending_limit' WHEN 1 THEN 'risk_rating' WHEN 2 THEN 'phone'
                WHEN 3 THEN 'wire_transfer_limit' ELSE 'address' END AS field_changed,
            'E' || (user_id % 5) AS changed_by_employee_id, date_trunc('hour', ts) AS ts
            FROM ev WHERE event_type = 'click'""",
    ),
    "customers": (
        (),
        """SELECT 'A' || c_custkey AS customer_id, c_name AS name, n_name AS country, 'A' || c_custkey AS account_ids,
            CASE WHEN c_acctbal < 1000 THEN 'High' WHEN c_acctbal < 5000 THEN 'Medium' ELSE 'Low' END AS risk_rating
            FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    ),
    "employees": (
        (),
        """SELECT 'E' || s_suppkey AS employee_id, s_name AS name,
            CASE s_nationkey % 5 WHEN 0 THEN 'Teller' WHEN 1 THEN 'Manager' WHEN 2 THEN 'Analyst'
                WHEN 3 THEN 'Auditor' ELSE 'Admin' END AS role,
            CASE s_nationkey % 2 WHEN 0 THEN 'Retail' ELSE 'Risk' END AS department FROM supplier""",
    ),
    "emp_map": (
        (),
        """SELECT DISTINCT 'E' || (o_custkey % 5) AS employee_id, 'A' || (o_custkey % 150) AS customer_id,
            CASE o_orderpriority WHEN '1-URGENT' THEN 'approver' WHEN '2-HIGH' THEN 'account_manager'
                ELSE 'reviewer' END AS relationship_type FROM orders""",
    ),
    "scenarios": (
        (),
        """SELECT 'S' || doc_id AS scenario_id,
            CASE WHEN quality = 0 THEN 'suspicious' ELSE 'legitimate' END AS scenario_type,
            CASE WHEN doc_id % 3 = 0 THEN 'A' || (doc_id % 150) || '; A' || ((doc_id + 1) % 150)
                ELSE 'A' || (doc_id % 150) END AS account_id,
            'E' || (doc_id % 5) AS employee_id,
            'EVT_' || (doc_id * 10 + 1) || ';EVT_' || (doc_id * 10 + 3) AS related_event_ids,
            CASE WHEN doc_id % 5 = 0 THEN CASE WHEN doc_id % 10 = 0 THEN '' || (doc_id * 10) ELSE '' END
                ELSE (doc_id * 10) || ',' || (doc_id * 10 + 10) END AS related_transaction_ids,
            doc_id % 5 <> 0 AS has_transactional_consequence,
            CASE doc_id % 4 WHEN 0 THEN 'privilege_change,transaction_splitting' WHEN 1 THEN 'circular_transfer'
                WHEN 2 THEN 'velocity_anomaly,privilege_change' ELSE '' END AS expected_signals FROM labels""",
    ),
    "scenario_accounts": (
        ("scenarios",),
        """SELECT s.scenario_id, s.scenario_type, trim(t.x) AS account_id, t.i AS pos FROM scenarios s,
            unnest(string_split(account_id, ';')) WITH ORDINALITY AS t(x, i) WHERE trim(t.x) <> ''""",
    ),
    # One row per payment and account it touches; a self-transfer gives one row.
    "touch": (
        ("ledger",),
        """SELECT from_account AS account_id, CASE WHEN from_account = to_account THEN 'self' ELSE 'sender' END AS
            account_role, l.* FROM ledger l
            UNION ALL SELECT to_account, 'receiver', l.* FROM ledger l WHERE from_account <> to_account""",
    ),
}


def sql(body: str, *needed: str, recursive: bool = False, **extra: str) -> str:
    """``body`` preceded by the relations it names, in dependency order, then ``extra`` ones."""
    order: list[str] = []

    def add(name: str) -> None:
        if name in order:
            return
        for other in RELATIONS[name][0]:
            add(other)
        order.append(name)

    for name in needed:
        add(name)
    parts = [f"{n} AS ({RELATIONS[n][1]})" for n in order]
    parts += [f"{n} AS ({text})" for n, text in extra.items()]
    head = "WITH RECURSIVE " if recursive else "WITH "
    return (head + ",\n".join(parts) + "\n" if parts else "") + body
