"""Column types of the base tables.  Every id is a string."""

from __future__ import annotations

LEDGER = (
    "transaction_id string, timestamp string, from_bank int, from_account string, to_bank int, "
    "to_account string, amount_received double, receiving_currency string, amount_paid double, "
    "payment_currency string, payment_format string, is_laundering int"
)

TABLES = {
    "transactions_clean": (LEDGER),
    "injected_transactions": (LEDGER + ", source string, scenario_id string"),
    "employees": (
        "employee_id string, name string, role string, department string, hire_date date, access_level string"
    ),
    "access_events": (
        "event_id string, employee_id string, action string, target_account_id string, old_value string, "
        "new_value string, timestamp string, scenario_type string, scenario_id string"
    ),
    "profile_changes": (
        "change_id string, customer_id string, field_changed string, old_value string, new_value string, "
        "changed_by_employee_id string, timestamp string"
    ),
    "employee_customer_map": ("employee_id string, customer_id string, relationship_type string"),
    "labeled_scenarios": (
        "scenario_id string, scenario_type string, account_id string, employee_id string, description string, "
        "related_event_ids string, related_transaction_ids string, has_transactional_consequence boolean, "
        "expected_signals string"
    ),
    "accounts": (
        "account_id string, linked_customer_id string, bank_id int, first_seen_timestamp string, "
        "last_seen_timestamp string, real_txn_count bigint, synthetic_txn_count bigint, "
        "total_transaction_count bigint, background_real_laundering_count bigint"
    ),
    "customers": (
        "customer_id string, name string, country string, account_ids string, risk_rating string"
    ),
    "nodes": ("node_id string, node_type string, label string"),
    "edges": ("source_id string, target_id string, edge_type string, timestamp string, metadata string"),
    "alert_patterns": (
        "alert_id string, alert_type string, num_accounts int, num_transactions int, total_amount double, "
        "start_time timestamp, end_time timestamp, is_sar int"
    ),
    "alert_members": ("alert_id string, account_id string, role_in_pattern string"),
}
