"""Queries over detection rules and pattern detectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cycles, features, rule_config, rules, skew, windows
from ..operators.entities import explode_ids
from ..session import materialize
from .feature_queries import ACCOUNT_RELATIONS, ACCOUNTS, BOUNDARY, stored_accounts
from .oracle import sql
from .table_queries import TERMS

# Settings of the registered queries: a boundary that suits the small amounts of the ledger.
CONFIG = {
    rule_config.SPLITTING: {"below_reporting_boundary": BOUNDARY},
    rule_config.CIRCULAR: {},
    rule_config.PRIVILEGE_CHANGE: {},
}
FAN_HOURS, FAN_MINIMUM = 24, 5


def context(s):
    return {
        "payments": s.ledger(),
        "access_events": s.access_events(),
        "profile_changes": s.profile_changes(),
        "employees": s.employees(),
    }


def rule_results(s, with_evidence=False):
    """``(results, evidence)`` of all rules; a rule that fails is an error here, as nobody reads the failures."""
    return rules.run_rules(rules.default_registry(), context(s), CONFIG, with_evidence, isolate=False)[:2]


def splitting_windows(s):
    found = windows.splitting_windows(s.ledger(), 48, 3, BOUNDARY)
    return found.select(
        "from_account", "transaction_id", "outgoing_transaction_count", "below_count",
        F.unix_micros("window_start").alias("start_us"), F.unix_micros("window_end").alias("end_us"),
    )


def splitting_members(s):
    """Payments inside the 7-day splitting windows of the day-grain trade ledger, written once for both uses."""
    ledger = materialize(s.trade_ledger(), "trade")
    found = windows.splitting_windows(ledger, 24 * 7, 3, 10000.0)
    ordered = skew.positions(
        ledger.select("from_account", "transaction_id", "ts"), ["from_account"], [F.col("ts"), F.col("transaction_id")]
    )
    return windows.window_members(found, ordered).select(
        "window_id", "from_account", "transaction_id", F.col("member_number").cast("bigint").alias("member_number")
    )


def privilege_results(s):
    out = rules.privilege_change(context(s), {}).results
    return out.select(
        "result_key", "employee_id", "account_id", F.col("record_count"),
        out.metrics["paired_profile_change_count"].cast("bigint").alias("pairs"), "explanation",
        F.unix_micros("window_start").alias("ts_us"),
    )


def paired_changes(s):
    config = rule_config.PrivilegeConfig.from_mapping({})
    pairs = rules.paired_changes(
        rules.privilege_events(s.access_events(), config), rules.qualifying_changes(s.profile_changes(), config), config
    )
    return pairs.select("event_id", "account_id", "employee_id", "change_id", "field_changed")


def circular_results(s):
    found = cycles.circular_transfers(s.ledger(), 48, 3)
    return found.select(
        "account_id", F.array_join("transaction_ids", ";").alias("ids"), F.array_join("accounts", ";").alias("accounts"),
        F.col("transaction_count").cast("bigint").alias("n"), F.unix_micros("window_start").alias("start_us"),
        F.unix_micros("window_end").alias("end_us"),
    )


def payment_chains(s):
    return cycles.payment_chains(s.ledger(), 48)


def explanations(s):
    out = rules.transaction_splitting(context(s), CONFIG[rule_config.SPLITTING]).results
    return out.select("result_key", "explanation")


def rule_run(s):
    registry = rules.default_registry()

    def broken(tables, settings):
        raise RuntimeError("this rule cannot run")

    registry.register(rules.Rule("TEST.BROKEN", "Broken rule", "AML", broken))
    results, _, failures = rules.run_rules(registry, context(s), CONFIG, with_evidence=False, isolate=["TEST.BROKEN"])
    counted = results.groupBy("rule_id").agg(F.count(F.lit(1)).alias("results"))
    return counted.withColumn("error_type", F.lit(None).cast("string")).unionByName(
        failures.select("rule_id", F.lit(0).cast("bigint").alias("results"), "error_type")
    )


def rule_union(s):
    results, _ = rule_results(s)
    return results.select("rule_id", "account_id", "entity_type", "entity_id", "employee_id", "record_count")


def unique_results(s):
    results, _ = rule_results(s)
    return rules.unique_results(results.unionByName(results)).groupBy("rule_id", "account_id").agg(
        F.count(F.lit(1)).alias("results")
    )


def rule_evidence(s):
    _, evidence = rule_results(s, with_evidence=True)
    return evidence.groupBy("rule_id", "record_type", "role").agg(F.count(F.lit(1)).alias("records"))


def _overlapping(s):
    """Raw payment tables with bad rows, repeated ids and ids of both tables, in order of priority."""
    raw = s.ledger().select(
        "transaction_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), "from_account", "to_account",
        F.col("amount_paid").cast("string").alias("amount_paid"), "payment_format", "is_synthetic",
    )
    number = F.col("transaction_id").cast("bigint")
    bad = raw.withColumns(
        {
            "amount_paid": F.when(number % 11 == 3, "n/a").otherwise(F.col("amount_paid")),
            "from_account": F.when(number % 13 == 5, " ").otherwise(F.col("from_account")),
        }
    )
    later = raw.filter(number % 3 == 0).withColumn("amount_paid", F.lit("1.0"))
    return [("injected", "synthetic", raw.filter("is_synthetic")), ("bank", "real", bad), ("copy", "real", later)]


def prepared_rule_run(s):
    payments = materialize(rules.merged_payments(_overlapping(s)), "merged")
    only = {rule_config.PRIVILEGE_CHANGE: {"enabled": False}, rule_config.CIRCULAR: {"enabled": False}}
    tables = {**context(s), "payments": payments}
    _, evidence, _ = rules.run_rules(rules.default_registry(), tables, {**CONFIG, **only}, isolate=False)
    return evidence.groupBy("result_key", "source_dataset", "record_type").agg(F.count(F.lit(1)).alias("records"))


def results_in_scope(s):
    out = rules.privilege_change(context(s), {}).results
    parts = (
        ("account", rules.in_scope(out, account_id="A3")),
        ("employee", rules.in_scope(out, employee_id="E2")),
        ("entity", rules.in_scope(out, entity_id="E4")),
        ("both", rules.in_scope(out, account_id="A3", employee_id="E2")),
    )
    found = None
    for name, df in parts:
        one = df.select(F.lit(name).alias("scope"), "result_key", "account_id", "employee_id")
        found = one if found is None else found.unionByName(one)
    return found


def rule_flags(s):
    results, _ = rule_results(s)
    return features.rule_features(results, stored_accounts(s))


def fired_rules(s):
    results, _ = rule_results(s)
    return rules.fired_rules(results).select("account_id", F.array_join("fired_rules", ";").alias("fired_rules"), "rule_score")


def fan_out(s):
    return windows.fan_out(s.ledger(), FAN_HOURS, FAN_MINIMUM)


def fan_in(s):
    return windows.fan_in(s.ledger(), FAN_HOURS, FAN_MINIMUM)


def gather_scatter(s):
    return windows.gather_scatter(fan_in(s), fan_out(s), 48)


def pattern_recall(s):
    kinds = ("cycle", "fan_out", "fan_in", "gather_scatter")
    number = F.substring("scenario_id", 2, 20).cast("bigint")
    kind = F.element_at(F.array(*[F.lit(k) for k in kinds]), (number % 4 + 1).cast("int"))
    patterns = s.scenarios().select(F.col("scenario_id").alias("alert_id"), kind.alias("alert_type"))
    members = explode_ids(s.scenarios(), "account_id", "_a").select(
        F.col("scenario_id").alias("alert_id"), F.col("_a").alias("account_id")
    )
    payers, payees = materialize(fan_out(s), "fan_out"), materialize(fan_in(s), "fan_in")
    rings = cycles.circular_transfers(s.ledger(), 48, 3).select(F.explode("accounts").alias("hub"))
    both = windows.gather_scatter(payees, payers, 48)
    detections = None
    for name, df in zip(kinds, (rings, payers, payees, both)):
        one = df.select(F.lit(name).alias("alert_type"), F.col("hub").alias("account_id")).distinct()
        detections = one if detections is None else detections.unionByName(one)
    return windows.pattern_recall(patterns, members, detections)


SPLIT = f"""SELECT from_account, transaction_id, last_rn - rn + 1 AS outgoing_transaction_count,
    CAST(last_below - below + own AS BIGINT) AS below_count, epoch_us(ts) AS start_us, epoch_us(last_ts) AS end_us,
    rn AS first_position, last_rn AS last_position
    FROM (SELECT *, max(rn) OVER w AS last_rn, max(below) OVER w AS last_below, max(ts) OVER w AS last_ts FROM (
        SELECT from_account, transaction_id, ts, CAST(amount_paid < {{boundary}} AS INTEGER) AS own,
        row_number() OVER (PARTITION BY from_account ORDER BY ts, transaction_id) AS rn,
        sum(CAST(amount_paid < {{boundary}} AS INTEGER)) OVER (PARTITION BY from_account ORDER BY ts, transaction_id
            ROWS UNBOUNDED PRECEDING) AS below FROM {{ledger}})
        WINDOW w AS (PARTITION BY from_account ORDER BY ts RANGE BETWEEN CURRENT ROW AND
            INTERVAL {{hours}} HOURS FOLLOWING))
    WHERE last_rn - rn + 1 >= 3 AND last_below - below + own > 0"""

_QUAL = " OR ".join(f"contains(txt, '{t}')" for t in TERMS)
PRIVILEGE = {
    "pe": f"""SELECT event_id, employee_id, action, old_value, new_value, ts, trim(t.x) AS account_id, t.i - 1 AS n
        FROM (SELECT *, lower(action || ' ' || old_value || ' ' || new_value) AS txt FROM access_events) a,
        unnest(string_split(target_account_id, ';')) WITH ORDINALITY AS t(x, i) WHERE ({_QUAL})""",
    "pc": """SELECT change_id, customer_id AS account_id, field_changed, changed_by_employee_id AS employee_id, ts
        FROM profile_changes WHERE field_changed IN ('spending_limit', 'wire_transfer_limit', 'risk_rating',
        'beneficial_owner', 'account_type')""",
    "pairs": "SELECT event_id, n, account_id, employee_id, change_id, field_changed FROM pe JOIN pc USING "
    "(account_id, employee_id, ts)",
    "privilege": """SELECT pe.event_id || ':' || pe.n AS result_key, pe.*, coalesce(p.pairs, 0) AS pairs FROM pe
        LEFT JOIN (SELECT event_id, n, count(*) AS pairs FROM pairs GROUP BY 1, 2) p USING (event_id, n)""",
}
RINGS = {
    "edges": "SELECT transaction_id, from_account, to_account, epoch_us(ts) AS us FROM ledger WHERE from_account <> to_account",
    "paths(origin, start_us, node, last_us, ids, accs)": """
        SELECT from_account, us, to_account, us, [transaction_id], [from_account] FROM edges
        UNION ALL SELECT p.origin, p.start_us, e.to_account, e.us, list_append(p.ids, e.transaction_id),
            list_append(p.accs, p.node) FROM paths p JOIN edges e ON e.from_account = p.node AND e.us >= p.last_us
            AND e.us <= p.start_us + 172800000000 WHERE p.node <> p.origin AND NOT list_contains(p.accs, p.node)""",
    "rings": """SELECT origin AS account_id, array_to_string(ids, ';') AS ids, array_to_string(accs, ';') AS accounts,
        CAST(len(ids) AS BIGINT) AS n, start_us, last_us AS end_us, accs FROM (SELECT *, row_number() OVER (PARTITION BY
            list_concat(ids[list_position(ids, list_min(ids)):], ids[:list_position(ids, list_min(ids)) - 1])
            ORDER BY start_us, ids[1]) AS rn FROM paths WHERE node = origin AND len(ids) >= 3) WHERE rn = 1""",
}
RULE_ROWS = {
    **PRIVILEGE,
    "split": SPLIT.format(boundary=BOUNDARY, ledger="ledger", hours=48),
    **RINGS,
    "results": f"""SELECT '{rule_config.PRIVILEGE_CHANGE}' AS rule_id, account_id, 'Employee' AS entity_type,
        employee_id AS entity_id, employee_id, pairs + 1 AS record_count, result_key FROM privilege
        UNION ALL SELECT '{rule_config.CIRCULAR}', account_id, 'Account', account_id, NULL, n, ids FROM rings
        UNION ALL SELECT '{rule_config.SPLITTING}', from_account, 'Account', from_account, NULL,
        outgoing_transaction_count, transaction_id FROM split""",
}
RULE_RELATIONS = ("ledger", "access_events", "profile_changes", "employees")


def fan_sql(hub, other):
    return f"""SELECT a.{hub} AS hub, a.transaction_id, count(DISTINCT b.{other}) AS counterparties,
        epoch_us(any_value(a.ts)) AS start_us, epoch_us(max(b.ts)) AS end_us FROM ledger a JOIN ledger b
        ON b.{hub} = a.{hub} AND b.ts BETWEEN a.ts AND a.ts + INTERVAL {FAN_HOURS} HOURS
        GROUP BY 1, 2 HAVING count(DISTINCT b.{other}) >= {FAN_MINIMUM}"""


FANS = {
    "fout": fan_sql("from_account", "to_account"),
    "fin": fan_sql("to_account", "from_account"),
    "gs": """SELECT g.hub, g.transaction_id, any_value(g.counterparties) AS senders, any_value(g.start_us) AS gather_start_us,
        any_value(g.end_us) AS gather_end_us, min(o.start_us) AS scatter_start_us FROM fin g JOIN fout o ON o.hub = g.hub
        AND o.start_us > g.end_us GROUP BY 1, 2 HAVING min(o.start_us) - any_value(g.end_us) <= 172800000000""",
}


def _rules(body, *more, **extra):
    return sql(body, *RULE_RELATIONS, *more, recursive=True, **RULE_ROWS, **extra)


QUERIES = {
    "splitting_windows": (
        splitting_windows,
        sql(
            "SELECT from_account, transaction_id, outgoing_transaction_count, below_count, start_us, end_us FROM ("
            + SPLIT.format(boundary=BOUNDARY, ledger="ledger", hours=48) + ")",
            "ledger",
        ),
    ),
    "splitting_members": (
        splitting_members,
        sql(
            "SELECT w.transaction_id AS window_id, m.from_account, m.transaction_id, m.rn - w.first_position + 1 AS "
            "member_number FROM w JOIN (SELECT from_account, transaction_id, row_number() OVER (PARTITION BY "
            "from_account ORDER BY ts, transaction_id) AS rn FROM trade) m ON m.from_account = w.from_account "
            "AND m.rn BETWEEN w.first_position AND w.last_position",
            "trade",
            w=SPLIT.format(boundary=10000.0, ledger="trade", hours=168),
        ),
    ),
    "privilege_results": (
        privilege_results,
        sql(
            "SELECT result_key, p.employee_id, account_id, pairs + 1 AS record_count, pairs, 'Employee ' || "
            "coalesce(e.name || ' (' || p.employee_id || ')', p.employee_id) || ' performed administrative action ''' || "
            "action || ''' on account ' || account_id || ': ''' || old_value || ''' -> ''' || new_value || '''.' AS "
            "explanation, epoch_us(ts) AS ts_us FROM privilege p LEFT JOIN employees e USING (employee_id)",
            "access_events", "profile_changes", "employees", **PRIVILEGE,
        ),
    ),
    "paired_changes": (
        paired_changes,
        sql(
            "SELECT event_id, account_id, employee_id, change_id, field_changed FROM pairs",
            "access_events", "profile_changes", **PRIVILEGE,
        ),
    ),
    "circular_results": (
        circular_results,
        sql("SELECT account_id, ids, accounts, n, start_us, end_us FROM rings", "ledger", recursive=True, **RINGS),
    ),
    "payment_chains": (
        payment_chains,
        sql(
            "SELECT a.from_account AS origin, b.to_account AS node, a.transaction_id AS first_id, b.transaction_id AS "
            "second_id, b.us - a.us AS span_us FROM e a JOIN e b ON b.from_account = a.to_account AND b.us >= a.us "
            "AND b.us <= a.us + 172800000000 AND b.to_account <> a.from_account",
            "ledger", e=RINGS["edges"],
        ),
    ),
    "rule_explanations": (
        explanations,
        sql(
            "SELECT transaction_id AS result_key, 'Rule AML.TRANSACTION_SPLITTING (Transaction splitting) triggered "
            "because account ' || from_account || ' generated ' || outgoing_transaction_count || ' outgoing transactions "
            "within the configured 48-hour window, including one or more transactions below the configured $5.00 "
            "reporting boundary.' AS explanation FROM (" + SPLIT.format(boundary=BOUNDARY, ledger="ledger", hours=48) + ")",
            "ledger",
        ),
    ),
    "rule_run": (
        rule_run,
        _rules(
            "SELECT rule_id, count(*) AS results, NULL AS error_type FROM results GROUP BY rule_id "
            "UNION ALL SELECT 'TEST.BROKEN', 0, 'RuntimeError'"
        ),
    ),
    "rule_union": (
        rule_union,
        _rules("SELECT rule_id, account_id, entity_type, entity_id, employee_id, record_count FROM results"),
    ),
    "unique_results": (
        unique_results,
        _rules("SELECT rule_id, account_id, count(DISTINCT result_key) AS results FROM results GROUP BY 1, 2"),
    ),
    "rule_evidence": (
        rule_evidence,
        _rules(
            "SELECT 'INSIDER.PRIVILEGE_CHANGE' AS rule_id, 'access_event' AS record_type, 'triggering_access_event' AS "
            "role, count(*) AS records FROM pe UNION ALL SELECT 'INSIDER.PRIVILEGE_CHANGE', 'profile_change', "
            "'paired_profile_change', count(*) FROM pairs UNION ALL SELECT 'AML.CIRCULAR_TRANSFER', 'transaction', "
            "'circular_path_transaction', CAST(sum(n) AS BIGINT) FROM rings UNION ALL SELECT 'AML.TRANSACTION_SPLITTING', "
            "'transaction', 'transaction_splitting_group_member', CAST(sum(outgoing_transaction_count) AS BIGINT) FROM split"
        ),
    ),
    "prepared_rule_run": (
        prepared_rule_run,
        sql(
            "SELECT w.transaction_id AS result_key, p.source_dataset, p.record_type, count(*) AS records FROM ("
            + SPLIT.format(boundary=BOUNDARY, ledger="merged", hours=48)
            + ") w JOIN merged p ON p.from_account = w.from_account AND epoch_us(p.ts) BETWEEN w.start_us AND w.end_us GROUP BY ALL",
            "ledger",
            overlap="""SELECT transaction_id, date_trunc('second', ts) AS ts, from_account, to_account, amount_paid, 0 AS rank,
                'injected' AS source_dataset, 'synthetic' AS record_type FROM ledger WHERE is_synthetic
                UNION ALL SELECT transaction_id, date_trunc('second', ts), from_account, to_account, amount_paid, 1, 'bank', 'real'
                FROM ledger WHERE CAST(transaction_id AS BIGINT) % 11 <> 3 AND CAST(transaction_id AS BIGINT) % 13 <> 5
                UNION ALL SELECT transaction_id, date_trunc('second', ts), from_account, to_account, 1.0, 2, 'copy', 'real'
                FROM ledger WHERE CAST(transaction_id AS BIGINT) % 3 = 0""",
            merged="SELECT * FROM overlap QUALIFY row_number() OVER (PARTITION BY transaction_id ORDER BY rank) = 1",
        ),
    ),
    "results_in_scope": (
        results_in_scope,
        sql(
            "SELECT s.scope, result_key, account_id, employee_id FROM privilege, (VALUES ('account'), ('employee'), "
            "('entity'), ('both')) s(scope) WHERE (scope IN ('employee', 'entity') OR account_id = 'A3') AND (scope = "
            "'account' OR employee_id = CASE scope WHEN 'entity' THEN 'E4' ELSE 'E2' END)",
            "access_events", "profile_changes", **PRIVILEGE,
        ),
    ),
    "rule_flags": (
        rule_flags,
        sql(
            "SELECT account_id, CAST(count(*) FILTER (rule_id = 'INSIDER.PRIVILEGE_CHANGE') > 0 AS INTEGER)::DOUBLE AS "
            "privilege_change_triggered, CAST(count(*) FILTER (rule_id = 'AML.CIRCULAR_TRANSFER') > 0 AS "
            "INTEGER)::DOUBLE AS circular_transfer_triggered, CAST(count(*) FILTER (rule_id = "
            "'AML.TRANSACTION_SPLITTING') > 0 AS INTEGER)::DOUBLE AS transaction_splitting_triggered "
            "FROM accounts LEFT JOIN results USING (account_id) GROUP BY account_id",
            *RULE_RELATIONS, *ACCOUNT_RELATIONS, recursive=True, **ACCOUNTS, **RULE_ROWS,
        ),
    ),
    "fired_rules": (
        fired_rules,
        _rules(
            "SELECT account_id, string_agg(rule_id, ';' ORDER BY CASE rule_id WHEN 'INSIDER.PRIVILEGE_CHANGE' THEN "
            "0 WHEN 'AML.CIRCULAR_TRANSFER' THEN 1 ELSE 2 END) AS fired_rules, 1.0::DOUBLE AS rule_score FROM (SELECT "
            "DISTINCT account_id, rule_id FROM results) GROUP BY 1"
        ),
    ),
    "fan_out_windows": (fan_out, sql("SELECT * FROM fout", "ledger", **FANS)),
    "fan_in_windows": (fan_in, sql("SELECT * FROM fin", "ledger", **FANS)),
    "gather_scatter_windows": (gather_scatter, sql("SELECT * FROM gs", "ledger", **FANS)),
    "pattern_recall": (
        pattern_recall,
        sql(
            """SELECT alert_type, count(DISTINCT alert_id) AS labelled, count(DISTINCT CASE WHEN d.account_id IS NOT NULL
            THEN alert_id END) AS detected, count(DISTINCT CASE WHEN d.account_id IS NOT NULL THEN alert_id END)::DOUBLE /
            count(DISTINCT alert_id) AS recall FROM (SELECT scenario_id AS alert_id, account_id, ['cycle', 'fan_out',
            'fan_in', 'gather_scatter'][CAST(substr(scenario_id, 2) AS BIGINT) % 4 + 1] AS alert_type FROM
            scenario_accounts) m LEFT JOIN det d USING (alert_type, account_id) GROUP BY 1""",
            "ledger", "scenario_accounts", recursive=True, **RINGS, **FANS,
            det="SELECT DISTINCT 'cycle' AS alert_type, unnest(accs) AS account_id FROM rings UNION SELECT 'fan_out', "
            "hub FROM fout UNION SELECT 'fan_in', hub FROM fin UNION SELECT 'gather_scatter', hub FROM gs",
        ),
    ),
}
