"""Evidence behind alerts: linked accounts, subgraph, timeline, narrative and export.

Evidence is kept as row tables.  Accounts linked by injected payments form one evidence group, and
what belongs to the group is stored once under its id instead of once per account.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import money
from .clean import keep_first
from .graph_search import connected_components
from .history import account_access_events, linked_employees
from .skew import HOT_ROWS, positions


def evidence_groups(accounts: DataFrame, sent: DataFrame) -> DataFrame:
    """(account_id, group_id): accounts connected by injected payments, in any direction."""
    parts = connected_components(
        accounts.select(F.col("account_id").alias("id")), sent.filter("is_synthetic").select("src", "dst")
    )
    return parts.select(F.col("id").alias("account_id"), F.col("component").alias("group_id"))


def _ends(injected: DataFrame) -> DataFrame:
    return injected.select(
        "transaction_id", "scenario_id", F.explode(F.array_distinct(F.array("from_account", "to_account"))).alias("account_id")
    )


def complete_scenarios(groups: DataFrame, injected: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(group members, group transactions)`` after adding, once, all of any scenario touched."""
    ends = _ends(injected)
    touched = ends.join(groups, "account_id")
    scenarios = touched.filter(F.col("scenario_id").isNotNull()).select("group_id", "scenario_id").distinct()
    added = scenarios.join(ends, "scenario_id").select("group_id", "transaction_id", "account_id")
    members = groups.select("group_id", "account_id").unionByName(added.select("group_id", "account_id")).distinct()
    transactions = touched.select("group_id", "transaction_id").unionByName(
        added.select("group_id", "transaction_id")
    ).distinct()
    return members, transactions


def lead_employees(accounts: DataFrame, customers: DataFrame, employee_map: DataFrame, employees: DataFrame, access_events: DataFrame) -> DataFrame:
    """(account_id, employee_id): the first mapped employee, else that of the first access event."""
    mapped = linked_employees(accounts, customers, employee_map, employees).groupBy("account_id").agg(
        F.min_by("employee_id", F.struct("employee_id", "relationship_type")).alias("_mapped")
    )
    seen = account_access_events(access_events).groupBy("account_id").agg(
        F.min_by("employee_id", F.struct("ts", "event_id")).alias("_seen")
    )
    return accounts.select("account_id").join(mapped, "account_id", "left").join(seen, "account_id", "left").select(
        "account_id", F.coalesce("_mapped", "_seen").alias("employee_id")
    )


def typed_id(kind: Column, raw: Column) -> Column:
    return (
        F.when(kind == "Account", F.concat(F.lit("ACCT_"), raw))
        .when(kind == "Customer", F.concat(F.lit("CUST_"), raw))
        .otherwise(raw)
    )


def typed_edges(edges: DataFrame) -> DataFrame:
    """Edges with collision-free ends: which end is an account or a customer follows from the type."""
    kind, source, target = F.col("edge_type"), F.col("source_id"), F.col("target_id")
    from_kind = F.when(kind == "OWNS", "Customer").when(kind.isin("SENT_TO", "INVOLVED_IN"), "Account").otherwise("")
    to_kind = (
        F.when(kind.isin("OWNS", "CHANGED_ACCESS", "SENT_TO"), "Account")
        .when(kind.isin("MANAGES", "EDITED_PROFILE"), "Customer")
        .otherwise("")
    )
    return edges.withColumns({"source": typed_id(from_kind, source), "target": typed_id(to_kind, target)})


def subgraph_nodes(members: DataFrame, transactions: DataFrame, staff: DataFrame, nodes: DataFrame) -> DataFrame:
    """(group_id, id, type, label, raw_id) for all accounts, customers, employees and payments of a group."""
    labels = nodes.select(F.col("node_id").alias("raw_id"), F.col("node_type").alias("type"), "label")
    # A member account may be a customer of the same id too; customers need a node of their own.
    as_account = members.select("group_id", F.col("account_id").alias("raw_id"), F.lit("Account").alias("type"))
    as_customer = as_account.withColumn("type", F.lit("Customer"))
    others = staff.select("group_id", F.col("employee_id").alias("raw_id"), F.lit("Employee").alias("type")).unionByName(
        transactions.select("group_id", F.col("transaction_id").alias("raw_id"), F.lit("Transaction").alias("type"))
    )
    wanted = as_account.unionByName(others).join(labels, ["raw_id", "type"], "left")
    wanted = wanted.unionByName(as_customer.join(labels, ["raw_id", "type"]))
    label = F.coalesce("label", F.concat_ws(" ", "type", "raw_id"))
    return wanted.select(
        "group_id", typed_id(F.col("type"), F.col("raw_id")).alias("id"), "type", label.alias("label"), "raw_id"
    )


def subgraph_edges(members: DataFrame, transactions: DataFrame, staff: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with both ends in a group.  Real self-transfers and payments of others are left out."""
    ids = reduce(
        DataFrame.unionByName,
        [
            members.select("group_id", F.col("account_id").alias("raw_id")),
            transactions.select("group_id", F.col("transaction_id").alias("raw_id")),
            staff.select("group_id", F.col("employee_id").alias("raw_id")),
        ],
    )
    skipped = (F.col("edge_type") == "SENT_TO") & ~F.col("is_synthetic") & (F.col("source_id") == F.col("target_id"))
    inside = (
        edges.filter(~F.coalesce(skipped, F.lit(False)))
        .join(ids.withColumnRenamed("raw_id", "source_id"), "source_id")
        .join(ids.withColumnRenamed("raw_id", "target_id"), ["group_id", "target_id"], "left_semi")
    )
    named = typed_edges(inside).select("group_id", "source", "target", "edge_type", "ts", "record_id", "metadata")
    return keep_first(
        named, ["group_id", "source", "target", "edge_type", "record_id"], [F.col("ts"), F.col("metadata")]
    )


def timeline(
    accounts: DataFrame,
    groups: DataFrame,
    leads: DataFrame,
    access_events: DataFrame,
    profile_changes: DataFrame,
    transactions: DataFrame,
    injected: DataFrame,
    include_background: bool = False,
    limit: int = HOT_ROWS,
) -> DataFrame:
    """Events of every group in time order.

    Access events and profile changes of the lead employee, and those with a scenario id, are scenario
    evidence; the others are background context, left out unless asked for.
    """
    lead = leads.withColumnRenamed("employee_id", "lead")
    base = groups.join(lead, "account_id", "left")

    def tied(df, employee):
        mine = F.coalesce(F.col(employee) == F.col("lead"), F.lit(False))
        if "scenario_id" in df.columns:
            mine = mine | F.col("scenario_id").isNotNull()
        df = df.withColumn("tied", mine)
        return df if include_background else df.filter("tied")

    def shape(df, kind, record, evidence, background):
        return df.select(
            "group_id",
            "account_id",
            "ts",
            F.lit(kind).alias("event_type"),
            F.when(F.col("tied"), "scenario_evidence").otherwise("background_context").alias("category"),
            F.col(record).alias("record_id"),
            F.when(F.col("tied"), evidence).otherwise(background).alias("summary"),
        )

    # Fixed formats of the summaries.
    events = tied(account_access_events(access_events).join(base, "account_id"), "employee_id")
    events = shape(
        events, "access_event", "event_id",
        F.format_string("Access modification by %s: %s (%s -> %s)", "employee_id", "action", "old_value", "new_value"),
        F.format_string("[Background] Access event by %s: %s", "employee_id", "action"),
    )
    owned = accounts.select("account_id", F.col("linked_customer_id").alias("customer_id"))
    changes = tied(profile_changes.join(owned, "customer_id").join(base, "account_id"), "changed_by_employee_id")
    changes = shape(
        changes, "profile_change", "change_id",
        F.format_string("Customer profile change by employee %s: %s", "changed_by_employee_id", "field_changed"),
        F.format_string("[Background] Customer profile change by employee %s: %s", "changed_by_employee_id", "field_changed"),
    )
    payments = transactions.join(injected, "transaction_id").withColumns(
        {"tied": F.lit(True), "account_id": F.lit(None).cast("string")}
    )
    payments = shape(
        payments, "transaction", "transaction_id",
        F.format_string(
            "Scenario transaction %s: %s -> %s (%s %s via %s)", F.col("transaction_id"), F.col("from_account"),
            F.col("to_account"), money(F.col("amount_paid")), F.col("payment_currency"), F.col("payment_format"),
        ),
        F.lit(""),
    )
    rows = events.unionByName(changes).unionByName(payments)
    order = [F.col("ts"), F.col("event_type"), F.col("record_id"), F.col("account_id")]
    return positions(rows, ["group_id"], order, limit=limit)


def narrative(row: dict[str, Column], decision: float = 0.5) -> Column:
    """One paragraph per alert, from sentences that apply."""
    # Fixed formats of the sentences.
    return F.concat_ws(
        " ",
        F.format_string(
            "Alert ALT-%s for Account %s assigned %s Risk Tier with composite Risk Score of %.4f.",
            row["account_id"], row["account_id"], row["risk_tier"], row["risk_score"],
        ),
        F.when(
            F.size(row["fired_rules"]) > 0,
            F.format_string("Deterministic rules triggered: %s.", F.array_join(row["fired_rules"], ", ")),
        ),
        F.format_string("Supervised AML probability: %.4f (threshold: %s).", row["model_probability"], F.lit(str(decision))),
        F.when(
            row["contributing_factors"].isNotNull(),
            F.format_string(
                "Graph intelligence: %s (Graph Anomaly Score: %.4f).", row["contributing_factors"], row["graph_anomaly_score"]
            ),
        ),
        F.when(
            row["is_on_any_cycle"],
            F.format_string(
                "Network analysis confirms account %s participates in a closed circular layering cycle within the "
                "transaction network, returning funds back to the originating flow.",
                row["account_id"],
            ),
        ),
        F.when(
            row["employee_id"].isNotNull(),
            F.format_string(
                "Corroborating insider context: Linked to employee %s via internal access administration records.",
                row["employee_id"],
            ),
        ),
        F.when(
            row["transactions"] > 0,
            F.format_string(
                "Detected %d high-priority scenario transactions in close temporal proximity.", row["transactions"]
            ),
        ),
    )


def evidence_header(
    risk: DataFrame,
    groups: DataFrame,
    leads: DataFrame,
    transactions: DataFrame,
    structure: DataFrame,
    scores: DataFrame,
) -> DataFrame:
    """One row per account: scores, signals, group and narrative."""
    sizes = transactions.groupBy("group_id").agg(F.count(F.lit(1)).alias("transactions"))
    joined = (
        risk.join(groups, "account_id", "left")
        .join(leads, "account_id", "left")
        .join(sizes, "group_id", "left")
        .join(structure.select("account_id", "is_on_any_cycle"), "account_id", "left")
        .join(scores.select("account_id", "contributing_factors"), "account_id", "left")
        .withColumns(
            {
                "transactions": F.coalesce("transactions", F.lit(0)),
                "is_on_any_cycle": F.coalesce("is_on_any_cycle", F.lit(False)),
            }
        )
    )
    return joined.withColumns(
        {
            "alert_id": F.concat(F.lit("ALT-"), "account_id"),
            "explanation": narrative({c: F.col(c) for c in joined.columns}),
        }
    )


def dossier_lines(cases: DataFrame, header: DataFrame, nodes: DataFrame, edges: DataFrame, events: DataFrame) -> DataFrame:
    """Cases and their evidence as JSON lines: (section, body), to be written as text.

    One line per record instead of one document per case.  Case and alert lines name their evidence
    group; nodes, edges and events are exported once per group that a case refers to.
    """
    known = cases.join(header.select("account_id", "group_id"), "account_id")
    alerts = known.select("case_id", "account_id").join(header, "account_id")
    wanted = known.select("group_id").distinct()

    def lines(df, section):
        return df.select(F.lit(section).alias("section"), F.to_json(F.struct(*df.columns)).alias("body"))

    parts = [lines(known, "case"), lines(alerts, "alert")]
    for section, df in (("node", nodes), ("edge", edges), ("event", events)):
        parts.append(lines(df.join(wanted, "group_id", "left_semi"), section))
    return reduce(DataFrame.unionByName, parts)
