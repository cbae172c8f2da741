"""Queries over fused risk, alerts, cases and evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evidence, features, graph_search, isolation, models, risk, rules
from ..session import materialize, scratch_path
from ..streaming import splitting
from . import graph_queries, model_queries
from .feature_queries import ACCOUNT_RELATIONS, ACCOUNTS, BOUNDARY, FEATURES, matrix, stored_accounts
from .graph_queries import GRAPH, GRAPH_RELATIONS
from .oracle import sql
from .rule_queries import RULE_RELATIONS, RULE_ROWS, rule_results


def component_scores(s):
    """Components that SQL can compute too: all rule hits, and three features as stand-ins for model scores."""
    full = materialize(
        matrix(s).select("account_id", "wire_fraction", "sub_threshold_fraction", "cross_bank_ratio"), "components"
    )
    results, _ = rule_results(s)
    return (
        full,
        rules.fired_rules(results),
        full.select("account_id", F.col("wire_fraction").alias("model_probability")),
        full.select(
            "account_id", F.col("sub_threshold_fraction").alias("isolation_score"),
            (F.col("sub_threshold_fraction") >= 0.1).alias("is_isolation_flagged"),
        ),
        full.select("account_id", F.col("cross_bank_ratio").alias("graph_anomaly_score")),
    )


def risk_table(s):
    return materialize(risk.fused_risk(*component_scores(s)), "risk")


def _text(df):
    return df.withColumn("fired_rules", F.array_join("fired_rules", ";"))


def fused_risk(s):
    return _text(risk_table(s).drop("baseline_score", "baseline_tier").withColumns(
        {c: F.round(F.col(c) + 1e-9, 6) for c in ("model_probability", "isolation_score", "graph_anomaly_score")}
    ))


def baseline_comparison(s):
    table = risk_table(s)
    old = risk.tier_table(table, s.scenarios(), "baseline_tier").withColumn("weights", F.lit("baseline"))
    new = risk.tier_table(table, s.scenarios(), "risk_tier").withColumn("weights", F.lit("calibrated"))
    return old.unionByName(new)


def alert_queue(s):
    found = risk.alert_queue(risk_table(s), "medium", s.scenarios(), "Suspicious")
    return _text(found.select("alert_id", "account_id", "scenario_id", "scenario_type", "risk_score", "risk_tier", "fired_rules"))


def filtered_alerts(s):
    table = risk_table(s)
    parts = [risk.alert_queue(table, m).select("account_id", "risk_tier", F.lit(m).alias("minimum")) for m in ("Low", "High", "odd")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def alert_search(s):
    alerts = risk.alert_queue(risk_table(s), "Low", s.scenarios())
    return _text(risk.search_alerts(alerts, "Circular").select("alert_id", "scenario_id", "fired_rules")).unionByName(
        _text(risk.search_alerts(alerts, "alt-a12").select("alert_id", "scenario_id", "fired_rules"))
    )


def top_alerts(s):
    return risk.alert_queue(risk_table(s), "Low").select("alert_id", "risk_score", "risk_tier").limit(8)


def risk_tiers(s):
    docs = s.table("documents").select("doc_id", (F.col("n_chars") / (F.col("n_chars") + 1000.0)).alias("score"))
    return docs.select(
        "doc_id", risk.tier(F.col("score")).alias("tier"), risk.tier(F.col("score"), risk.BASELINE_BOUNDS).alias("baseline_tier")
    )


def alert_tiers(s):
    return risk.alert_queue(risk_table(s), "Low").groupBy("risk_tier").agg(F.count(F.lit(1)).alias("alerts"))


def current_cases(s):
    """Case events from the event table: views open a case, clicks assign it, errors add nothing."""
    e = s.table("events").filter(F.col("event_type").isin("view", "click"))
    number = F.col("event_id")
    events = e.select(
        F.concat(F.lit("CASE-"), F.lpad((F.col("user_id")).cast("string"), 4, "0")).alias("case_id"),
        F.concat(F.lit("A"), F.col("user_id").cast("string")).alias("account_id"),
        F.when(F.col("event_type") == "view", "create").otherwise("assign").alias("event"),
        F.when(number % 4 == 0, F.concat(F.lit("Case of "), number.cast("string"))).alias("title"),
        F.lit(None).cast("string").alias("notes"),
        F.when(F.col("event_type") == "click", F.concat(F.lit(" R"), (number % 7).cast("string"))).alias("assigned_to"),
        F.when(number % 3 == 0, "LOW").alias("priority"),
        F.col("ts").cast("timestamp").alias("at"),
    )
    found = risk.current_cases(events, risk_table(s))
    return found.withColumns({"created_at": F.unix_micros("created_at"), "updated_at": F.unix_micros("updated_at")})


# --- evidence ---------------------------------------------------------------------------


class Evidence:
    """The evidence tables of one data folder, each written once."""

    def __init__(self, s):
        self.accounts = stored_accounts(s)
        self.sent = graph_queries.sent(s)
        spine = self.accounts.select("account_id")
        self.groups = materialize(evidence.evidence_groups(spine, self.sent), "groups")
        injected = s.injected()
        members, transactions = evidence.complete_scenarios(self.groups, injected)
        self.members, self.transactions = materialize(members, "members"), materialize(transactions, "transactions")
        self.leads = materialize(
            evidence.lead_employees(self.accounts, s.customers(), s.employee_map(), s.employees(), s.access_events()), "leads"
        )
        self.staff = self.groups.join(self.leads, "account_id").filter("employee_id is not null").select(
            "group_id", "employee_id"
        ).distinct()


def scenario_completion(s):
    e = Evidence(s)
    return e.members.select("group_id", F.lit("account").alias("kind"), F.col("account_id").alias("id")).unionByName(
        e.transactions.select("group_id", F.lit("transaction").alias("kind"), F.col("transaction_id").alias("id"))
    )


def lead_employees(s):
    return evidence.lead_employees(stored_accounts(s), s.customers(), s.employee_map(), s.employees(), s.access_events())


def typed_edges(s):
    return evidence.typed_edges(graph_queries.edges(s)).select("edge_type", "source", "target", "record_id")


def subgraph_nodes(s):
    e = Evidence(s)
    return evidence.subgraph_nodes(e.members, e.transactions, e.staff, graph_queries.nodes(s, e.accounts))


def subgraph_edges(s):
    e = Evidence(s)
    found = evidence.subgraph_edges(e.members, e.transactions, e.staff, graph_queries.edges(s))
    return found.select("group_id", "source", "target", "edge_type", "record_id", F.unix_micros("ts").alias("ts_us"))


def evidence_timeline(s):
    e = Evidence(s)
    found = evidence.timeline(
        e.accounts, e.groups, e.leads, s.access_events(), s.profile_changes(), e.transactions, s.injected(),
        include_background=True,
    )
    return found.withColumn("ts", F.unix_micros("ts"))


def alert_narratives(s):
    """Narratives over component scores that SQL can compute too."""
    e = Evidence(s)
    pairs = graph_queries.simple(s)
    cycles = graph_search.accounts_on_cycles(pairs).select("account_id", F.lit(True).alias("is_on_any_cycle"))
    factors = e.accounts.select("account_id", F.lit("none").alias("contributing_factors"))
    header = evidence.evidence_header(risk_table(s), e.groups, e.leads, e.transactions, cycles, factors)
    return header.select("account_id", "alert_id", "group_id", "employee_id", "explanation")


def scored_accounts(s):
    """Real component scores for every account: rules, trees, isolation forest and graph."""
    full = model_queries.stored_matrix(s)
    results, _ = rule_results(s)
    rows = model_queries.training_rows(s, full)
    model = models.fit_classifier(rows, model_queries.NAMES)
    names = [c for c in full.columns if c != "account_id" and c not in features.FEATURE_GROUPS["customer"]]
    background, _ = features.split_background(full, s.scenarios().filter(F.col("scenario_type") == "suspicious"))
    background = materialize(background, "background")
    nodes = isolation.fit_forest(background, names, model_queries.FOREST)
    cut = isolation.threshold(isolation.isolation_scores(nodes, background, names))
    outliers = isolation.isolation_scores(nodes, full, names).withColumn(
        "is_isolation_flagged", F.col("isolation_score") >= cut
    )
    graph = graph_queries.graph_score_table(s, materialize(stored_accounts(s), "accounts"))
    fused = risk.fused_risk(full, rules.fired_rules(results), models.score_accounts(model, full), outliers, graph)
    return materialize(fused, "risk"), graph


def end_to_end_risk(s):
    return _text(scored_accounts(s)[0])


def case_dossiers(s):
    """JSON lines of a case for every account, written and read back: lines per section."""
    e = Evidence(s)
    none = e.accounts.select("account_id", F.lit(False).alias("is_on_any_cycle"))
    factors = e.accounts.select("account_id", F.lit(None).cast("string").alias("contributing_factors"))
    table = risk_table(s)
    header = materialize(evidence.evidence_header(table, e.groups, e.leads, e.transactions, none, factors), "header")
    cases = table.select(F.concat(F.lit("CASE-"), "account_id").alias("case_id"), "account_id")
    nodes = evidence.subgraph_nodes(e.members, e.transactions, e.staff, graph_queries.nodes(s, e.accounts))
    edges = evidence.subgraph_edges(e.members, e.transactions, e.staff, graph_queries.edges(s))
    events = evidence.timeline(
        e.accounts, e.groups, e.leads, s.access_events(), s.profile_changes(), e.transactions, s.injected()
    )
    path = scratch_path(s.spark, "dossiers")
    evidence.dossier_lines(cases, header, nodes, edges, events).write.partitionBy("section").text(path)
    back = s.spark.read.text(path).filter(F.get_json_object("value", "$.group_id").isNotNull())
    return back.groupBy("section").agg(F.count(F.lit(1)).alias("lines"))


def streamed_splitting(s):
    events = s.spark.readStream.schema(s.table("events").schema).option("pathGlobFilter", "events.parquet").parquet(s.folder)
    payments = events.select(
        F.concat(F.lit("A"), F.col("user_id").cast("string")).alias("from_account"),
        F.col("value").alias("amount_paid"),
        F.col("ts").cast("timestamp").alias("ts"),
    )
    return splitting.run_available(splitting.splitting_alerts(payments, boundary=BOUNDARY), s.spark)


RISK = {
    **RULE_ROWS,
    **FEATURES,
    "comp": """SELECT a.account_id, coalesce(f.fired_rules, '') AS fired_rules, coalesce(f.score, 0) AS rule_score,
        wire_fraction AS model_probability,
        sub_threshold_fraction AS isolation_score, sub_threshold_fraction >= 0.1 AS is_isolation_flagged,
        cross_bank_ratio AS graph_anomaly_score FROM amounts a LEFT JOIN (SELECT account_id, 1.0::DOUBLE AS score,
        string_agg(rule_id, ';' ORDER BY CASE rule_id WHEN 'INSIDER.PRIVILEGE_CHANGE' THEN 0 WHEN
        'AML.CIRCULAR_TRANSFER' THEN 1 ELSE 2 END) AS fired_rules FROM (SELECT DISTINCT account_id, rule_id FROM results) GROUP BY 1) f
        USING (account_id)""",
    "fused": """SELECT *, round(0.0::DOUBLE + rule_score * 0.16::DOUBLE + model_probability * 0.5::DOUBLE + isolation_score *
        0.14::DOUBLE + graph_anomaly_score * 0.2::DOUBLE, 4) AS risk_score, round(0.0::DOUBLE + rule_score * 0.35::DOUBLE +
        model_probability * 0.25::DOUBLE + isolation_score * 0.2::DOUBLE + graph_anomaly_score * 0.2::DOUBLE, 4) AS
        baseline_score FROM comp""",
    "risk": """SELECT *, CASE WHEN risk_score >= 0.75 THEN 'Critical' WHEN risk_score >= 0.55 THEN 'High' WHEN risk_score >=
        0.3 THEN 'Medium' ELSE 'Low' END AS risk_tier, CASE WHEN baseline_score >= 0.8 THEN 'Critical' WHEN baseline_score >=
        0.55 THEN 'High' WHEN baseline_score >= 0.3 THEN 'Medium' ELSE 'Low' END AS baseline_tier FROM fused""",
    "ral": "SELECT r.*, 'ALT-' || r.account_id AS alert_id, s.scenario_id, s.scenario_type FROM risk r JOIN "
    "scenario_accounts s ON s.account_id = r.account_id AND s.pos = 1",
}
RISK_RELATIONS = tuple(dict.fromkeys(RULE_RELATIONS + ACCOUNT_RELATIONS + ("scenario_accounts",)))

EVIDENCE = {
    **ACCOUNTS,
    "conn(account_id, b)": "SELECT account_id, account_id FROM accounts UNION SELECT c.account_id, x.v FROM conn c JOIN "
    "(SELECT from_account AS u, to_account AS v FROM injected UNION SELECT to_account, from_account FROM injected) x ON "
    "x.u = c.b",
    "groups": "SELECT account_id, min(b) AS group_id FROM conn GROUP BY 1",
    "ends": "SELECT transaction_id, scenario_id, from_account AS account_id FROM injected UNION SELECT transaction_id, "
    "scenario_id, to_account FROM injected",
    "gsc": "SELECT DISTINCT group_id, scenario_id FROM ends JOIN groups USING (account_id)",
    "members": "SELECT group_id, account_id FROM groups UNION SELECT group_id, account_id FROM gsc JOIN ends USING (scenario_id)",
    "gtx": "SELECT group_id, transaction_id FROM ends JOIN groups USING (account_id) UNION SELECT group_id, transaction_id "
    "FROM gsc JOIN ends USING (scenario_id)",
    "lead": """SELECT a.account_id, coalesce((SELECT min(employee_id) FROM emp_map m JOIN customers c ON c.customer_id =
        m.customer_id WHERE m.customer_id = a.linked_customer_id), e.employee_id) AS employee_id FROM accounts a LEFT JOIN
        (SELECT account_id, arg_min(employee_id, (ts, event_id)) AS employee_id FROM targets GROUP BY 1) e USING (account_id)""",
    "staff": "SELECT DISTINCT group_id, employee_id FROM groups JOIN lead USING (account_id) WHERE employee_id IS NOT NULL",
    "nodes": GRAPH["nodes"],
    "edges": GRAPH["edges"],
    "inv": GRAPH["inv"],
    "anodes": GRAPH["anodes"],
}
_EVIDENCE_ORDER = ("inv", "anodes", "nodes", "edges")
EVIDENCE = {
    **{k: v for k, v in EVIDENCE.items() if k not in _EVIDENCE_ORDER},
    **{k: EVIDENCE[k] for k in _EVIDENCE_ORDER},
    "ids": "SELECT group_id, account_id AS raw_id FROM members UNION ALL SELECT group_id, transaction_id FROM gtx UNION ALL "
    "SELECT group_id, employee_id FROM staff",
    "typed": """SELECT *, CASE WHEN edge_type = 'OWNS' THEN 'CUST_' || source_id WHEN edge_type IN ('SENT_TO', 'INVOLVED_IN')
        THEN 'ACCT_' || source_id ELSE source_id END AS source, CASE WHEN edge_type IN ('OWNS', 'CHANGED_ACCESS', 'SENT_TO')
        THEN 'ACCT_' || target_id WHEN edge_type IN ('MANAGES', 'EDITED_PROFILE') THEN 'CUST_' || target_id ELSE target_id END
        AS target FROM edges""",
}


def _risk(body, **extra):
    return sql(body, *RISK_RELATIONS, recursive=True, **RISK, **extra)


def _evidence(body, **extra):
    return sql(body, *GRAPH_RELATIONS, "injected", recursive=True, **EVIDENCE, **extra)


_NODES = """SELECT group_id, CASE type WHEN 'Account' THEN 'ACCT_' || raw_id WHEN 'Customer' THEN 'CUST_' || raw_id ELSE
            raw_id END AS id, type, coalesce(label, type || ' ' || raw_id) AS label, raw_id FROM (SELECT group_id, account_id AS
            raw_id, 'Account' AS type FROM members UNION ALL SELECT group_id, employee_id, 'Employee' FROM staff UNION ALL
            SELECT group_id, transaction_id, 'Transaction' FROM gtx UNION ALL SELECT group_id, account_id, 'Customer' FROM
            members WHERE account_id IN (SELECT customer_id FROM customers)) LEFT JOIN nodes ON node_id = raw_id AND node_type =
            type"""

_EDGES = """SELECT a.group_id, source, target, edge_type, record_id, epoch_us(min(ts)) AS ts_us FROM typed t JOIN ids a ON
            a.raw_id = t.source_id JOIN ids b ON b.group_id = a.group_id AND b.raw_id = t.target_id WHERE NOT (edge_type =
            'SENT_TO' AND NOT is_synthetic AND source_id = target_id) GROUP BY ALL"""

_TIMELINE = """SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY ts, event_type, record_id, account_id) AS position
            FROM (SELECT group_id, account_id, epoch_us(ts) AS ts, 'access_event' AS event_type, CASE WHEN x.employee_id =
            l.employee_id THEN 'scenario_evidence' ELSE 'background_context' END AS category, event_id AS record_id, CASE WHEN
            x.employee_id = l.employee_id THEN 'Access modification by ' || x.employee_id || ': ' || action || ' (' || old_value
            || ' -> ' || new_value || ')' ELSE '[Background] Access event by ' || x.employee_id || ': ' || action END AS summary
            FROM (SELECT DISTINCT account_id, event_id, employee_id, action, old_value, new_value, ts FROM targets) x JOIN groups
            USING (account_id) JOIN lead l USING (account_id)
            UNION ALL SELECT group_id, a.account_id, epoch_us(ts), 'profile_change', CASE WHEN changed_by_employee_id =
            l.employee_id THEN 'scenario_evidence' ELSE 'background_context' END, change_id, CASE WHEN changed_by_employee_id =
            l.employee_id THEN '' ELSE '[Background] ' END || 'Customer profile change by employee ' || changed_by_employee_id ||
            ': ' || field_changed FROM profile_changes p JOIN accounts a ON a.linked_customer_id = p.customer_id JOIN groups g ON
            g.account_id = a.account_id JOIN lead l ON l.account_id = a.account_id
            UNION ALL SELECT group_id, NULL, epoch_us(ts), 'transaction', 'scenario_evidence', transaction_id, 'Scenario transaction ' || transaction_id || ': ' || from_account || ' -> ' || to_account || ' (' || format('{:,.2f}',
            amount_paid) || ' ' || payment_currency || ' via ' || payment_format || ')' FROM gtx JOIN injected USING
            (transaction_id))"""

_LINES = f"""SELECT 'case' AS section, count(*) AS lines FROM accounts UNION ALL SELECT 'alert', count(*) FROM accounts
    UNION ALL SELECT 'node', count(*) FROM ({_NODES}) UNION ALL SELECT 'edge', count(*) FROM ({_EDGES})
    UNION ALL SELECT 'event', count(*) FROM ({_TIMELINE}) WHERE category = 'scenario_evidence'"""

QUERIES = {
    "fused_risk": (
        fused_risk,
        _risk(
            "SELECT account_id, fired_rules, rule_score, round(model_probability + 1e-9, 6) AS model_probability, "
            "round(isolation_score + 1e-9, 6) AS isolation_score, is_isolation_flagged, round(graph_anomaly_score + 1e-9, 6) "
            "AS graph_anomaly_score, model_probability >= 0.5 AS is_model_flagged, risk_score, risk_tier FROM risk"
        ),
    ),
    "baseline_comparison": (
        baseline_comparison,
        _risk(
            " UNION ALL ".join(
                f"SELECT scenario_type, count(*) FILTER ({c} = 'Low') AS Low, count(*) FILTER ({c} = 'Medium') AS Medium, "
                f"count(*) FILTER ({c} = 'High') AS High, count(*) FILTER ({c} = 'Critical') AS Critical, '{w}' AS weights "
                "FROM ral GROUP BY 1"
                for c, w in (("baseline_tier", "baseline"), ("risk_tier", "calibrated"))
            )
        ),
    ),
    "alert_queue": (
        alert_queue,
        _risk(
            "SELECT alert_id, account_id, scenario_id, scenario_type, risk_score, risk_tier, fired_rules FROM ral WHERE "
            "risk_tier <> 'Low' AND scenario_type = 'suspicious'"
        ),
    ),
    "filtered_alerts": (
        filtered_alerts,
        _risk(
            "SELECT account_id, risk_tier, minimum FROM risk, (VALUES ('Low'), ('High'), ('odd')) v(minimum) WHERE minimum = "
            "'Low' OR (minimum = 'High' AND risk_tier IN ('High', 'Critical')) OR (minimum = 'odd' AND risk_tier <> 'Low')"
        ),
    ),
    "alert_search": (
        alert_search,
        _risk(
            "SELECT alert_id, scenario_id, fired_rules FROM ral WHERE contains(lower(fired_rules), 'circular') UNION ALL "
            "SELECT alert_id, scenario_id, fired_rules FROM ral WHERE contains(lower(alert_id), 'alt-a12')"
        ),
    ),
    "top_alerts": (
        top_alerts,
        _risk("SELECT 'ALT-' || account_id AS alert_id, risk_score, risk_tier FROM risk ORDER BY risk_score DESC, account_id LIMIT 8"),
    ),
    "alert_tiers": (alert_tiers, _risk("SELECT risk_tier, count(*) AS alerts FROM risk GROUP BY 1")),
    "risk_tiers": (
        risk_tiers,
        "SELECT doc_id, CASE WHEN s >= 0.75 THEN 'Critical' WHEN s >= 0.55 THEN 'High' WHEN s >= 0.3 THEN 'Medium' ELSE 'Low' "
        "END AS tier, CASE WHEN s >= 0.8 THEN 'Critical' WHEN s >= 0.55 THEN 'High' WHEN s >= 0.3 THEN 'Medium' ELSE 'Low' END "
        "AS baseline_tier FROM (SELECT doc_id, n_chars / (n_chars + 1000.0::DOUBLE) AS s FROM documents)",
    ),
    "current_cases": (
        current_cases,
        _risk(
            """SELECT case_id, c.account_id, 'ALT-' || c.account_id AS alert_id, coalesce(title, 'Investigation into Account '
            || c.account_id || ' (' || coalesce(risk_tier, 'Unknown') || ' Risk)') AS title, 'Initial case created from detection alert.' AS notes, coalesce(assigned, 'Unassigned') AS assigned_to, coalesce(priority, CASE WHEN risk_tier
            = 'Critical' THEN 'CRITICAL' ELSE 'HIGH' END) AS priority, 'OPEN' AS status, coalesce(risk_tier, 'Unknown') AS
            risk_tier, coalesce(risk_score, 0) AS risk_score, created_at, updated_at FROM (SELECT 'CASE-' || lpad('' ||
            user_id, 4, '0') AS case_id, 'A' || user_id AS account_id, arg_min_null(CASE WHEN event_id % 4 = 0 THEN 'Case of ' ||
            event_id END, ts) FILTER (event_type = 'view') AS title, arg_min_null(CASE WHEN event_id % 3 = 0 THEN 'LOW' END, ts)
            FILTER (event_type = 'view') AS priority, arg_max('R' || (event_id % 7), ts) FILTER (event_type = 'click') AS
            assigned, epoch_us(min(ts)) AS created_at, epoch_us(max(ts)) AS updated_at FROM events WHERE event_type IN ('view',
            'click') GROUP BY user_id) c LEFT JOIN risk r ON r.account_id = c.account_id""",
        ),
    ),
    "scenario_completion": (
        scenario_completion,
        _evidence(
            "SELECT group_id, 'account' AS kind, account_id AS id FROM members UNION ALL SELECT group_id, 'transaction', "
            "transaction_id FROM gtx"
        ),
    ),
    "lead_employees": (lead_employees, _evidence("SELECT * FROM lead")),
    "typed_edges": (typed_edges, _evidence("SELECT edge_type, source, target, record_id FROM typed")),
    "subgraph_nodes": (subgraph_nodes, _evidence(_NODES)),
    "subgraph_edges": (subgraph_edges, _evidence(_EDGES)),
    "evidence_timeline": (evidence_timeline, _evidence(_TIMELINE)),
    "alert_narratives": (
        alert_narratives,
        sql(
            """SELECT account_id, 'ALT-' || account_id AS alert_id, group_id, employee_id, concat_ws(' ', 'Alert ALT-' ||
            account_id || ' for Account ' || account_id || ' assigned ' || risk_tier || ' Risk Tier with composite Risk Score of '
            || printf('%.4f', risk_score) || '.', CASE WHEN fired_rules <> '' THEN 'Deterministic rules triggered: ' ||
            replace(fired_rules, ';', ', ') || '.' END, 'Supervised AML probability: ' || printf('%.4f', model_probability) ||
            ' (threshold: 0.5).', 'Graph intelligence: none (Graph Anomaly Score: ' || printf('%.4f', graph_anomaly_score) ||
            ').', CASE WHEN c.account_id IS NOT NULL THEN 'Network analysis confirms account ' || r.account_id ||
            ' participates in a closed circular layering cycle within the transaction network, returning funds back to the '
            || 'originating flow.' END, CASE WHEN employee_id IS NOT NULL THEN 'Corroborating insider context: Linked to employee '
            || employee_id || ' via internal access administration records.' END, CASE WHEN n > 0 THEN 'Detected ' || n ||
            ' high-priority scenario transactions in close temporal proximity.' END) AS explanation FROM risk r JOIN groups USING
            (account_id) JOIN lead USING (account_id) LEFT JOIN (SELECT group_id, count(*) AS n FROM gtx GROUP BY 1) USING
            (group_id) LEFT JOIN cyc c USING (account_id)""",
            *RISK_RELATIONS, *GRAPH_RELATIONS, "injected", recursive=True,
            **{**RISK, **{k: EVIDENCE[k] for k in ("conn(account_id, b)", "groups", "ends", "gsc", "gtx", "lead")}},
            inv=GRAPH["inv"], e=GRAPH["e"], **{k: GRAPH[k] for k in ("walkable(s, v, h)", "cyc")},
        ),
    ),
    "end_to_end_risk": (end_to_end_risk, None),
    "case_dossiers": (case_dossiers, _evidence(_LINES)),
    "streamed_splitting": (
        streamed_splitting,
        """SELECT 'A' || user_id AS from_account, epoch_us(w) AS start_us, count(*) AS outgoing, count(*) FILTER (value < 5.0)
        AS below FROM (SELECT *, unnest(generate_series(date_trunc('hour', ts) - INTERVAL 47 HOURS, date_trunc('hour', ts),
        INTERVAL 1 HOUR)) AS w FROM events) WHERE w + INTERVAL 48 HOURS <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)
        GROUP BY 1, 2 HAVING count(*) >= 3 AND count(*) FILTER (value < 5.0) >= 1""",
    ),
}
