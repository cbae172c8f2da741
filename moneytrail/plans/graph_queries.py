"""Queries over the investigation graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import density, evidence, graph, graph_search, risk
from ..session import materialize
from .feature_queries import ACCOUNT_RELATIONS, ACCOUNTS, r6, rounded, stored_accounts
from .oracle import sql

# Unit vectors: radii at which the test embeddings fall into clusters.
EPS = 1.15
EPS_GRID = [1.10, 1.15, 1.18, 1.20]
WALKS, WALK_LENGTH = 200, 30


def ledger(s):
    return graph.investigation_ledger(s.real(), s.injected(), s.scenarios(), s.access_events())


def nodes(s, accounts=None):
    accounts = stored_accounts(s) if accounts is None else accounts
    return graph.build_nodes(s.employees(), s.customers(), accounts, ledger(s))


def edges(s):
    return graph.build_edges(s.customers(), s.employee_map(), s.access_events(), s.profile_changes(), ledger(s))


def sent(s):
    """Payment edges of the graph; the other edge types are never computed for it."""
    return ledger(s).select(
        F.col("from_account").alias("src"), F.col("to_account").alias("dst"),
        F.col("transaction_id").alias("record_id"), "is_synthetic",
    )


def simple(s):
    return materialize(graph.simple_edges(sent(s)), "simple")


def account_nodes(s):
    return graph.distinct_ids((ledger(s), "from_account"), (ledger(s), "to_account")).unionByName(
        stored_accounts(s).select("account_id")
    ).distinct()


def investigation_ledger(s):
    return ledger(s).select("transaction_id", "from_account", "to_account", "amount_paid", "is_synthetic")


def graph_nodes(s):
    return nodes(s)


def graph_edges(s):
    return edges(s).select(
        "source_id", "target_id", "edge_type", F.unix_micros("ts").alias("ts_us"), "record_id", "is_synthetic", "metadata"
    )


def type_histogram(s):
    n = nodes(s).groupBy(F.col("node_type").alias("type")).count().withColumn("part", F.lit("node"))
    e = edges(s).groupBy(F.col("edge_type").alias("type")).count().withColumn("part", F.lit("edge"))
    return n.unionByName(e)


def degrees(s):
    wanted = account_nodes(s)
    return wanted.join(graph.degrees(edges(s)), "account_id", "left").fillna(0)


def cycle_accounts(s):
    return graph_search.accounts_on_cycles(simple(s))


def high_value(s):
    big = s.ledger().filter(F.col("amount_paid") >= 150.0)
    return materialize(
        big.select(F.col("from_account").alias("src"), F.col("to_account").alias("dst"))
        .filter(F.col("src") != F.col("dst")).distinct(),
        "large",
    )


def high_value_cycle_accounts(s):
    return graph_search.accounts_on_cycles(high_value(s))


def shortest_cycles(s):
    e = simple(s)
    found = graph_search.shortest_cycles(e, e.select(F.col("src").alias("account_id")).distinct())
    return found.select("account_id", "cycle_length", F.array_join("path", ">").alias("path"))


def betweenness(s):
    return rounded(graph_search.betweenness(simple(s), account_nodes(s)), 9)


def betweenness_estimate(s):
    return graph_search.betweenness(simple(s), account_nodes(s), sources=40)


def clustering(s):
    return rounded(graph.clustering(simple(s)))


def connected_employees(s):
    return graph.connected_employees(edges(s), stored_accounts(s), account_nodes(s))


def structure(s, accounts=None):
    accounts = stored_accounts(s) if accounts is None else accounts
    pairs = simple(s)
    spine = account_nodes(s)
    return graph.structural_features(
        nodes(s, accounts), materialize(edges(s), "edges"), accounts, graph_search.betweenness(pairs, spine),
        graph_search.accounts_on_cycles(pairs),
    )


def structural_features(s):
    return rounded(structure(s))


def account_projection(s):
    return graph.undirected_edges(sent(s))


def random_walks(s):
    links = materialize(graph.undirected_edges(sent(s)), "links")
    found = graph_search.random_walks(account_nodes(s), links, WALKS, WALK_LENGTH)
    return found.select("start", "walk", F.array_join("path", ">").alias("path"))


def vectors(s):
    return s.table("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


def neighbour_counts(s):
    return density.neighbour_counts(vectors(s), EPS).withColumnRenamed("id", "vec_id")


def density_clusters(s):
    return density.dbscan(vectors(s), EPS_GRID).withColumnRenamed("id", "vec_id")


def eps_report(s):
    return rounded(density.eps_report(density.dbscan(vectors(s), EPS_GRID)))


def account_clusters(s):
    labels = density.dbscan(vectors(s), [EPS])
    return density.cluster_table(labels).withColumn("account_id", F.concat(F.lit("A"), F.col("account_id").cast("string")))


def structure_with_clusters(s):
    own = materialize(account_clusters(s), "clusters")
    return graph.degrees(edges(s)).join(own, "account_id")


def scenario_clusters(s):
    return risk.scenario_clusters(s.scenarios(), materialize(account_clusters(s), "clusters"))


def cluster_shares(s):
    return rounded(risk.cluster_shares(scenario_clusters(s)))


def graph_score_table(s, accounts=None):
    own = materialize(account_clusters(s), "clusters")
    return materialize(risk.graph_scores(materialize(structure(s, accounts), "structure"), own), "scores")


def graph_scores(s):
    return graph_score_table(s)


def scenario_scores(s):
    return risk.scenario_scores(s.scenarios(), graph_score_table(s))


def evidence_groups(s):
    return evidence.evidence_groups(account_nodes(s), sent(s))


def trade_components(s):
    """Components of the pairs ordering account - supplying account of the whole trade ledger."""
    trade = s.trade_ledger()
    pairs = trade.select(F.concat(F.lit("C"), "from_account").alias("src"), F.concat(F.lit("S"), "to_account").alias("dst"))
    pairs = materialize(pairs.distinct(), "trade-pairs")
    vertices = graph.distinct_ids((pairs, "src"), (pairs, "dst"), name="id")
    return graph_search.connected_components(vertices, pairs)


# --- check SQL --------------------------------------------------------------------------

GRAPH = {
    "inv": """SELECT * FROM ledger WHERE is_synthetic OR from_account IN (SELECT account_id FROM scenario_accounts UNION
        SELECT account_id FROM targets) OR to_account IN (SELECT account_id FROM scenario_accounts UNION SELECT
        account_id FROM targets)""",
    "anodes": "SELECT account_id FROM accounts UNION SELECT from_account FROM inv UNION SELECT to_account FROM inv",
    "nodes": """SELECT employee_id AS node_id, 'Employee' AS node_type, name || ' (' || role || ', ' || department || ')'
            AS label FROM employees
        UNION ALL SELECT customer_id, 'Customer', name || ' (' || country || ', Risk: ' || risk_rating || ')' FROM customers
        UNION ALL SELECT account_id, 'Account', 'Account ' || account_id || ' (' || coalesce('Bank ' || bank_id,
            'Unknown Bank') || ')' FROM accounts
        UNION ALL SELECT account_id, 'Account', 'Account ' || account_id || ' (External Counterparty)' FROM anodes
            WHERE account_id NOT IN (SELECT account_id FROM accounts)
        UNION ALL SELECT transaction_id, 'Transaction', '[' || CASE WHEN is_synthetic THEN 'SYNTHETIC' ELSE 'REAL' END ||
            '] ' || transaction_id || ': ' || format('{:,.2f}', amount_paid) || ' ' || payment_currency || ' via ' ||
            payment_format FROM inv""",
    "edges": """SELECT customer_id AS source_id, account_ids AS target_id, 'OWNS' AS edge_type, NULL::TIMESTAMP AS ts,
            NULL::VARCHAR AS record_id, NULL::BOOLEAN AS is_synthetic, '{"relationship":"owner"}' AS metadata FROM customers
        UNION ALL SELECT employee_id, customer_id, 'MANAGES', NULL, NULL, NULL,
            '{"relationship_type":"' || relationship_type || '"}' FROM emp_map
        UNION ALL SELECT employee_id, account_id, 'CHANGED_ACCESS', ts, event_id, NULL, '{"event_id":"' || event_id ||
            '","action":"' || action || '","old_value":"' || old_value || '","new_value":"' || new_value || '"}' FROM targets
        UNION ALL SELECT changed_by_employee_id, customer_id, 'EDITED_PROFILE', ts, change_id, NULL, '{"change_id":"' ||
            change_id || '","field_changed":"' || field_changed || '"}' FROM profile_changes
        UNION ALL SELECT from_account, to_account, 'SENT_TO', ts, transaction_id, is_synthetic, '{"transaction_id":"' ||
            transaction_id || '","amount":' || amount_paid || ',"currency":"' || payment_currency || '","format":"' ||
            payment_format || '","is_laundering":' || is_laundering || ',"is_synthetic":' || is_synthetic || '}' FROM inv
        UNION ALL SELECT from_account, transaction_id, 'INVOLVED_IN', ts, transaction_id, is_synthetic,
            '{"role":"sender","amount":' || amount_paid || '}' FROM inv
        UNION ALL SELECT to_account, transaction_id, 'INVOLVED_IN', ts, transaction_id, is_synthetic,
            '{"role":"receiver","amount":' || amount_paid || '}' FROM inv""",
    "e": "SELECT DISTINCT from_account AS u, to_account AS v FROM inv WHERE from_account <> to_account",
    "deg": """SELECT account_id, count(*) AS degree, count(*) FILTER (edge_type = 'SENT_TO' AND o = 0) AS in_degree,
        count(*) FILTER (edge_type = 'SENT_TO' AND o = 1) AS out_degree FROM (SELECT source_id AS account_id, edge_type,
        1 AS o FROM edges UNION ALL SELECT target_id, edge_type, 0 FROM edges) GROUP BY 1""",
    "l1": "SELECT u AS s, v, 1.0::DOUBLE AS sg FROM e",
    "l2": "SELECT s, e.v, sum(sg) AS sg FROM l1 JOIN e ON e.u = l1.v WHERE e.v <> s AND (s, e.v) NOT IN "
    "(SELECT (s, v) FROM l1) GROUP BY 1, 2",
    "l3": "SELECT s, e.v, sum(sg) AS sg FROM l2 JOIN e ON e.u = l2.v WHERE e.v <> s AND (s, e.v) NOT IN "
    "(SELECT (s, v) FROM l1 UNION ALL SELECT (s, v) FROM l2) GROUP BY 1, 2",
    "l4": "SELECT s, e.v, sum(sg) AS sg FROM l3 JOIN e ON e.u = l3.v WHERE e.v <> s AND (s, e.v) NOT IN "
    "(SELECT (s, v) FROM l1 UNION ALL SELECT (s, v) FROM l2 UNION ALL SELECT (s, v) FROM l3) GROUP BY 1, 2",
    "sp": "SELECT *, 1 AS d FROM l1 UNION ALL SELECT *, 2 FROM l2 UNION ALL SELECT *, 3 FROM l3 UNION ALL "
    "SELECT *, 4 FROM l4",
    "btw": """SELECT a.account_id, coalesce(b.x / ((SELECT count(*) FROM anodes) - 1) / ((SELECT count(*) FROM anodes) - 2),
        0) AS betweenness_centrality FROM anodes a LEFT JOIN (SELECT p.v, sum(p.sg * q.sg / t.sg) AS x FROM sp p JOIN sp q
        ON q.s = p.v JOIN sp t ON t.s = p.s AND t.v = q.v AND t.d = p.d + q.d GROUP BY 1) b ON b.v = a.account_id""",
    "sym": "SELECT u, v, count(*) AS w FROM (SELECT u, v FROM e UNION ALL SELECT v, u FROM e) GROUP BY 1, 2",
    "clu": """SELECT d.u AS account_id, coalesce(t.t, 0)::DOUBLE / greatest(2 * (d.dt * (d.dt - 1) - 2 * d.r), 1) AS
        clustering_coefficient FROM (SELECT u, sum(w) AS dt, count(*) FILTER (w = 2) AS r FROM sym GROUP BY 1) d LEFT JOIN
        (SELECT a.u, sum(a.w * b.w * c.w) AS t FROM sym a JOIN sym b ON b.u = a.v JOIN sym c ON c.u = b.v AND c.v = a.u
        GROUP BY 1) t ON t.u = d.u""",
    "cemp": """SELECT account_id, count(DISTINCT employee_id) AS num_connected_employees FROM (SELECT account_id,
        employee_id FROM targets UNION ALL SELECT n.account_id, m.employee_id FROM anodes n LEFT JOIN accounts a
        USING (account_id) JOIN emp_map m ON m.customer_id = coalesce(a.linked_customer_id, n.account_id)) GROUP BY 1""",
    "walkable(s, v, h)": "SELECT u, v, 1 FROM e UNION SELECT s, e.v, h + 1 FROM walkable JOIN e ON e.u = walkable.v "
    "WHERE h < 6",
    "cyc": "SELECT DISTINCT s AS account_id FROM walkable WHERE s = v",
    "struct": """SELECT n.account_id, coalesce(degree, 0) AS degree, coalesce(in_degree, 0) AS in_degree,
        coalesce(out_degree, 0) AS out_degree, betweenness_centrality, coalesce(clustering_coefficient, 0) AS
        clustering_coefficient, c.account_id IS NOT NULL AS is_on_any_cycle, coalesce(num_connected_employees, 0) AS
        num_connected_employees FROM anodes n LEFT JOIN deg USING (account_id) LEFT JOIN btw USING (account_id) LEFT JOIN
        clu USING (account_id) LEFT JOIN cemp USING (account_id) LEFT JOIN cyc c ON c.account_id = n.account_id""",
}
GRAPH_RELATIONS = ACCOUNT_RELATIONS + ("ledger", "employees", "access_events")

CLUSTERS = {
    "grid": "SELECT unnest([" + ", ".join(f"{e}::DOUBLE" for e in EPS_GRID) + "]) AS eps",
    "dist": "SELECT a.vec_id AS a, b.vec_id AS b, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS d "
    "FROM embeddings a, embeddings b",
    "near": "SELECT eps, a, b FROM dist JOIN grid ON d <= eps",
    "core": "SELECT eps, a FROM near GROUP BY 1, 2 HAVING count(*) >= 5",
    "link": "SELECT n.* FROM near n JOIN core x ON x.eps = n.eps AND x.a = n.a JOIN core y ON y.eps = n.eps AND y.a = n.b",
    "reach(eps, a, b)": "SELECT eps, a, a FROM core UNION SELECT r.eps, r.a, l.b FROM reach r JOIN link l ON "
    "l.eps = r.eps AND l.a = r.b",
    "num": "SELECT eps, a, dense_rank() OVER (PARTITION BY eps ORDER BY c) - 1 AS label FROM (SELECT eps, a, min(b) AS c "
    "FROM reach GROUP BY 1, 2)",
    "lab": """SELECT g.eps, v.vec_id, CAST(coalesce(any_value(c.label), min(x.label), -1) AS INTEGER) AS cluster_label
        FROM embeddings v CROSS JOIN grid g LEFT JOIN num c ON c.eps = g.eps AND c.a = v.vec_id LEFT JOIN near n ON
        n.eps = g.eps AND n.a = v.vec_id LEFT JOIN num x ON x.eps = g.eps AND x.a = n.b GROUP BY 1, 2""",
    "clusters": f"""SELECT 'A' || vec_id AS account_id, cluster_label, CASE WHEN cluster_label = -1 THEN 1 ELSE count(*)
        OVER (PARTITION BY cluster_label) END AS cluster_size, cluster_label = -1 AS is_outlier FROM lab
        WHERE eps = {EPS}""",
}
_PLACED = """SELECT scenario_id, scenario_type, s.account_id, coalesce(cluster_label, -1) AS cluster_label,
    coalesce(cluster_size, 1) AS cluster_size, coalesce(is_outlier, true) AS is_outlier,
    coalesce(is_outlier, true) OR coalesce(cluster_size, 1) <= 15 AS is_small_or_outlier
    FROM scenario_accounts s LEFT JOIN clusters USING (account_id)"""

SCORES = {
    "scored": """SELECT *, least(1.0::DOUBLE, betweenness_centrality / coalesce((SELECT quantile_cont(betweenness_centrality, 0.9)
        FROM struct JOIN clusters USING (account_id) WHERE betweenness_centrality > 0), 1e-5)) AS fl
        FROM struct JOIN clusters USING (account_id)""",
    "scores": """SELECT account_id, least(1.0::DOUBLE, round(CASE WHEN is_on_any_cycle THEN 0.35::DOUBLE ELSE 0 END
        + CASE WHEN betweenness_centrality > 0 THEN fl * 0.20::DOUBLE ELSE 0 END
        + CASE WHEN clustering_coefficient > 0 THEN least(1.0::DOUBLE, clustering_coefficient) * 0.15::DOUBLE ELSE 0 END
        + CASE WHEN is_outlier THEN 0.20::DOUBLE ELSE 0 END
        + CASE WHEN NOT is_outlier AND cluster_size <= 10 THEN 0.10::DOUBLE ELSE 0 END
        + CASE WHEN num_connected_employees >= 2 THEN 0.05::DOUBLE ELSE 0 END
        + CASE WHEN in_degree + out_degree > 50 THEN 0.05::DOUBLE ELSE 0 END, 4)) AS graph_anomaly_score,
        coalesce(nullif(concat_ws('; ', CASE WHEN is_on_any_cycle THEN 'participates in circular transfer cycle' END,
        CASE WHEN betweenness_centrality > 0 AND fl >= 0.4 THEN
            'high flow betweenness centrality (bc=' || printf('%.2e', betweenness_centrality) || ')' END,
        CASE WHEN clustering_coefficient >= 0.05 THEN
            'elevated clustering coefficient (cc=' || printf('%.3f', clustering_coefficient) || ')' END,
        CASE WHEN is_outlier THEN 'topological outlier in Node2Vec space (DBSCAN outlier)' END,
        CASE WHEN NOT is_outlier AND cluster_size <= 10 THEN 'isolated micro-cluster (size=' || cluster_size || ')' END,
        CASE WHEN num_connected_employees >= 2 THEN
            'multiple connected employees (' || num_connected_employees || ' internal contacts)' END,
        CASE WHEN in_degree + out_degree > 50 THEN
            'high transaction volume (in=' || in_degree || ', out=' || out_degree || ')' END), ''),
        'baseline structural profile; no graph anomalies detected') AS contributing_factors FROM scored""",
}
_BIG = {
    "big": "SELECT DISTINCT from_account AS u, to_account AS v FROM ledger WHERE amount_paid >= 150.0 AND "
    "from_account <> to_account",
}


def _graph(body, **extra):
    return sql(body, *GRAPH_RELATIONS, recursive=True, **ACCOUNTS, **GRAPH, **extra)


def _clusters(body, *needed, **extra):
    return sql(body, *needed, recursive=True, **CLUSTERS, **extra)


CYCLES = range(2, 5)


def _cycles(n):
    """The smallest closed way of ``n`` edges through each account that has no shorter one."""
    steps = "".join(f" JOIN e e{i} ON e{i}.u = e{i - 1}.v" for i in range(2, n + 1))
    shorter = " UNION ALL ".join(f"SELECT account_id FROM cycles{m}" for m in range(2, n))
    start = f"(SELECT * FROM e WHERE u NOT IN ({shorter}))" if shorter else "e"
    path = ", ".join(f"e{i}.u" for i in range(1, n + 1))
    return f"SELECT e1.u AS account_id, min([{path}]) AS path FROM {start} e1{steps} WHERE e{n}.v = e1.u GROUP BY 1"


QUERIES = {
    "investigation_ledger": (
        investigation_ledger,
        _graph("SELECT transaction_id, from_account, to_account, amount_paid, is_synthetic FROM inv"),
    ),
    "graph_nodes": (graph_nodes, _graph("SELECT * FROM nodes")),
    "graph_edges": (
        graph_edges,
        _graph("SELECT source_id, target_id, edge_type, epoch_us(ts) AS ts_us, record_id, is_synthetic, metadata FROM edges"),
    ),
    "type_histogram": (
        type_histogram,
        _graph(
            "SELECT node_type AS type, count(*) AS count, 'node' AS part FROM nodes GROUP BY 1 UNION ALL SELECT edge_type, "
            "count(*), 'edge' FROM edges GROUP BY 1"
        ),
    ),
    "account_degrees": (
        degrees,
        _graph(
            "SELECT account_id, coalesce(degree, 0) AS degree, coalesce(in_degree, 0) AS in_degree, coalesce(out_degree, 0) "
            "AS out_degree FROM anodes LEFT JOIN deg USING (account_id)"
        ),
    ),
    "cycle_accounts": (cycle_accounts, _graph("SELECT account_id FROM cyc")),
    "high_value_cycle_accounts": (
        high_value_cycle_accounts,
        sql(
            "SELECT DISTINCT s AS account_id FROM w WHERE s = v",
            "ledger", recursive=True, **_BIG,
            **{"w(s, v, h)": "SELECT u, v, 1 FROM big UNION SELECT s, b.v, h + 1 FROM w JOIN big b ON b.u = w.v WHERE h < 6"},
        ),
    ),
    "shortest_cycles": (
        shortest_cycles,
        _graph(
            " UNION ALL ".join(f"SELECT account_id, {n} AS cycle_length, array_to_string(path, '>') AS path FROM cycles{n}" for n in CYCLES),
            **{f"cycles{n}": _cycles(n) for n in CYCLES},
        ),
    ),
    "betweenness": (betweenness, _graph(f"SELECT account_id, {r6('betweenness_centrality', digits=9)} FROM btw")),
    "betweenness_estimate": (betweenness_estimate, None),
    "clustering_coefficients": (clustering, _graph(f"SELECT account_id, {r6('clustering_coefficient')} FROM clu")),
    "connected_employees": (connected_employees, _graph("SELECT * FROM cemp")),
    "structural_features": (
        structural_features,
        _graph(
            "SELECT * REPLACE (round(betweenness_centrality + 1e-9, 6) AS betweenness_centrality, "
            "round(clustering_coefficient + 1e-9, 6) AS clustering_coefficient) FROM struct"
        ),
    ),
    "account_projection": (account_projection, _graph("SELECT u AS src, v AS dst FROM sym")),
    "random_walks": (
        random_walks,
        _graph(
            f"SELECT start, walk, array_to_string(path, '>') AS path FROM walks WHERE step = {WALK_LENGTH - 1}",
            nb="SELECT u, v, row_number() OVER (PARTITION BY u ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY u) AS n "
            "FROM sym",
            **{
                "walks(start, walk, step, node, path)": f"""SELECT account_id, w, 0, account_id, [account_id] FROM anodes,
                    unnest(range({WALKS})) AS x(w)
                    UNION ALL SELECT k.start, k.walk, k.step + 1, coalesce(nb.v, k.node), CASE WHEN nb.v IS NULL THEN k.path
                    ELSE list_append(k.path, nb.v) END FROM (SELECT *, CAST('0x' || substr(md5('42:' || start || ':' || walk
                    || ':' || (step + 1)), 1, 8) AS BIGINT) AS h FROM walks WHERE step < {WALK_LENGTH - 1}) k
                    LEFT JOIN nb ON nb.u = k.node AND nb.i = k.h % nb.n"""
            },
        ),
    ),
    "neighbour_counts": (
        neighbour_counts,
        _clusters(f"SELECT a AS vec_id, count(*) AS neighbours FROM dist WHERE d <= {EPS} GROUP BY 1"),
    ),
    "density_clusters": (density_clusters, _clusters("SELECT eps, vec_id, cluster_label FROM lab")),
    "eps_report": (
        eps_report,
        _clusters(
            "SELECT eps, count(DISTINCT cluster_label) FILTER (cluster_label >= 0) AS clusters, count(*) FILTER "
            "(cluster_label = -1) AS outliers, round(count(*) FILTER (cluster_label = -1) * 100.0::DOUBLE / count(*) + 1e-9, "
            "6) AS outlier_percent FROM lab GROUP BY 1"
        ).replace("SELECT eps, count(DISTINCT", "SELECT round(eps + 1e-9, 6) AS eps, count(DISTINCT"),
    ),
    "account_clusters": (account_clusters, _clusters("SELECT * FROM clusters")),
    "structure_with_clusters": (
        structure_with_clusters,
        _graph(
            "SELECT account_id, degree, in_degree, out_degree, cluster_label, cluster_size, is_outlier FROM deg JOIN "
            "clusters USING (account_id)",
            **CLUSTERS,
        ),
    ),
    "scenario_clusters": (scenario_clusters, _clusters(_PLACED, "scenario_accounts")),
    "cluster_shares": (
        cluster_shares,
        _clusters(
            "SELECT scenario_type, count(*) AS accounts, count(*) FILTER (is_outlier) AS outliers, count(*) FILTER "
            "(is_small_or_outlier) AS small_or_outliers, round(count(*) FILTER (is_small_or_outlier) * 100.0::DOUBLE / "
            f"count(*) + 1e-9, 6) AS small_or_outlier_percent FROM ({_PLACED}) GROUP BY 1",
            "scenario_accounts",
        ),
    ),
    "graph_scores": (graph_scores, _graph("SELECT * FROM scores", **CLUSTERS, **SCORES)),
    "scenario_scores": (
        scenario_scores,
        _graph(
            "SELECT scenario_id, scenario_type, account_id, graph_anomaly_score, contributing_factors FROM (SELECT "
            "scenario_id, scenario_type, s.account_id, coalesce(graph_anomaly_score, 0) AS graph_anomaly_score, "
            "coalesce(contributing_factors, 'no data') AS contributing_factors, row_number() OVER (PARTITION BY scenario_id "
            "ORDER BY coalesce(graph_anomaly_score, 0) DESC, pos) AS rn FROM scenario_accounts s LEFT JOIN scores USING "
            "(account_id)) WHERE rn = 1",
            **CLUSTERS, **SCORES,
        ),
    ),
    "evidence_groups": (
        evidence_groups,
        _graph(
            "SELECT account_id, min(b) AS group_id FROM conn GROUP BY 1",
            **{
                "conn(account_id, b)": "SELECT account_id, account_id FROM anodes UNION SELECT c.account_id, x.v FROM conn c "
                "JOIN (SELECT from_account AS u, to_account AS v FROM injected UNION SELECT to_account, from_account FROM "
                "injected) x ON x.u = c.b"
            },
        ),
    ),
    "trade_components": (
        trade_components,
        sql(
            "SELECT id, min(b) AS component FROM reach GROUP BY 1",
            "trade",
            recursive=True,
            **{
                "pairs": "SELECT DISTINCT 'C' || from_account AS u, 'S' || to_account AS v FROM trade",
                "reach(id, b)": "SELECT u, u FROM pairs UNION SELECT v, v FROM pairs UNION SELECT r.id, x.v FROM reach r "
                "JOIN (SELECT u, v FROM pairs UNION ALL SELECT v, u FROM pairs) x ON x.u = r.b",
            },
        ),
    ),
}
