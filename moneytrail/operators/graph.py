"""The typed investigation graph as node and edge tables, and simple measures on it."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import money
from ..session import materialize
from . import graph_search, mapped
from .entities import distinct_ids, explode_ids, ledger_touching

# Accounts by number whose triangles are listed at a time.
BLOCK = 2048

LEDGER_COLUMNS = [
    "transaction_id", "ts", "from_account", "to_account", "amount_paid", "payment_currency", "payment_format",
    "is_laundering", "is_synthetic",
]


def investigation_ledger(real: DataFrame, injected: DataFrame, scenarios: DataFrame, access_events: DataFrame) -> DataFrame:
    """All injected payments, and real ones touching an account of a scenario or an access event."""
    wanted = distinct_ids((scenarios, "account_id"), (access_events, "target_account_id"))
    kept = ledger_touching(real.withColumn("is_synthetic", F.lit(False)).select(*LEDGER_COLUMNS), wanted)
    return injected.withColumn("is_synthetic", F.lit(True)).select(*LEDGER_COLUMNS).unionByName(kept)


def build_nodes(employees: DataFrame, customers: DataFrame, accounts: DataFrame, ledger: DataFrame) -> DataFrame:
    """node_id, node_type, label; accounts known only from payments are external counterparties."""

    def node(df, key: str, kind: str, label: Column):
        return df.select(F.col(key).cast("string").alias("node_id"), F.lit(kind).alias("node_type"), label.alias("label"))

    external = distinct_ids((ledger, "from_account"), (ledger, "to_account")).join(
        accounts.select("account_id"), "account_id", "left_anti"
    )
    bank = F.coalesce(F.concat(F.lit("Bank "), F.col("bank_id").cast("string")), F.lit("Unknown Bank"))
    kind = F.when(F.col("is_synthetic"), "SYNTHETIC").otherwise("REAL")
    # Fixed formats of the labels.
    parts = [
        node(employees, "employee_id", "Employee", F.format_string("%s (%s, %s)", "name", "role", "department")),
        node(customers, "customer_id", "Customer", F.format_string("%s (%s, Risk: %s)", "name", "country", "risk_rating")),
        node(accounts, "account_id", "Account", F.format_string("Account %s (%s)", F.col("account_id"), bank)),
        node(external, "account_id", "Account", F.format_string("Account %s (External Counterparty)", "account_id")),
        node(
            ledger,
            "transaction_id",
            "Transaction",
            F.format_string(
                "[%s] %s: %s %s via %s",
                kind,
                F.col("transaction_id"),
                money(F.coalesce("amount_paid", F.lit(0.0))),
                F.coalesce("payment_currency", F.lit("USD")),
                F.coalesce("payment_format", F.lit("Payment")),
            ),
        ),
    ]
    return reduce(DataFrame.unionByName, parts)


def build_edges(
    customers: DataFrame,
    employee_map: DataFrame,
    access_events: DataFrame,
    profile_changes: DataFrame,
    ledger: DataFrame,
) -> DataFrame:
    """Six edge types.  ``record_id`` names the source record; ``metadata`` is JSON text."""

    def edge(df, kind, source, target, ts, record, synthetic, **metadata):
        return df.select(
            F.col(source).alias("source_id"),
            F.col(target).alias("target_id"),
            F.lit(kind).alias("edge_type"),
            (F.col(ts) if ts else F.lit(None).cast("timestamp")).alias("ts"),
            (F.col(record) if record else F.lit(None).cast("string")).alias("record_id"),
            (F.col("is_synthetic") if synthetic else F.lit(None).cast("boolean")).alias("is_synthetic"),
            F.to_json(F.struct(*[c.alias(n) for n, c in metadata.items()])).alias("metadata"),
        )

    owned = explode_ids(customers, "account_ids", "_account", ",")
    touched = explode_ids(access_events, "target_account_id")
    amount = F.coalesce("amount_paid", F.lit(0.0))
    roles = ledger.withColumn(
        "_end",
        F.explode(
            F.array(
                F.struct(F.col("from_account").alias("account"), F.lit("sender").alias("role")),
                F.struct(F.col("to_account").alias("account"), F.lit("receiver").alias("role")),
            )
        ),
    ).withColumns({"_account": F.col("_end.account"), "_role": F.col("_end.role")})
    parts = [
        edge(owned, "OWNS", "customer_id", "_account", None, None, False, relationship=F.lit("owner")),
        edge(
            employee_map, "MANAGES", "employee_id", "customer_id", None, None, False,
            relationship_type=F.col("relationship_type"),
        ),
        edge(
            touched, "CHANGED_ACCESS", "employee_id", "account_id", "ts", "event_id", False,
            event_id=F.col("event_id"), action=F.col("action"), old_value=F.col("old_value"), new_value=F.col("new_value"),
        ),
        edge(
            profile_changes, "EDITED_PROFILE", "changed_by_employee_id", "customer_id", "ts", "change_id", False,
            change_id=F.col("change_id"), field_changed=F.col("field_changed"),
        ),
        edge(
            ledger, "SENT_TO", "from_account", "to_account", "ts", "transaction_id", True,
            transaction_id=F.col("transaction_id"), amount=amount, currency=F.col("payment_currency"),
            format=F.col("payment_format"), is_laundering=F.col("is_laundering"), is_synthetic=F.col("is_synthetic"),
        ),
        edge(
            roles, "INVOLVED_IN", "_account", "transaction_id", "ts", "transaction_id", True,
            role=F.col("_role"), amount=amount,
        ),
    ]
    return reduce(DataFrame.unionByName, parts)


def sent_edges(edges: DataFrame) -> DataFrame:
    return edges.filter(F.col("edge_type") == "SENT_TO").select(
        F.col("source_id").alias("src"), F.col("target_id").alias("dst"), "record_id", "is_synthetic"
    )


def simple_edges(sent: DataFrame) -> DataFrame:
    """Distinct directed pairs without self-loops."""
    return sent.filter(F.col("src") != F.col("dst")).select("src", "dst").distinct()


def undirected_edges(sent: DataFrame) -> DataFrame:
    """Each linked pair once in either direction: the account projection."""
    pairs = sent.filter(F.col("src") != F.col("dst")).select(
        F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")
    ).distinct()
    both = F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst"))))
    return pairs.select(both.alias("e")).select("e.src", "e.dst")


def degrees(edges: DataFrame) -> DataFrame:
    """Total degree over all edge types (a self-loop counts 2), in and out degree over payments."""
    ends = F.explode(
        F.array(
            F.struct(F.col("source_id").alias("account_id"), F.lit(1).alias("out")),
            F.struct(F.col("target_id").alias("account_id"), F.lit(0).alias("out")),
        )
    )
    rows = edges.select("edge_type", ends.alias("e")).select("edge_type", "e.*")
    paid = F.col("edge_type") == "SENT_TO"
    return rows.groupBy("account_id").agg(
        F.count(F.lit(1)).alias("degree"),
        F.count_if(paid & (F.col("out") == 0)).alias("in_degree"),
        F.count_if(paid & (F.col("out") == 1)).alias("out_degree"),
    )


def clustering(simple: DataFrame) -> DataFrame:
    """Directed clustering coefficient of every account with payments.

    Triangles are listed once, from their end of lowest degree: with edges oriented towards the
    end of higher degree no account has more than sqrt(2 * pairs) outgoing ones, so a hub adds
    no pairs of its own.  A pair linked both ways weighs 2.
    """
    pairs = simple.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(
        F.count(F.lit(1)).alias("w")
    )
    in_files = graph_search.MAPPED_LINKS[0] <= simple.count() <= graph_search.MAPPED_LINKS[1]
    if in_files:
        pairs = materialize(pairs, "pairs")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("account_id"), "w")
    sizes = ends.groupBy("account_id").agg(
        F.sum("w").alias("total"), F.count_if(F.col("w") == 2).alias("mutual"), F.count(F.lit(1)).alias("n")
    )
    counts = _mapped_triangles(pairs, sizes) if in_files else _joined_triangles(pairs, sizes)
    possible = 2 * (F.col("total") * (F.col("total") - 1) - 2 * F.col("mutual"))
    value = F.when(F.col("t") > 0, F.col("t") / possible).otherwise(0.0)
    return sizes.join(counts, "account_id", "left").select("account_id", value.alias("clustering_coefficient"))


def _joined_triangles(pairs: DataFrame, sizes: DataFrame) -> DataFrame:
    """(account_id, t): twice the triangles of each account by the weights of their sides."""
    rank_a = sizes.select(F.col("account_id").alias("a"), F.struct("n", "account_id").alias("ra"))
    rank_b = sizes.select(F.col("account_id").alias("b"), F.struct("n", "account_id").alias("rb"))
    ranked = pairs.join(rank_a, "a").join(rank_b, "b")
    up = F.col("ra") < F.col("rb")
    oriented = ranked.select(
        F.when(up, F.col("a")).otherwise(F.col("b")).alias("low"),
        F.when(up, F.col("b")).otherwise(F.col("a")).alias("high"),
        F.greatest("ra", "rb").alias("rank"),
        "w",
    )
    first = oriented.select("low", F.col("high").alias("x"), F.col("rank").alias("rx"), F.col("w").alias("wx"))
    second = oriented.select("low", F.col("high").alias("y"), F.col("rank").alias("ry"), F.col("w").alias("wy"))
    wedges = first.join(second, "low").filter(F.col("rx") < F.col("ry"))
    closing = oriented.select(F.col("low").alias("x"), F.col("high").alias("y"), F.col("w").alias("wz"))
    triangles = wedges.join(closing, ["x", "y"]).select(
        F.explode(F.array("low", "x", "y")).alias("account_id"), (2 * F.col("wx") * F.col("wy") * F.col("wz")).alias("t")
    )
    return triangles.groupBy("account_id").agg(F.sum("t").alias("t"))


def _mapped_triangles(pairs: DataFrame, sizes: DataFrame) -> DataFrame:
    """The same from a file that tasks map: accounts are numbered by degree, and a pair of weight 2 is listed twice."""
    spark = pairs.sparkSession
    ranked = materialize(sizes.select("account_id", "n"), "sizes")
    named, count = mapped.share_names(ranked, [F.col("n"), F.col("account_id")])
    ranks = ranked.select("account_id", F.struct("n", "account_id").alias("rank"))
    links = pairs.join(ranks.toDF("a", "ra"), "a").join(ranks.toDF("b", "rb"), "b")
    up = F.col("ra") < F.col("rb")
    ends = F.when(up, F.struct(F.col("a").alias("src"), F.col("b").alias("dst"))).otherwise(F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))
    links = links.select(F.explode(F.array_repeat(ends, F.col("w").cast("int"))).alias("e")).select("e.src", "e.dst")
    near_file, begin_file = mapped.share_links(links, named, count)

    def counted(batches):
        names = mapped.mapped_names(named)
        near, begin = np.asarray(mapped.mapped_array(near_file)), np.asarray(mapped.mapped_array(begin_file))
        total = np.zeros(count)
        for batch in batches:
            for block in batch.column(0).to_pylist():
                first, last = block * BLOCK, min((block + 1) * BLOCK, count)
                low = np.repeat(np.arange(first, last), np.diff(begin[first : last + 1]))
                middle = near[begin[first] : begin[last]].astype(np.int64)
                sides = low * count + middle  # in ascending order
                for at, high in graph_search._spread(middle, begin, near):
                    at, high = at[high > middle[at]], high[high > middle[at]]
                    third = low[at] * count + high
                    place = np.searchsorted(sides, third)
                    there = np.flatnonzero(sides[np.minimum(place, len(sides) - 1)] == third)
                    at, high, third = at[there], high[there], third[there]
                    weight = 2.0 * (np.searchsorted(sides, third, side="right") - place[there])
                    for end in (low[at], middle[at], high):
                        total += np.bincount(end, weight, count)
        some = np.flatnonzero(total)
        yield pa.record_batch([names.take(pa.array(some)), pa.array(total[some].astype(np.int64))], ["account_id", "t"])

    blocks = -(-count // BLOCK)
    tasks = min(blocks, 4 * spark.sparkContext.defaultParallelism)
    every = spark.range(0, blocks).repartition(max(1, tasks), "id")
    found = every.mapInArrow(counted, "account_id string, t bigint")
    return found.groupBy("account_id").agg(F.sum("t").alias("t"))


def connected_employees(edges: DataFrame, accounts: DataFrame, account_nodes: DataFrame) -> DataFrame:
    """Distinct employees that changed access to an account or manage its customer."""
    linked = account_nodes.join(accounts.select("account_id", "linked_customer_id"), "account_id", "left").select(
        "account_id", F.coalesce("linked_customer_id", "account_id").alias("customer_id")
    )
    access = edges.filter(F.col("edge_type") == "CHANGED_ACCESS").select(
        F.col("target_id").alias("account_id"), F.col("source_id").alias("employee_id")
    )
    manages = edges.filter(F.col("edge_type") == "MANAGES").select(
        F.col("target_id").alias("customer_id"), F.col("source_id").alias("employee_id")
    )
    both = access.unionByName(manages.join(linked, "customer_id").select("account_id", "employee_id"))
    return both.groupBy("account_id").agg(F.count_distinct("employee_id").alias("num_connected_employees"))


def structural_features(
    nodes: DataFrame, edges: DataFrame, accounts: DataFrame, betweenness: DataFrame, on_cycle: DataFrame
) -> DataFrame:
    """One row per account node with all graph measures; missing ones are zero."""
    spine = nodes.filter(F.col("node_type") == "Account").select(F.col("node_id").alias("account_id")).distinct()
    joined = (
        spine.join(degrees(edges), "account_id", "left")
        .join(betweenness, "account_id", "left")
        .join(clustering(simple_edges(sent_edges(edges))), "account_id", "left")
        .join(connected_employees(edges, accounts, spine), "account_id", "left")
        .join(on_cycle.select("account_id", F.lit(True).alias("is_on_any_cycle")), "account_id", "left")
    )
    return joined.fillna(0).fillna(False).select(
        "account_id", "degree", "in_degree", "out_degree", "betweenness_centrality", "clustering_coefficient",
        "is_on_any_cycle", "num_connected_employees",
    )
