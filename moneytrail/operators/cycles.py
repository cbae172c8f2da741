"""Time-ordered payment chains and closed rings.

A chain that starts at ``t`` must end by ``t + hours``, its deadline.  Payments are listed once for every
slot of deadlines they may serve, so a chain meets the payments that may follow it in an equi-join on
(slot, account), and a busy account's payments lie in many small groups.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .windows import MICROS_PER_HOUR, micros

SLOT_HOURS = 24
# Payments that paths grow by, and the frontier goes back, between two tables.
HOPS = 3


def trim_to_rings(edges: DataFrame, rounds: int = 2) -> DataFrame:
    """Drop payments that cannot lie on a ring: both ends must pay and be paid."""
    for _ in range(rounds):
        payers = edges.select(F.col("from_account").alias("_a")).distinct()
        payees = edges.select(F.col("to_account").alias("_b")).distinct()
        edges = edges.join(payees, edges.from_account == F.col("_b"), "left_semi").join(
            payers, edges.to_account == F.col("_a"), "left_semi"
        )
        edges = materialize(edges, "trimmed")
    return edges


def _transfers(payments: DataFrame) -> DataFrame:
    return payments.filter(F.col("from_account") != F.col("to_account")).select(
        "transaction_id", "from_account", "to_account", F.unix_micros("ts").alias("us")
    )


def _by_slot(edges: DataFrame, hours: float, slot_us: int) -> DataFrame:
    """Each payment with every slot of deadlines of which a chain may hold it."""
    slots = F.sequence(F.floor(F.col("us") / slot_us), F.floor((F.col("us") + micros(hours)) / slot_us))
    return edges.select(F.explode(slots).alias("slot"), "transaction_id", "from_account", "to_account", "us")


def _first_steps(edges: DataFrame, hours: float, slot_us: int) -> DataFrame:
    deadline = F.col("us") + micros(hours)
    return edges.select(
        F.floor(deadline / slot_us).alias("slot"), F.col("from_account").alias("origin"), F.col("us").alias("start_us"),
        deadline.alias("deadline"), F.col("to_account").alias("node"), F.col("us").alias("last_us"),
        F.array("transaction_id").alias("ids"), F.array("from_account").alias("accounts"),
    )


def _extend(paths: DataFrame, listed: DataFrame) -> DataFrame:
    """Every open path with each payment that can follow it in time; closed ones stay as they are."""
    steps = listed.select(
        "slot", F.col("from_account").alias("node"), F.col("to_account").alias("next_node"), F.col("us").alias("next_us"),
        F.col("transaction_id").alias("next_id"),
    )
    closed = F.col("p.node") == F.col("p.origin")
    follows = (F.col("s.slot") == F.col("p.slot")) & (F.col("s.node") == F.when(~closed, F.col("p.node")))
    in_time = F.col("next_us").between(F.col("last_us"), F.col("deadline"))
    grown = paths.alias("p").join(steps.alias("s"), follows & in_time, "left").filter(closed | F.col("next_id").isNotNull())
    moved = F.col("next_id").isNotNull()
    return grown.select(
        "p.slot", "origin", "start_us", "deadline", F.coalesce("next_node", "p.node").alias("node"),
        F.coalesce("next_us", "last_us").alias("last_us"),
        F.when(moved, F.concat("ids", F.array("next_id"))).otherwise(F.col("ids")).alias("ids"),
        F.when(moved, F.concat("accounts", F.array("p.node"))).otherwise(F.col("accounts")).alias("accounts"),
    )


def payment_chains(payments: DataFrame, hours: float, slot_hours: float = SLOT_HOURS) -> DataFrame:
    """Pairs of payments where the payee pays on to a third account within ``hours``."""
    slot_us = int(slot_hours * MICROS_PER_HOUR)
    edges = _transfers(payments)
    grown = _extend(_first_steps(edges, hours, slot_us), _by_slot(edges, hours, slot_us))
    return grown.filter(F.col("node") != F.col("origin")).select(
        "origin", "node", F.col("ids")[0].alias("first_id"), F.col("ids")[1].alias("second_id"),
        (F.col("last_us") - F.col("start_us")).alias("span_us"),
    )


def return_frontier(listed: DataFrame, max_hops: int | None = None) -> DataFrame:
    """(slot, origin, node, latest_us): until when money may leave an account and still come back to the origin.

    Goes backward from the payments that close a ring, a few payments a round, and keeps the latest time
    of each account only, so it has a row for each pair of accounts and slot, not one for each way.
    Rounds end when no time gets later, or after as many payments as a ring has behind its first one.
    ``listed`` has payments by slot; chains of a slot hold no others.
    """
    keys = ["slot", "origin", "node"]
    inward = listed.select("slot", F.col("to_account").alias("node"), F.col("from_account").alias("payer"), "us")
    closing = listed.groupBy("slot", F.col("to_account").alias("origin"), F.col("from_account").alias("node"))
    known = materialize(closing.agg(F.max("us").alias("latest_us")).withColumn("later", F.lit(True)), "frontier")
    hops = 1
    while (max_hops is None or hops < max_hops - 1) and not (changed := known.filter("later")).isEmpty():
        found = [known.select(*keys, F.col("latest_us").alias("was"), "latest_us")]
        for _ in range(HOPS):
            hops += 1
            back = changed.join(inward, ["slot", "node"]).filter("us <= latest_us AND payer <> origin")
            back = back.groupBy("slot", "origin", F.col("payer").alias("node"))
            changed = back.agg(F.lit(None).cast("bigint").alias("was"), F.max("us").alias("latest_us"))
            found.append(changed)
        best = reduce(DataFrame.unionByName, found).groupBy(*keys).agg(F.max("was").alias("was"), F.max("latest_us").alias("latest_us"))
        later = F.col("was").isNull() | (F.col("latest_us") > F.col("was"))
        known = materialize(best.select(*keys, "latest_us", later.alias("later")), "frontier")
    return known.select(*keys, "latest_us")


def circular_transfers(
    payments: DataFrame,
    hours: float = 48,
    minimum: int = 3,
    max_hops: int | None = None,
    slot_hours: float = SLOT_HOURS,
) -> DataFrame:
    """Rings of at least ``minimum`` payments in time order, all within ``hours`` of the first.

    No account repeats.  Rotations of one ring are one result, kept with its earliest start.
    ``max_hops=None`` goes on until no path can grow.  A path grows only from accounts out of which
    money can still come back to its origin in time (``return_frontier``).
    """
    slot_us = int(slot_hours * MICROS_PER_HOUR)
    edges = trim_to_rings(_transfers(payments))
    listed = materialize(_by_slot(edges, hours, slot_us), "listed")
    frontier = return_frontier(listed, max_hops)

    closed = F.col("node") == F.col("origin")

    def returning(paths: DataFrame) -> DataFrame:
        """Paths that are closed or can still be."""
        judged = paths.join(frontier, ["slot", "origin", "node"], "left")
        return judged.filter(closed | (F.col("last_us") <= F.col("latest_us"))).drop("latest_us")

    paths, rings, hops = returning(_first_steps(edges, hours, slot_us)), [], 1
    while max_hops is None or hops < max_hops:
        for _ in range(HOPS if max_hops is None else min(HOPS, max_hops - hops)):
            hops += 1
            paths = _extend(paths, listed).filter(closed | ~F.array_contains("accounts", F.col("node")))
            paths = returning(paths.filter(~closed | (F.size("ids") >= minimum)))
        grown = materialize(paths, "paths")
        rings.append(grown.filter(closed))
        paths = grown.filter(~closed)
        if paths.isEmpty():
            break
    found = rings[0] if rings else paths.filter(F.lit(False))
    for more in rings[1:]:
        found = found.unionByName(more)
    smallest = F.array_position("ids", F.array_min("ids")).cast("int")
    size = F.size("ids")
    turned = F.concat(F.slice("ids", smallest, size), F.slice("ids", F.lit(1), smallest - 1))
    kept = found.groupBy(turned.alias("ring")).agg(
        F.min_by(F.struct("origin", "start_us", "last_us", "ids", "accounts"), F.struct("start_us", F.col("ids")[0])).alias("r")
    )
    return kept.select(
        F.col("r.origin").alias("account_id"),
        F.col("r.ids").alias("transaction_ids"),
        F.col("r.accounts").alias("accounts"),
        F.size("r.ids").alias("transaction_count"),
        F.timestamp_micros("r.start_us").alias("window_start"),
        F.timestamp_micros("r.last_us").alias("window_end"),
    )
