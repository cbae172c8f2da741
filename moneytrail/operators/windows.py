"""Time-window measures per account, computed by a sweep over time.

A window of every payment would overlap with thousands of others at a busy account, so no
window is ever collected.  Each payment is turned into a few time marks, the marks of an
account are put in order once, and running sums over them give counts at window ends.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .skew import HOT_ROWS, running

MICROS_PER_HOUR = 3_600_000_000


def micros(hours: float) -> int:
    return int(hours * MICROS_PER_HOUR)


def splitting_windows(
    payments: DataFrame,
    hours: float = 48,
    minimum: int = 3,
    boundary: float = 10000,
    limit: int = HOT_ROWS,
) -> DataFrame:
    """For every payment: the sender's payments from it on, up to ``hours`` later.

    Kept when there are at least ``minimum`` and one lies below ``boundary``.  A window is
    described by the positions of its first and last payment among the sender's payments.
    """
    us, below = F.unix_micros("ts"), (F.col("amount_paid") < boundary).cast("bigint")
    opens = F.struct(us.alias("at"), F.lit(0).alias("mark"))
    closes = F.struct((us + micros(hours)).alias("at"), F.lit(1).alias("mark"))
    marks = payments.select(
        "from_account",
        "transaction_id",
        us.alias("us"),
        below.alias("below"),
        F.explode(F.array(opens, closes)).alias("m"),
    ).select("from_account", "transaction_id", "us", "below", "m.at", "m.mark")
    payment = F.col("mark") == 0
    swept = running(
        marks,
        ["from_account"],
        [F.col("at"), F.col("mark"), F.col("transaction_id")],
        {
            "n": ("sum", payment.cast("bigint")),
            "b": ("sum", F.when(payment, F.col("below")).otherwise(F.lit(0).cast("bigint"))),
            "last_us": ("max", F.when(payment, F.col("us"))),
        },
        limit=limit,
    )
    windows = swept.groupBy("from_account", "transaction_id").agg(
        F.max(F.when(payment, F.col("n"))).alias("first_position"),
        F.max(F.when(~payment, F.col("n"))).alias("last_position"),
        (F.max(F.when(~payment, F.col("b"))) - F.max(F.when(payment, F.col("b") - F.col("below")))).alias("below_count"),
        F.max("us").alias("start_us"),
        F.max(F.when(~payment, F.col("last_us"))).alias("end_us"),
    )
    size = F.col("last_position") - F.col("first_position") + 1
    return (
        windows.withColumn("outgoing_transaction_count", size)
        .filter((size >= minimum) & (F.col("below_count") > 0))
        .select(
            "from_account",
            "transaction_id",
            "first_position",
            "last_position",
            "outgoing_transaction_count",
            "below_count",
            F.timestamp_micros("start_us").alias("window_start"),
            F.timestamp_micros("end_us").alias("window_end"),
        )
    )


def window_members(windows: DataFrame, positioned: DataFrame, block: int = 1024) -> DataFrame:
    """The payments inside each splitting window.

    ``positioned`` holds ``from_account``, ``position`` and payment columns.  Positions are cut
    into blocks and joined by (account, block), so a busy account is spread over many tasks.
    """
    spans = windows.select(
        "from_account",
        F.col("transaction_id").alias("window_id"),
        "first_position",
        "last_position",
        F.explode(
            F.sequence(F.floor(F.col("first_position") / block), F.floor(F.col("last_position") / block))
        ).alias("block"),
    )
    members = positioned.withColumn("block", F.floor(F.col("position") / block))
    inside = F.col("position").between(F.col("first_position"), F.col("last_position"))
    return (
        spans.join(members, ["from_account", "block"])
        .filter(inside)
        .withColumn("member_number", F.col("position") - F.col("first_position") + 1)
        .drop("block", "first_position", "last_position", "position")
    )


def span_coverage(spans: DataFrame, positioned: DataFrame, limit: int = HOT_ROWS) -> DataFrame:
    """The payments that at least one span covers, with ``covered``: how many spans do.

    ``spans`` holds ``from_account``, ``first_position`` and ``last_position``; ``positioned`` holds
    ``from_account``, ``position`` and payment columns.  A running sum of starts and ends gives the
    number, so no payment is repeated per span.
    """
    edges = F.explode(
        F.array(
            F.struct(F.col("first_position").alias("position"), F.lit(1).cast("bigint").alias("step")),
            F.struct((F.col("last_position") + 1).alias("position"), F.lit(-1).cast("bigint").alias("step")),
        )
    )
    # One mark per position, however many spans begin or end there.
    marks = spans.select("from_account", edges.alias("e")).groupBy("from_account", F.col("e.position").alias("position")).agg(
        F.sum("e.step").alias("step")
    )
    payments = positioned.withColumns({"step": F.lit(0).cast("bigint"), "mark": F.lit(1)})
    swept = running(
        payments.unionByName(marks.withColumn("mark", F.lit(0)), allowMissingColumns=True),
        ["from_account"], [F.col("position"), F.col("mark")], {"covered": ("sum", F.col("step"))}, limit=limit,
    )
    return swept.filter("mark = 1 and covered > 0").drop("step", "mark")


def fan_windows(
    payments: DataFrame,
    hub: str,
    other: str,
    hours: float,
    minimum: int,
    limit: int = HOT_ROWS,
) -> DataFrame:
    """Payments of a hub that open a window with at least ``minimum`` distinct counterparties.

    A counterparty counts at time t if it has a payment in [t, t + hours].  The times at which
    one of its payments is the next one form disjoint intervals, so the distinct count is a
    running sum of interval starts (+1) and ends (-1).
    """
    width = micros(hours)
    rows = payments.select(
        F.col(hub).alias("hub"), F.col(other).alias("other"), "transaction_id", F.unix_micros("ts").alias("us")
    )
    rows = running(
        rows, ["hub", "other"], [F.col("us"), F.col("transaction_id")], {"earlier": ("max", F.col("us"))},
        inclusive=False, limit=limit,
    )
    us = F.col("us")
    since = F.greatest(us - width, F.coalesce(F.col("earlier") + 1, us - width))

    def mark(at, kind, step):
        return F.struct(
            at.alias("at"), F.lit(kind).alias("mark"), F.lit(step).cast("bigint").alias("step")
        )

    payment, deadline = mark(us, 1, 0), mark(us + width, 2, 0)
    counted = F.array(mark(since, 0, 1), mark(us + 1, 0, -1), payment, deadline)
    marks = F.when(since <= us, counted).otherwise(F.array(payment, deadline))
    swept = running(
        rows.select("hub", "transaction_id", "us", F.explode(marks).alias("m")).select(
            "hub", "transaction_id", "us", "m.*"
        ),
        ["hub"],
        [F.col("at"), F.col("mark"), F.col("transaction_id"), F.col("step")],
        {"n": ("sum", F.col("step")), "last_us": ("max", F.when(F.col("mark") == 1, F.col("us")))},
        limit=limit,
    )
    found = swept.filter("mark > 0").groupBy("hub", "transaction_id").agg(
        F.max(F.when(F.col("mark") == 1, F.col("n"))).alias("counterparties"),
        F.max("us").alias("start_us"),
        F.max(F.when(F.col("mark") == 2, F.col("last_us"))).alias("end_us"),
    )
    return found.filter(F.col("counterparties") >= minimum)


def fan_out(payments: DataFrame, hours: float = 48, minimum: int = 3, limit: int = HOT_ROWS) -> DataFrame:
    return fan_windows(payments, "from_account", "to_account", hours, minimum, limit)


def fan_in(payments: DataFrame, hours: float = 48, minimum: int = 3, limit: int = HOT_ROWS) -> DataFrame:
    return fan_windows(payments, "to_account", "from_account", hours, minimum, limit)


def gather_scatter(gathers: DataFrame, scatters: DataFrame, hours: float = 48, limit: int = HOT_ROWS) -> DataFrame:
    """Each fan-in window with the first fan-out window of the hub that starts after it ended.

    The search for the next start is one running minimum in reverse time, not a join of all
    pairs of windows.
    """
    none = F.lit(None).cast("bigint")
    queries = gathers.select(
        "hub", "transaction_id", F.col("end_us").alias("at"), F.lit(1).alias("mark"), none.alias("scatter_us"),
        F.col("start_us").alias("gather_us"), "counterparties",
    )
    starts = scatters.select(
        "hub", "transaction_id", F.col("start_us").alias("at"), F.lit(0).alias("mark"),
        F.col("start_us").alias("scatter_us"), none.alias("gather_us"), "counterparties",
    )
    swept = running(
        queries.unionByName(starts),
        ["hub"],
        [F.col("at").desc(), F.col("mark").desc(), F.col("transaction_id")],
        {"next_us": ("min", F.col("scatter_us"))},
        limit=limit,
    )
    close = F.col("next_us") - F.col("at") <= micros(hours)
    return swept.filter((F.col("mark") == 1) & close).select(
        "hub",
        "transaction_id",
        F.col("counterparties").alias("senders"),
        F.col("gather_us").alias("gather_start_us"),
        F.col("at").alias("gather_end_us"),
        F.col("next_us").alias("scatter_start_us"),
    )


def pattern_recall(patterns: DataFrame, members: DataFrame, detections: DataFrame) -> DataFrame:
    """Labelled and detected patterns per type; detected when a member was found by that type's detector."""
    found = (
        members.join(patterns.select("alert_id", "alert_type"), "alert_id")
        .join(detections.select("alert_type", "account_id").distinct(), ["alert_type", "account_id"], "left_semi")
        .select("alert_id")
        .distinct()
        .withColumn("_found", F.lit(1))
    )
    return patterns.join(found, "alert_id", "left").groupBy("alert_type").agg(
        F.count(F.lit(1)).alias("labelled"),
        F.count("_found").alias("detected"),
        (F.count("_found") / F.count(F.lit(1))).alias("recall"),
    )
