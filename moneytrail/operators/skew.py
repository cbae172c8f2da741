"""Building blocks that keep working when one key holds a large share of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

# A key with more rows than this does not go through a single-task window.
HOT_ROWS = 2_000_000

_COMBINE = {"sum": F.sum, "max": F.max, "min": F.min}


def hot_keys(df: DataFrame, keys: Sequence[str], limit: int = HOT_ROWS) -> DataFrame | None:
    """Keys with more than ``limit`` rows, or None.

    At most ``rows / limit`` keys can qualify, so the list is small by construction and
    may be broadcast.  The count is a map-side combined aggregate over the key columns.
    """
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > limit)
    found = counted.select(*keys).collect()
    if not found:
        return None
    schema = counted.select(*keys).schema
    return df.sparkSession.createDataFrame(found, schema)


def split_hot(
    df: DataFrame, keys: Sequence[str], limit: int = HOT_ROWS
) -> tuple[DataFrame, DataFrame | None]:
    """``(rows of ordinary keys, rows of hot keys or None)``; keys must not be null."""
    hot = hot_keys(df, keys, limit)
    if hot is None:
        return df, None
    small = F.broadcast(hot)
    return df.join(small, list(keys), "left_anti"), df.join(small, list(keys), "left_semi")


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    values: dict[str, tuple[str, Column]],
    inclusive: bool = True,
    limit: int = HOT_ROWS,
) -> DataFrame:
    """Add running aggregates of each key's rows in ``order``.

    ``values`` maps an output column to ``(sum|max|min, expression)``.  ``order`` must be
    a total order.  Ordinary keys use one window.  Hot keys, and the case of no key at
    all, are cut into range slices of about equal size; each slice is scanned on its own
    and shifted by the aggregate of the slices before it.
    """
    if not keys:
        return _sliced_running(df, keys, order, values, inclusive)
    df = materialize(df, "running")  # counted for hot keys, then read by the windows
    cold, hot = split_hot(df, keys, limit)
    end = Window.currentRow if inclusive else -1
    frame = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
    result = cold.select("*", *[_COMBINE[how](x).over(frame).alias(n) for n, (how, x) in values.items()])
    if hot is not None:
        result = result.unionByName(_sliced_running(hot, keys, order, values, inclusive))
    return result


def _sliced_running(df, keys, order, values, inclusive):
    keys = list(keys)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sliced = df.repartitionByRange(parts, *[F.col(k) for k in keys], *order)
    sliced = materialize(sliced.withColumn("_slice", F.spark_partition_id()), "slices")

    end = Window.currentRow if inclusive else -1
    inner = Window.partitionBy("_slice", *keys).orderBy(*order)
    inner = inner.rowsBetween(Window.unboundedPreceding, end)
    local = sliced.select("*", *[_COMBINE[how](x).over(inner).alias(n) for n, (how, x) in values.items()])

    # One row per (slice, key): at most slices + hot keys rows, so it may be broadcast.
    totals = sliced.groupBy("_slice", *keys).agg(
        *[_COMBINE[how](x).alias(f"_total_{n}") for n, (how, x) in values.items()]
    )
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(
        "_slice",
        *keys,
        *[_COMBINE[how](f"_total_{n}").over(before).alias(f"_base_{n}") for n, (how, _) in values.items()],
    )
    merged = local.join(F.broadcast(bases), ["_slice", *keys])
    columns = []
    for name, (how, _) in values.items():
        base, own = F.col(f"_base_{name}"), F.col(name)
        if how == "sum":
            both = base + own
            columns.append(F.coalesce(both, base, own).alias(name))
        else:
            columns.append((F.greatest if how == "max" else F.least)(base, own).alias(name))
    return merged.select(*df.columns, *columns)


def positions(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "position", limit: int = HOT_ROWS
) -> DataFrame:
    """1-based position of every row within its key."""
    return running(df, keys, order, {name: ("sum", F.lit(1).cast("bigint"))}, limit=limit)


def quantiles(
    df: DataFrame, value: str, probabilities: Sequence[float], keys: Sequence[str] = (), limit: int = HOT_ROWS
) -> DataFrame:
    """Exact linearly interpolated quantiles: one row per key with columns q0, q1, ...

    Equal values are counted first, so only distinct values are ordered, and no task has
    to hold a whole column.
    """
    keys = list(keys)
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    counted = materialize(counted, "values")
    ranked = running(counted, keys, [F.col(value)], {"_through": ("sum", F.col("_n"))}, limit=limit)
    size = counted.groupBy(*keys).agg(F.sum("_n").alias("_size"))
    # With keys the sizes are joined by key; without, the size is a scalar subquery.
    ranked = ranked.join(size, keys) if keys else ranked.withColumn("_size", size.scalar())
    first, last = F.col("_through") - F.col("_n"), F.col("_through") - 1
    picks = []
    for i, p in enumerate(probabilities):
        rank = (F.col("_size") - 1) * F.lit(float(p))
        for side, at in (("lo", F.floor(rank)), ("hi", F.ceil(rank))):
            picks.append(F.max(F.when((at >= first) & (at <= last), F.col(value))).alias(f"_{side}{i}"))
    picked = ranked.groupBy(*keys).agg(F.max("_size").alias("_size"), *picks)
    columns = []
    for i, p in enumerate(probabilities):
        rank = (F.col("_size") - 1) * F.lit(float(p))
        low, high = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        columns.append((low + (rank - F.floor(rank)) * (high - low)).alias(f"q{i}"))
    return picked.select(*keys, *columns)
