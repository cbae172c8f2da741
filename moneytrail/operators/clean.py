"""Cleaning, profiling and de-duplicating payment tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_text, parse_timestamp, safe_double
from .skew import positions

# Columns that would give the label away to a model.
LABEL_COLUMNS = (
    "expected_signals",
    "scenario_type",
    "scenario_id",
    "is_laundering",
    "is_sar",
    "alert_id",
    "source",
    "is_synthetic",
    "related_event_ids",
    "related_transaction_ids",
    "description",
    "has_transactional_consequence",
    "background_real_laundering_count",
)


def drop_labels(df: DataFrame) -> DataFrame:
    return df.drop(*LABEL_COLUMNS)


def assert_no_labels(df: DataFrame) -> DataFrame:
    present = sorted(set(df.columns) & set(LABEL_COLUMNS))
    if present:
        raise ValueError(f"label columns among the features: {present}")
    return df


def usable_payments(raw: DataFrame, needs_amount: bool = True) -> DataFrame:
    """Payments whose ids are not blank, whose time parses and, if asked, whose amount is a number.

    A table without one of the needed columns holds no usable payment at all.
    """
    needed = ["transaction_id", "timestamp", "from_account", "to_account"]
    if needs_amount:
        needed += ["amount_paid", "payment_format"]
    missing = [c for c in needed if c not in raw.columns]
    for column in missing:
        raw = raw.withColumn(column, F.lit(None).cast("string"))
    texts = [c for c in needed if c != "amount_paid"]
    df = raw.withColumns({c: clean_text(F.col(c)) for c in texts}).withColumn("ts", parse_timestamp(F.col("timestamp")))
    good = F.col("ts").isNotNull()
    if needs_amount:
        df = df.withColumn("amount_paid", safe_double(F.col("amount_paid").cast("string"), None))
        good = good & F.col("amount_paid").isNotNull()
    for column in texts:
        good = good & (F.col(column) != "")
    return df.filter(good)


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of every key.  A map-side combined aggregate, so a hot key costs nothing extra."""
    row = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)]).agg(
        F.min_by(row, F.struct(*order)).alias("_row")
    ).select("_row.*")


def merge_sources(sources: Sequence[tuple[str, str, DataFrame]]) -> DataFrame:
    """Union of payment tables in priority order; the first source holding an id wins.

    ``sources`` holds ``(source_dataset, record_type, payments)``.
    """
    merged = None
    for rank, (dataset, record_type, df) in enumerate(sources):
        tagged = df.withColumns(
            {"source_dataset": F.lit(dataset), "record_type": F.lit(record_type), "_rank": F.lit(rank)}
        )
        merged = tagged if merged is None else merged.unionByName(tagged, allowMissingColumns=True)
    return keep_first(merged, ["transaction_id"], [F.col("_rank"), F.col("ts")]).drop("_rank")


def sequential_ids(df: DataFrame, order: Sequence[Column], prefix: str = "TXN_", width: int = 7) -> DataFrame:
    """Add ``row_id``: prefix and zero-padded 1-based position in ``order``."""
    numbered = positions(df, [], order, "_n")
    digits = F.col("_n").cast("string")
    padded = F.when(F.length(digits) < width, F.lpad(digits, width, "0")).otherwise(digits)
    return numbered.withColumn("row_id", F.concat(F.lit(prefix), padded)).drop("_n")


def column_profile(df: DataFrame, approximate: bool = False) -> DataFrame:
    """Type, non-null count, null share, distinct count and a sample value of every column."""
    types = dict(df.dtypes)
    pairs = F.explode(
        F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("string").alias("v")) for c in df.columns])
    )
    long = df.select(pairs.alias("p")).select("p.*")
    if approximate:
        stats = long.groupBy("column_name").agg(
            F.count(F.lit(1)).alias("n"),
            F.count("v").alias("non_null_count"),
            F.approx_count_distinct("v").alias("distinct_count"),
            F.min("v").alias("v"),
        )
    else:
        # Equal values are merged before the shuffle, then the short list is summed per column.
        values = long.groupBy("column_name", "v").agg(F.count(F.lit(1)).alias("n"))
        stats = values.groupBy("column_name").agg(
            F.sum("n").alias("n"),
            F.coalesce(F.sum(F.when(F.col("v").isNotNull(), F.col("n"))), F.lit(0)).alias("non_null_count"),
            F.count("v").alias("distinct_count"),
            F.min("v").alias("v"),
        )
    kind = F.create_map(*[x for c, t in types.items() for x in (F.lit(c), F.lit(t))])
    return stats.select(
        "column_name",
        kind[F.col("column_name")].alias("data_type"),
        "non_null_count",
        ((F.col("n") - F.col("non_null_count")) * 100.0 / F.col("n")).alias("null_percent"),
        "distinct_count",
        F.substring("v", 1, 50).alias("sample_value"),
    )
