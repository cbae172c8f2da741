"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialize, tune

# The white space that all contracts of this subpackage mean.
SPACE = " \t\n\x0b\x0c\r"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{folder}/{name}.parquet")


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def key_of(value: Column) -> Column:
    """A string that is never null, sorts like ``value`` by code point and puts null last."""
    return F.when(value.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), value.cast("string")))


def word_count(text: Column) -> Column:
    """Words between white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("bigint")


def prefix_sums(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], values: dict[str, str], label: str = "slices"
) -> DataFrame:
    """Add, for each key's rows in ``order``, the sum of a column over all rows before.

    ``values`` maps an output column to the column it sums.  Rows are cut into range slices of about
    equal size whatever the keys are, so a key with most of the rows is spread over many tasks.  Each
    slice is summed on its own and shifted by the totals of the slices before it.  Keys must not be
    null; rows that tie in ``order`` get some order among themselves.
    """
    keys = list(keys)
    sliced = df.repartitionByRange(partitions(df), *[F.col(c) for c in (*keys, *order)])
    sliced = materialize(sliced.withColumn("_slice", F.spark_partition_id()), label)
    inner = Window.partitionBy("_slice", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("bigint")
    local = sliced.select("*", *[F.coalesce(F.sum(c).over(inner), zero).alias(n) for n, c in values.items()])
    # One row per (slice, key): at most slices + keys rows.
    totals = sliced.groupBy("_slice", *keys).agg(*[F.sum(c).alias(f"_total_{n}") for n, c in values.items()])
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(
        "_slice", *keys, *[F.coalesce(F.sum(f"_total_{n}").over(before), zero).alias(f"_base_{n}") for n in values]
    )
    bases = materialize(bases, f"{label}-bases")
    shifted = local.join(bases, ["_slice", *keys])
    return shifted.select(*df.columns, *[(F.col(n) + F.col(f"_base_{n}")).alias(n) for n in values])
