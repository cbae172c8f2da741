"""Reading and writing tables."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schemas import TABLES


def read_table(spark: SparkSession, name: str, path: str, fmt: str = "parquet") -> DataFrame:
    """One of the named tables from parquet or CSV, with its declared types."""
    reader = spark.read.schema(TABLES[name])
    if fmt == "csv":
        return reader.option("header", True).csv(path)
    return reader.format(fmt).load(path)


def as_text(df: DataFrame) -> DataFrame:
    """All columns as text, null as the empty string."""
    return df.select([F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in df.columns])


def standard_names(columns: Sequence[str]) -> list[str]:
    """Lower snake-case names; a repeated ``account`` column is sender, then receiver."""
    names = [re.sub(r"[ \-]", "_", c.strip().lower()) for c in columns]
    plain = [re.sub(r"[._]?\d+$", "", n) for n in names]
    accounts = [i for i, n in enumerate(plain) if n == "account"]
    if len(accounts) == 2:
        names[accounts[0]], names[accounts[1]] = "from_account", "to_account"
    return names


def standardize_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*standard_names(df.columns))


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = ()) -> str:
    """Overwrite ``path``; returns it."""
    writer = df.write.mode("overwrite").partitionBy(*partition_by) if partition_by else df.write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.format(fmt).save(path)
    return path


def inventory(spark: SparkSession, paths: Mapping[str, str], fmt: str = "parquet") -> DataFrame:
    """Name, status (OK, MISSING, ERR), row count and column count of every expected table."""
    rows = None
    for name in sorted(paths):
        status, counted = "OK", None
        try:
            df = spark.read.format(fmt).load(paths[name])
            counted = df.agg(F.count(F.lit(1)).alias("row_count")).withColumn("column_count", F.lit(len(df.columns)))
        except Exception as error:
            status = "MISSING" if "PATH_NOT_FOUND" in str(error) else "ERR"
        if counted is None:
            counted = spark.range(1).select(
                F.lit(None).cast("bigint").alias("row_count"), F.lit(None).cast("int").alias("column_count")
            )
        one = counted.select(
            F.lit(name).alias("table_name"), F.lit(status).alias("status"), "row_count", "column_count"
        )
        rows = one if rows is None else rows.unionByName(one)
    return rows
