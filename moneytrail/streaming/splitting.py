"""Splitting alerts on a stream of payments.

An hourly grid stands in for "a window from every payment": the windows are as long, but start on
full hours, so a stream can close them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

# Open windows are many times the payments: they are kept outside the heap and stored as changes.
STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def splitting_alerts(
    payments: DataFrame,
    window: str = "48 hours",
    slide: str = "1 hour",
    lateness: str = "1 hour",
    minimum: int = 3,
    boundary: float = 10000,
) -> DataFrame:
    """Per sender and closed window: payments, and how many lie below the boundary."""
    counted = (
        payments.withWatermark("ts", lateness)
        .groupBy("from_account", F.window("ts", window, slide).alias("w"))
        .agg(F.count(F.lit(1)).alias("outgoing"), F.count_if(F.col("amount_paid") < boundary).alias("below"))
    )
    return counted.filter((F.col("outgoing") >= minimum) & (F.col("below") >= 1)).select(
        "from_account", F.unix_micros("w.start").alias("start_us"), "outgoing", "below"
    )


def run_available(alerts: DataFrame, spark: SparkSession) -> DataFrame:
    """Process all files that are there, append the alerts to a table, and return it."""
    out, state = scratch_path(spark, "alerts"), scratch_path(spark, "alerts-state")
    before = {key: spark.conf.get(key, None) for key in STATE_SETTINGS}
    for key, value in STATE_SETTINGS.items():
        spark.conf.set(key, value)
    try:
        query = (
            alerts.writeStream.outputMode("append")
            .format("parquet")
            .option("path", out)
            .option("checkpointLocation", state)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    return spark.read.schema(alerts.schema).parquet(out)
