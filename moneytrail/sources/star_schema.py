"""The domain tables, derived from the star-schema and event tables of a data folder.

Each function reads only the columns it needs; nothing is cached here.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _account(number):
    return F.concat(F.lit("A"), number.cast("string"))


def _employee(number):
    return F.concat(F.lit("E"), number.cast("string"))


def _cycle(number, *values):
    """The value picked by ``number`` modulo the number of values."""
    picked = F.lit(values[-1])
    for i, value in reversed(list(enumerate(values[:-1]))):
        picked = F.when(number % len(values) == i, value).otherwise(picked)
    return picked


def _once(method):
    """Build the plan of a table once per instance; the plan is lazy, no data is kept."""

    @wraps(method)
    def wrapper(self, *args):
        key = (method.__name__, *args)
        if key not in self._plans:
            self._plans[key] = method(self, *args)
        return self._plans[key]

    return wrapper


class StarSchema:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self._plans = spark, folder, {}

    @_once
    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @_once
    def _events(self) -> DataFrame:
        return self.table("events").withColumn("k", F.get_json_object("props", "$.k").cast("bigint")).withColumn(
            "ts", F.col("ts").cast("timestamp")
        )

    @_once
    def ledger(self) -> DataFrame:
        e = self._events()
        return e.select(
            F.col("event_id").cast("string").alias("transaction_id"),
            "ts",
            (F.col("user_id") % 10).cast("int").alias("from_bank"),
            _account(F.col("user_id")).alias("from_account"),
            (F.col("k") % 10).cast("int").alias("to_bank"),
            _account(F.col("k")).alias("to_account"),
            F.col("value").alias("amount_paid"),
            F.when(F.col("event_id") % 4 == 0, "Euro").otherwise("US Dollar").alias("payment_currency"),
            F.when(F.col("event_type") == "click", "ACH")
            .when(F.col("event_type") == "view", "Wire")
            .when(F.col("event_type") == "purchase", "Cheque")
            .when(F.col("event_type") == "signup", "Credit Card")
            .otherwise("Cash")
            .alias("payment_format"),
            (F.col("event_id") % 50 == 0).cast("int").alias("is_laundering"),
            (F.col("event_id") % 10 == 0).alias("is_synthetic"),
            F.when(
                F.col("event_id") % 10 == 0,
                F.concat(F.lit("S"), (F.floor(F.col("event_id") / 20) * 2).cast("bigint").cast("string")),
            ).alias("scenario_id"),
        )

    @_once
    def real(self) -> DataFrame:
        return self.ledger().filter(~F.col("is_synthetic")).drop("is_synthetic", "scenario_id")

    @_once
    def injected(self) -> DataFrame:
        return self.ledger().filter("is_synthetic").drop("is_synthetic")

    @_once
    def raw_ledger(self) -> DataFrame:
        """Text columns with blank ids, unparsable times and amounts, as an export might hold."""
        e = self._events()
        n = F.col("event_id")
        return e.select(
            F.when(n % 13 == 0, "  ").otherwise(F.concat(F.lit(" "), n.cast("string"))).alias("transaction_id"),
            F.when(n % 17 == 0, "not a time")
            .when(n % 3 == 0, F.date_format("ts", "yyyy/MM/dd HH:mm"))
            .when(n % 3 == 1, F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
            .otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm"))
            .alias("timestamp"),
            F.concat(_account(F.col("user_id")), F.lit(" ")).alias("from_account"),
            F.when(n % 19 == 0, None).otherwise(_account(F.col("k"))).alias("to_account"),
            F.when(n % 11 == 0, "n/a").otherwise(F.col("value").cast("string")).alias("amount_paid"),
            F.when(n % 23 == 0, "").otherwise(F.col("event_type")).alias("payment_format"),
        )

    @_once
    def trade_ledger(self) -> DataFrame:
        """A larger ledger with day-grain times and many ties: line items paid by the ordering account."""
        lines = self.table("lineitem").select(
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"
        )
        orders = self.table("orders").select("o_orderkey", "o_custkey")
        return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
            F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("transaction_id"),
            F.col("l_shipdate").cast("timestamp").alias("ts"),
            _account(F.col("o_custkey")).alias("from_account"),
            _account(F.col("l_suppkey")).alias("to_account"),
            F.col("l_extendedprice").alias("amount_paid"),
        )

    @_once
    def access_events(self) -> DataFrame:
        e = self._events().filter(F.col("event_type").isin("signup", "error"))
        n, k = F.col("event_id"), F.col("k")
        action = _cycle(n, "grant", "modify", "revoke")
        return e.select(
            F.concat(F.lit("EVT_"), n.cast("string")).alias("event_id"),
            _employee(F.col("user_id") % 5).alias("employee_id"),
            action.alias("action"),
            F.when(n % 7 == 0, F.concat(_account(k % 20), F.lit("; "), _account((k + 1) % 20)))
            .otherwise(_account(k % 20))
            .alias("target_account_id"),
            F.when(n % 3 == 1, F.concat(F.lit("transfer_limit="), k.cast("string"))).otherwise("").alias("old_value"),
            _cycle(n, "wire_transfer", "api_access", "address", "phone").alias("new_value"),
            F.date_trunc("hour", "ts").alias("ts"),
        )

    @_once
    def profile_changes(self) -> DataFrame:
        e = self._events().filter(F.col("event_type") == "click")
        return e.select(
            F.concat(F.lit("CHG_"), F.col("event_id").cast("string")).alias("change_id"),
            _account(F.col("k") % 20).alias("customer_id"),
            _cycle(
                F.col("event_id"), "spending_limit", "risk_rating", "phone", "wire_transfer_limit", "address"
            ).alias("field_changed"),
            _employee(F.col("user_id") % 5).alias("changed_by_employee_id"),
            F.date_trunc("hour", "ts").alias("ts"),
        )

    @_once
    def customers(self) -> DataFrame:
        c = self.table("customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal")
        n = self.table("nation").select("n_nationkey", "n_name")
        return c.join(n, c.c_nationkey == n.n_nationkey).select(
            _account(F.col("c_custkey")).alias("customer_id"),
            F.col("c_name").alias("name"),
            F.col("n_name").alias("country"),
            _account(F.col("c_custkey")).alias("account_ids"),
            F.when(F.col("c_acctbal") < 1000, "High")
            .when(F.col("c_acctbal") < 5000, "Medium")
            .otherwise("Low")
            .alias("risk_rating"),
        )

    @_once
    def employees(self) -> DataFrame:
        s = self.table("supplier").select("s_suppkey", "s_name", "s_nationkey")
        return s.select(
            _employee(F.col("s_suppkey")).alias("employee_id"),
            F.col("s_name").alias("name"),
            _cycle(F.col("s_nationkey"), "Teller", "Manager", "Analyst", "Auditor", "Admin").alias("role"),
            _cycle(F.col("s_nationkey"), "Retail", "Risk").alias("department"),
        )

    @_once
    def employee_map(self) -> DataFrame:
        o = self.table("orders").select("o_custkey", "o_orderpriority")
        return o.select(
            _employee(F.col("o_custkey") % 5).alias("employee_id"),
            _account(F.col("o_custkey") % 150).alias("customer_id"),
            F.when(F.col("o_orderpriority") == "1-URGENT", "approver")
            .when(F.col("o_orderpriority") == "2-HIGH", "account_manager")
            .otherwise("reviewer")
            .alias("relationship_type"),
        ).distinct()

    @_once
    def scenarios(self) -> DataFrame:
        d = F.col("doc_id")
        first, second = (d * 10).cast("string"), (d * 10 + 10).cast("string")
        return self.table("labels").select(
            F.concat(F.lit("S"), d.cast("string")).alias("scenario_id"),
            F.when(F.col("quality") == 0, "suspicious").otherwise("legitimate").alias("scenario_type"),
            F.when(d % 3 == 0, F.concat(_account(d % 150), F.lit("; "), _account((d + 1) % 150)))
            .otherwise(_account(d % 150))
            .alias("account_id"),
            _employee(d % 5).alias("employee_id"),
            F.concat(
                F.lit("EVT_"), (d * 10 + 1).cast("string"), F.lit(";EVT_"), (d * 10 + 3).cast("string")
            ).alias("related_event_ids"),
            F.when(d % 5 == 0, F.when(d % 10 == 0, first).otherwise(""))
            .otherwise(F.concat(first, F.lit(","), second))
            .alias("related_transaction_ids"),
            (d % 5 != 0).alias("has_transactional_consequence"),
            _cycle(
                d,
                "privilege_change,transaction_splitting",
                "circular_transfer",
                "velocity_anomaly,privilege_change",
                "",
            ).alias("expected_signals"),
        )
