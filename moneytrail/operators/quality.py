"""Reconciliation of tables, and detection results against labelled scenarios."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import split_ids
from ..session import materialize
from . import rule_config
from .entities import explode_ids
from .risk import scenario_accounts
from .windows import span_coverage

# The signal each rule can confirm.
SIGNALS = {
    "privilege_change": rule_config.PRIVILEGE_CHANGE,
    "circular_transfer": rule_config.CIRCULAR,
    "transaction_splitting": rule_config.SPLITTING,
}


def match_rate(name: str, left: DataFrame, column: str, known: DataFrame, warn_below: float = 50.0) -> DataFrame:
    """Share of distinct keys, and of rows, of ``left`` whose key is known.

    ``known`` has one column; ``left`` keys may be ``;`` lists.  Rows are counted per key before the
    join, so a frequent key costs one row.
    """
    ids = known.select(F.col(known.columns[0]).alias("_id")).distinct().withColumn("_hit", F.lit(1))
    keys = explode_ids(left.select(column), column, "_id").groupBy("_id").agg(F.count(F.lit(1)).alias("_rows"))
    stats = keys.join(ids, "_id", "left").agg(
        F.count(F.lit(1)).alias("distinct_keys"),
        F.count("_hit").alias("matched_keys"),
        F.coalesce(F.sum("_rows"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.when(F.col("_hit") == 1, F.col("_rows"))), F.lit(0)).alias("matched_rows"),
    )
    share = F.when(F.col("distinct_keys") > 0, F.col("matched_keys") * 100.0 / F.col("distinct_keys")).otherwise(0.0)
    return stats.select(
        F.lit(name).alias("check"), "distinct_keys", "matched_keys", "rows", "matched_rows",
        share.alias("match_percent"), (share < warn_below).alias("warning"),
    )


def scenario_signals(scenarios: DataFrame, results: DataFrame) -> DataFrame:
    """Expected against detected signals of every scenario; lists are in alphabetical order."""
    signal = F.lit(None).cast("string")
    for name, rule_id in SIGNALS.items():
        signal = F.when(F.col("rule_id") == rule_id, name).otherwise(signal)
    # At most one row per account and rule from here on.
    fired = results.filter("triggered").select("account_id", signal.alias("signal")).distinct()
    found = scenario_accounts(scenarios).join(fired, "account_id").groupBy("scenario_id").agg(
        F.array_sort(F.collect_set("signal")).alias("detected")
    )
    empty = F.array().cast("array<string>")
    expected = F.array_sort(F.array_distinct(split_ids(F.col("expected_signals"), ";,")))
    known = F.array(*[F.lit(s) for s in sorted(SIGNALS)])
    joined = scenarios.join(found, "scenario_id", "left").select(
        "scenario_id",
        "scenario_type",
        F.array_intersect(expected, known).alias("testable"),
        F.array_except(expected, known).alias("not_testable"),
        F.coalesce("detected", empty).alias("detected"),
    )
    surprise = F.array_except("detected", "testable")
    verdicts = F.concat(
        F.transform(
            "testable",
            lambda s: F.concat(s, F.when(F.array_contains("detected", s), ": MATCH").otherwise(": MISS")),
        ),
        F.transform(surprise, lambda s: F.concat(s, F.lit(": UNEXPECTED"))),
    )
    legitimate = F.col("scenario_type") == "legitimate"
    return joined.withColumns(
        {
            "verdict": F.when(F.size(verdicts) > 0, F.array_join(verdicts, "; ")).otherwise("none"),
            "matched": F.size(F.array_intersect("testable", "detected")),
            "unexpected_on_legitimate": F.when(legitimate, surprise).otherwise(empty),
        }
    )


def detection_summary(signals: DataFrame, results: DataFrame, scenarios: DataFrame) -> DataFrame:
    """True positive rate on suspicious, false positive rate on legitimate scenarios, background findings."""
    suspicious, legitimate = F.col("scenario_type") == "suspicious", F.col("scenario_type") == "legitimate"
    surprised = F.size("unexpected_on_legitimate") > 0
    rates = signals.agg(
        F.sum(F.when(suspicious, F.col("matched"))).alias("matched"),
        F.sum(F.when(suspicious, F.size("testable"))).alias("expected"),
        F.count_if(legitimate & surprised).alias("false_alarms"),
        F.count_if(legitimate).alias("legitimate"),
        F.sum(F.size("unexpected_on_legitimate")).alias("unexpected_signals"),
    )
    known = scenario_accounts(scenarios).select("account_id").distinct()
    background = results.groupBy("account_id").agg(F.count(F.lit(1)).alias("n")).join(known, "account_id", "left_anti")
    total = background.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).scalar()
    return rates.select(
        "matched", "expected",
        F.when(F.col("expected") > 0, F.col("matched") / F.col("expected")).alias("true_positive_rate"),
        "false_alarms", "legitimate",
        F.when(F.col("legitimate") > 0, F.col("false_alarms") / F.col("legitimate")).alias("false_positive_rate"),
        "unexpected_signals",
        total.alias("background_results"),
    )


def splitting_spans(results: DataFrame) -> DataFrame:
    """Splitting results as spans of positions among the account's payments."""
    found = results.filter(F.col("rule_id") == rule_config.SPLITTING)
    place = {c: F.col("metrics")[c].cast("bigint") for c in ("first_position", "last_position")}
    return found.select(F.col("account_id").alias("from_account"), "result_key", "record_count", *[v.alias(c) for c, v in place.items()])


def evidence_audit(
    scenarios: DataFrame,
    results: DataFrame,
    evidence: DataFrame,
    access_events: DataFrame,
    profile_changes: DataFrame,
    transactions: DataFrame,
    positioned: DataFrame | None = None,
) -> DataFrame:
    """(scenario_id, rule_id, issue, records): evidence that does not fit the scenario or any table.

    ``unknown_record`` is in no table and ``outside_scenario`` not in the scenario's own lists, though
    the result names one of its accounts; ``wrong_account`` is in its lists, but the result names none
    of its accounts.  ``absent_from_evidence`` counts records that a result claims (``record_count``)
    and does not cite, ``missing_explanation`` results without a sentence.

    Each record is checked against the tables once, and many results citing one record stay one row.
    Records meet only the scenarios that list them; what all scenarios of an account share is a total
    per account, so the rows do not grow with records times scenarios.  With
    ``positioned`` payments (``rules.payment_positions``) the evidence of splitting is read off the
    results' spans of positions by a running sum, and no row per window and payment is needed.
    """
    owner = results.select("rule_id", "result_key", "account_id", "record_count")
    if positioned is not None:
        spanned = F.col("rule_id") == rule_config.SPLITTING
        owner, evidence = owner.filter(~spanned), evidence.filter(~spanned)
    # One row per result and record, so a record cited twice does not stand for another one.
    records = evidence.select("rule_id", "result_key", "record_type", "record_id").distinct()
    held = records.groupBy("rule_id", "result_key").agg(F.count(F.lit(1)).alias("_held"))
    short = owner.join(held, ["rule_id", "result_key"], "left").select(
        "rule_id", "account_id", (F.coalesce("record_count", F.lit(0)) - F.coalesce("_held", F.lit(0))).alias("n")
    )
    cited = records.join(owner, ["rule_id", "result_key"]).groupBy("rule_id", "account_id", "record_type", "record_id").agg(
        F.count(F.lit(1)).alias("n")
    )
    if positioned is not None:
        spans = splitting_spans(results)
        rule = F.lit(rule_config.SPLITTING).alias("rule_id")
        covered = span_coverage(spans, positioned.select("from_account", "transaction_id", "record_type", "position"))
        cited = cited.unionByName(
            covered.select(
                rule, F.col("from_account").alias("account_id"), "record_type", F.col("transaction_id").alias("record_id"),
                F.col("covered").alias("n"),
            )
        )
        # Positions have no gaps, so a span holds what lies up to the account's last payment.
        made = positioned.groupBy("from_account").agg(F.max("position").alias("_last"))
        there = F.least("last_position", F.coalesce("_last", F.lit(0))) - F.col("first_position") + 1
        short = short.unionByName(
            spans.join(made, "from_account", "left").select(
                rule, F.col("from_account").alias("account_id"), (F.col("record_count") - F.greatest(there, F.lit(0))).alias("n")
            )
        )
    base = (
        access_events.select(F.lit("access_event").alias("record_type"), F.col("event_id").alias("record_id"))
        .unionByName(profile_changes.select(F.lit("profile_change").alias("record_type"), F.col("change_id").alias("record_id")))
        .unionByName(transactions.select(F.lit("transaction").alias("record_type"), F.col("transaction_id").alias("record_id")))
        .distinct()
        .withColumn("_known", F.lit(1))
    )
    in_scenario = scenario_accounts(scenarios).select("scenario_id", "account_id").distinct()

    def listed(column, kind, separators):
        ids = F.explode(F.array_distinct(split_ids(F.col(column), separators)))
        return scenarios.select("scenario_id", F.lit(kind).alias("record_type"), ids.alias("record_id"))

    # Stored, as the checks below read it by different keys.
    cited = materialize(cited.join(base, ["record_type", "record_id"], "left"), "cited")
    truth = listed("related_event_ids", "access_event", ";,").unionByName(listed("related_transaction_ids", "transaction", ";,"))
    met = cited.join(truth.distinct(), ["record_type", "record_id"]).select("scenario_id", "rule_id", "account_id", "_known", "n")
    # Changes belong to scenarios by account and employee: those with the same ones are counted together.
    makers = profile_changes.select(
        F.col("change_id").alias("record_id"),
        F.struct(F.col("customer_id").alias("account_id"), F.col("changed_by_employee_id").alias("employee_id")).alias("maker"),
    )
    makers = makers.groupBy("record_id").agg(F.array_sort(F.collect_set("maker")).alias("makers"))
    changed = cited.filter(F.col("record_type") == "profile_change").join(makers, "record_id")
    changed = materialize(changed.groupBy("rule_id", "account_id", "_known", "makers").agg(F.sum("n").alias("n")), "changed")
    staffed = in_scenario.join(scenarios.select("scenario_id", "employee_id"), "scenario_id")
    of_makers = changed.select("makers").distinct().select("makers", F.explode("makers").alias("m")).select("makers", "m.*")
    of_makers = of_makers.join(staffed, ["account_id", "employee_id"]).select("makers", "scenario_id").distinct()
    met = met.unionByName(changed.join(of_makers, "makers").select("scenario_id", "rule_id", "account_id", "_known", "n"))
    met = met.join(in_scenario.withColumn("_own", F.lit(1)), ["scenario_id", "account_id"], "left")
    strangers = met.filter("_own IS NULL").select("scenario_id", "rule_id", F.lit("wrong_account").alias("issue"), "n")
    # Scenarios share the totals of their accounts; what is in their own lists is taken off.
    known = lambda n: F.coalesce(F.sum(F.when(F.col("_known").isNotNull(), n)), F.lit(0))
    unknown = F.coalesce(F.sum(F.when(F.col("_known").isNull(), F.col("n"))), F.lit(0)).alias("unknown")
    totals = cited.groupBy("rule_id", "account_id").agg(unknown, known(F.col("n")).alias("known")).join(in_scenario, "account_id")
    totals = totals.select("scenario_id", "rule_id", "unknown", "known").unionByName(
        met.filter("_own IS NOT NULL AND _known IS NOT NULL").select("scenario_id", "rule_id", F.lit(0).alias("unknown"), (-F.col("n")).alias("known"))
    )
    totals = totals.groupBy("scenario_id", "rule_id").agg(F.sum("unknown").alias("unknown_record"), F.sum("known").alias("outside_scenario"))
    issues = F.explode(F.array(*[F.struct(F.lit(c).alias("issue"), F.col(c).alias("n")) for c in ("unknown_record", "outside_scenario")]))
    checked = totals.select("scenario_id", "rule_id", issues.alias("i")).select("scenario_id", "rule_id", "i.*").filter("n > 0")

    def of_accounts(found, kind):
        summed = found.groupBy("rule_id", "account_id").agg(F.sum("n").alias("n"))
        return summed.join(in_scenario, "account_id").select("scenario_id", "rule_id", F.lit(kind).alias("issue"), "n")

    absent = of_accounts(short.filter("n > 0"), "absent_from_evidence")
    silent = results.filter(F.coalesce("explanation", F.lit("")) == "").select("rule_id", "account_id", F.lit(1).alias("n"))
    silent = of_accounts(silent, "missing_explanation")
    found = checked.unionByName(strangers).unionByName(absent).unionByName(silent)
    return found.groupBy("scenario_id", "rule_id", "issue").agg(F.sum("n").alias("records"))


def scenario_integrity(scenarios: DataFrame, access_events: DataFrame, injected: DataFrame) -> DataFrame:
    """(scenario_id, status): PASS or the first failed check.

    Scenarios without consequence list no payments; listed payments exist; in suspicious ones the last
    access event precedes the first payment.
    """
    listed = scenarios.select("scenario_id", F.explode(split_ids(F.col("related_transaction_ids"), ",")).alias("transaction_id"))
    payments = listed.join(injected.select("transaction_id", "ts"), "transaction_id", "left").groupBy("scenario_id").agg(
        F.count(F.lit(1)).alias("listed"), F.count("ts").alias("resolved"), F.min("ts").alias("first_payment")
    )
    events = scenarios.select("scenario_id", F.explode(split_ids(F.col("related_event_ids"), ";")).alias("event_id"))
    named = events.join(access_events.select("event_id", "ts"), "event_id").select("scenario_id", "ts")
    if "scenario_id" in access_events.columns:
        named = named.unionByName(access_events.select("scenario_id", "ts"))
    accesses = named.groupBy("scenario_id").agg(F.max("ts").alias("last_access"))
    joined = scenarios.join(payments, "scenario_id", "left").join(accesses, "scenario_id", "left")
    count = F.coalesce("listed", F.lit(0))
    status = (
        F.when(~F.col("has_transactional_consequence") & (count > 0), "payments without consequence")
        .when(~F.col("has_transactional_consequence"), "PASS")
        .when(count == 0, "no payments listed")
        .when(F.col("resolved") < count, "unresolved payments")
        .when((F.col("scenario_type") == "suspicious") & F.col("last_access").isNull(), "no access events")
        .when((F.col("scenario_type") == "suspicious") & (F.col("last_access") >= F.col("first_payment")), "access after payment")
        .otherwise("PASS")
    )
    return joined.select("scenario_id", "scenario_type", status.alias("status"))
