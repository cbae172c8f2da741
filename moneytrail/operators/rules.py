"""Detection rules as plans over whole tables, and a runner that isolates failing rules.

A rule yields two tables: results (one row per finding) and evidence (one row per supporting
record, keyed by rule and result).  Lists of ids are rows, so no finding has to fit in one row.
"""

from __future__ import annotations

from collections.abc import Callable, Collection, Mapping
from dataclasses import dataclass, field

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import clean_text, contains_any, money, split_ids
from ..session import materialize
from . import cycles, rule_config, windows
from .clean import keep_first, merge_sources, usable_payments
from .history import last_record
from .skew import HOT_ROWS, positions

_TYPES = {
    "text": T.StringType(), "flag": T.BooleanType(), "count": T.LongType(), "time": T.TimestampType(),
    "map": T.MapType(T.StringType(), T.StringType()),
}


def _schema(**columns: str) -> T.StructType:
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in columns.items()])


RESULT_SCHEMA = _schema(
    rule_id="text", rule_name="text", detection_category="text", triggered="flag", entity_type="text", entity_id="text",
    account_id="text", employee_id="text", customer_id="text", result_key="text", record_count="count", metrics="map",
    thresholds="map", explanation="text", window_start="time", window_end="time",
)
EVIDENCE_SCHEMA = _schema(
    rule_id="text", result_key="text", source_dataset="text", record_type="text", record_id="text", role="text",
    details="map",
)


def shaped(df: DataFrame, schema: T.StructType, **values) -> DataFrame:
    """Select ``values`` into the schema; what is not given is null."""

    def one(f):
        value = values.get(f.name, F.lit(None))
        return (value if isinstance(value, Column) else F.lit(value)).cast(f.dataType).alias(f.name)

    return df.select([one(f) for f in schema.fields])


def text_map(**values) -> Column:
    pairs = []
    for key, value in values.items():
        value = value if isinstance(value, Column) else F.lit(value)
        pairs += [F.lit(key), value.cast("string")]
    return F.create_map(*pairs)


@dataclass(frozen=True)
class RuleOutput:
    results: DataFrame
    evidence: DataFrame


@dataclass(frozen=True)
class Rule:
    """``evaluate(context, settings)`` builds the plans of one rule from the context tables."""

    rule_id: str
    rule_name: str
    detection_category: str
    evaluate: Callable[[Mapping[str, DataFrame], Mapping], RuleOutput]

    def __post_init__(self):
        for value in (self.rule_id, self.rule_name, self.detection_category):
            if not isinstance(value, str) or not value.strip():
                raise ValueError("rule id, name and category must be non-empty strings")


# --- privilege change -------------------------------------------------------------------


def privilege_events(access_events: DataFrame, config: rule_config.PrivilegeConfig) -> DataFrame:
    """Qualifying access events, one row per event and target."""
    c = {n: clean_text(F.col(n)) for n in ("event_id", "employee_id", "action", "old_value", "new_value")}
    df = access_events.withColumns(c)
    good = (F.col("event_id") != "") & (F.col("employee_id") != "") & F.col("ts").isNotNull()
    hit = contains_any([F.col("action"), F.col("old_value"), F.col("new_value")], config.qualifying_administrative_categories)
    return df.filter(good & hit).select(
        "event_id", "employee_id", "action", "old_value", "new_value", "ts",
        F.posexplode(split_ids(F.col("target_account_id"))).alias("target_number", "account_id"),
    )


def qualifying_changes(profile_changes: DataFrame, config: rule_config.PrivilegeConfig) -> DataFrame:
    columns = ("change_id", "customer_id", "field_changed", "changed_by_employee_id")
    df = profile_changes.withColumns({n: clean_text(F.col(n)) for n in columns})
    fields = F.lower("field_changed").isin(*config.qualifying_profile_change_fields)
    return df.filter(fields & (F.col("change_id") != "") & F.col("ts").isNotNull())


def _pair_keys(config):
    names = {"account_id": "customer_id", "ts": "ts"}
    if config.require_matching_employee:
        names["employee_id"] = "changed_by_employee_id"
    return names


def paired_changes(events: DataFrame, changes: DataFrame, config: rule_config.PrivilegeConfig) -> DataFrame:
    """(event, target, change) of the same time, account and, if required, employee."""
    keys = _pair_keys(config)
    facts = [F.col(c) if c in changes.columns else F.lit(None).cast("string").alias(c) for c in ("old_value", "new_value")]
    who = F.col("changed_by_employee_id").alias("_changed_by")
    right = changes.select(*[F.col(b).alias(a) for a, b in keys.items()], "change_id", "field_changed", *facts, who)
    left = events.select("event_id", "target_number", *dict.fromkeys(["account_id", "ts", "employee_id"]))
    return left.join(right, list(keys)).select(
        "event_id", "target_number", "account_id", "employee_id", "ts", "change_id", "field_changed", "old_value", "new_value",
        F.col("_changed_by").alias("changed_by_employee_id"),
    )


def _pair_counts(events, changes, config):
    """Pairs per event and target.  Changes are counted per key first, so no pair is formed."""
    keys = _pair_keys(config)
    counted = changes.groupBy(*[F.col(b).alias(a) for a, b in keys.items()]).agg(F.count(F.lit(1)).alias("_pairs"))
    return events.join(counted, list(keys), "left").withColumn("_pairs", F.coalesce("_pairs", F.lit(0)))


def privilege_change(context: Mapping[str, DataFrame], settings: Mapping) -> RuleOutput:
    config = rule_config.PrivilegeConfig.from_mapping(settings)
    rule = rule_config.PRIVILEGE_CHANGE
    events = privilege_events(context["access_events"], config)
    changes = qualifying_changes(context["profile_changes"], config)
    roster = last_record(context["employees"], "employee_id", [F.col("name")])
    roster = roster.select("employee_id", F.col("name").alias("_name"), F.col("role").alias("_role"))
    rows = _pair_counts(events, changes, config).join(roster, "employee_id", "left")
    key = F.concat_ws(":", "event_id", "target_number")
    who = F.when(F.coalesce("_name", F.lit("")) != "", F.concat("_name", F.lit(" ("), "employee_id", F.lit(")")))
    results = shaped(
        rows,
        RESULT_SCHEMA,
        rule_id=rule,
        rule_name="Privilege change",
        detection_category="insider-threat",
        triggered=True,
        entity_type="Employee",
        entity_id=F.col("employee_id"),
        account_id=F.col("account_id"),
        employee_id=F.col("employee_id"),
        result_key=key,
        record_count=F.col("_pairs") + 1,
        metrics=text_map(
            qualifying_event_count=1,
            paired_profile_change_count=F.col("_pairs"),
            action=F.col("action"),
            old_value=F.col("old_value"),
            new_value=F.col("new_value"),
            employee_role=F.col("_role"),
        ),
        thresholds=text_map(
            minimum_qualifying_events=config.minimum_qualifying_events, paired_record_window=config.matching_timestamp
        ),
        # Fixed format of the sentence.
        explanation=F.format_string(
            "Employee %s performed administrative action '%s' on account %s: '%s' -> '%s'.",
            F.coalesce(who, F.col("employee_id")), "action", "account_id", "old_value", "new_value",
        ),
        window_start=F.col("ts"),
        window_end=F.col("ts"),
    )
    own = shaped(
        events,
        EVIDENCE_SCHEMA,
        rule_id=rule,
        result_key=key,
        source_dataset="synthetic_hr",
        record_type="access_event",
        record_id=F.col("event_id"),
        role="triggering_access_event",
        details=text_map(
            employee_id=F.col("employee_id"), target_account_id=F.col("account_id"), action=F.col("action"),
            old_value=F.col("old_value"), new_value=F.col("new_value"), timestamp=F.col("ts"),
        ),
    )
    paired = shaped(
        paired_changes(events, changes, config),
        EVIDENCE_SCHEMA,
        rule_id=rule,
        result_key=key,
        source_dataset="synthetic_hr",
        record_type="profile_change",
        record_id=F.col("change_id"),
        role="paired_profile_change",
        details=text_map(
            customer_id=F.col("account_id"), field_changed=F.col("field_changed"), old_value=F.col("old_value"),
            new_value=F.col("new_value"), changed_by_employee_id=F.col("changed_by_employee_id"), timestamp=F.col("ts"),
        ),
    )
    return RuleOutput(results, own.unionByName(paired))


# --- payments for the rules -------------------------------------------------------------


def merged_payments(sources) -> DataFrame:
    """Raw payment tables as one: unusable rows go, then the first source that holds an id wins.

    ``sources`` holds ``(source_dataset, record_type, raw payments)`` in order of priority.
    """
    return merge_sources([(dataset, kind, usable_payments(raw)) for dataset, kind, raw in sources])


def _only(payments: DataFrame, *names: str) -> DataFrame:
    """The columns a rule uses, with their provenance if they have one: others are not sorted and stored with them."""
    wanted = (*names, "source_dataset", "record_type")
    return payments.select(*[c for c in payments.columns if c in wanted])


def rule_payments(payments: DataFrame, needs_amount: bool = True) -> DataFrame:
    """Payments as rules may count them, with their provenance.

    Rows without time, id, account or, if asked, a payment format and a number as amount go; ids are
    blank if any white space is all they hold.  Unless the table was merged before, of rows with one id
    the earliest stays; its provenance is then the ledger.
    """
    good = F.col("ts").isNotNull()
    for name in ("transaction_id", "from_account", "to_account", *(("payment_format",) if needs_amount else ())):
        good = good & (clean_text(F.col(name).cast("string")) != "")
    if needs_amount:
        good = good & F.col("amount_paid").isNotNull() & ~F.isnan(F.col("amount_paid").cast("double"))
    payments = payments.filter(good)
    if "source_dataset" in payments.columns:
        return payments
    payments = keep_first(payments, ["transaction_id"], [F.col("ts"), F.col("from_account"), F.col("to_account")])
    return payments.withColumns({"source_dataset": F.lit("ledger"), "record_type": F.lit("transaction")})


# --- transaction splitting --------------------------------------------------------------


def payment_positions(payments: DataFrame, limit: int = HOT_ROWS) -> DataFrame:
    """Payments of ``rule_payments`` with the ``position`` that splitting results refer to."""
    return positions(
        payments.select(
            "from_account", "transaction_id", "to_account", "ts", "amount_paid", "payment_format", "source_dataset", "record_type"
        ),
        ["from_account"], [F.col("ts"), F.col("transaction_id")], limit=limit,
    )


def transaction_splitting(context: Mapping[str, DataFrame], settings: Mapping) -> RuleOutput:
    config = rule_config.SplittingConfig.from_mapping(settings)
    rule, name = rule_config.SPLITTING, "Transaction splitting"
    hours, boundary = config.time_window_hours, float(config.below_reporting_boundary)
    used = _only(context["payments"], "transaction_id", "ts", "from_account", "to_account", "amount_paid", "payment_format")
    payments = materialize(rule_payments(used), "payments")
    limit = settings.get("hot_rows", HOT_ROWS)
    found = windows.splitting_windows(payments, hours, config.minimum_outgoing_transactions, boundary, limit)
    results = shaped(
        found,
        RESULT_SCHEMA,
        rule_id=rule,
        rule_name=name,
        detection_category="AML",
        triggered=True,
        entity_type="Account",
        entity_id=F.col("from_account"),
        account_id=F.col("from_account"),
        result_key=F.col("transaction_id"),
        record_count=F.col("outgoing_transaction_count"),
        metrics=text_map(
            outgoing_transaction_count=F.col("outgoing_transaction_count"),
            below_boundary_count=F.col("below_count"),
            first_position=F.col("first_position"),
            last_position=F.col("last_position"),
        ),
        thresholds=text_map(
            time_window_hours=hours,
            minimum_outgoing_transactions=config.minimum_outgoing_transactions,
            below_reporting_boundary=boundary,
        ),
        # Fixed format of the sentence.
        explanation=F.concat(
            F.lit(f"Rule {rule} ({name}) triggered because account "), "from_account", F.lit(" generated "),
            F.col("outgoing_transaction_count").cast("string"),
            F.lit(
                f" outgoing transactions within the configured {hours}-hour window, including one or more "
                "transactions below the configured $"
            ),
            money(F.lit(boundary)), F.lit(" reporting boundary."),
        ),
        window_start=F.col("window_start"),
        window_end=F.col("window_end"),
    )
    members = windows.window_members(found, payment_positions(payments, limit))
    evidence = shaped(
        members,
        EVIDENCE_SCHEMA,
        rule_id=rule,
        result_key=F.col("window_id"),
        source_dataset=F.col("source_dataset"),
        record_type=F.col("record_type"),
        record_id=F.col("transaction_id"),
        role="transaction_splitting_group_member",
        details=text_map(
            from_account=F.col("from_account"), to_account=F.col("to_account"), timestamp=F.col("ts"),
            amount_paid=F.col("amount_paid"), payment_format=F.col("payment_format"),
            below_boundary=F.col("amount_paid") < boundary, member_number=F.col("member_number"),
        ),
    )
    return RuleOutput(results, evidence)


# --- circular transfer ------------------------------------------------------------------


def circular_transfer(context: Mapping[str, DataFrame], settings: Mapping) -> RuleOutput:
    config = rule_config.CircularConfig.from_mapping(settings)
    rule, name, hours = rule_config.CIRCULAR, "Circular transfer", config.time_window_hours
    used = _only(context["payments"], "transaction_id", "ts", "from_account", "to_account")
    payments = materialize(rule_payments(used, needs_amount=False), "payments")
    found = cycles.circular_transfers(payments, hours, config.minimum_transactions, config.max_hops)
    found = materialize(found, "rings")
    path = F.concat_ws(" -> ", "accounts", "account_id")
    key = F.array_join("transaction_ids", ">")
    results = shaped(
        found,
        RESULT_SCHEMA,
        rule_id=rule,
        rule_name=name,
        detection_category="AML",
        triggered=True,
        entity_type="Account",
        entity_id=F.col("account_id"),
        account_id=F.col("account_id"),
        result_key=key,
        record_count=F.col("transaction_count"),
        metrics=text_map(
            transaction_count=F.col("transaction_count"),
            participating_account_ids=F.array_join("accounts", ";"),
            path=path,
        ),
        thresholds=text_map(time_window_hours=hours, minimum_transactions=config.minimum_transactions),
        # Fixed format of the sentence.
        explanation=F.concat(
            F.lit(
                f"Rule {rule} ({name}) triggered because transactions formed a closed path returning to the "
                f"originating account within the configured {hours}-hour window: "
            ),
            path, F.lit("."),
        ),
        window_start=F.col("window_start"),
        window_end=F.col("window_end"),
    )
    cited = found.select(key.alias("k"), path.alias("path"), F.explode("transaction_ids").alias("transaction_id"))
    evidence = shaped(
        cited.join(payments, "transaction_id"),
        EVIDENCE_SCHEMA,
        rule_id=rule,
        result_key=F.col("k"),
        source_dataset=F.col("source_dataset"),
        record_type=F.col("record_type"),
        record_id=F.col("transaction_id"),
        role="circular_path_transaction",
        details=text_map(
            from_account=F.col("from_account"), to_account=F.col("to_account"), timestamp=F.col("ts"), path=F.col("path"),
            time_window_hours=hours,
        ),
    )
    return RuleOutput(results, evidence)


# --- running rules ----------------------------------------------------------------------

# Failures of the engine, not of a rule: full disks, lost workers, no memory, a session that is gone.  Errors that Spark
# finds in a plan or its data come as exceptions of their own.
ENGINE_ERRORS = (Py4JError, MemoryError, ConnectionError)

RULES = (
    Rule(rule_config.PRIVILEGE_CHANGE, "Privilege change", "insider-threat", privilege_change),
    Rule(rule_config.CIRCULAR, "Circular transfer", "AML", circular_transfer),
    Rule(rule_config.SPLITTING, "Transaction splitting", "AML", transaction_splitting),
)


@dataclass
class RuleRegistry:
    """Rules in registration order, each enabled or not."""

    rules: dict[str, Rule] = field(default_factory=dict)
    enabled: dict[str, bool] = field(default_factory=dict)

    def register(self, rule: Rule, enabled: bool = True) -> None:
        if not isinstance(rule, Rule):
            raise TypeError("only rules can be registered")
        if rule.rule_id in self.rules:
            raise ValueError(f"rule already registered: {rule.rule_id}")
        self.rules[rule.rule_id], self.enabled[rule.rule_id] = rule, enabled

    def switch(self, rule_id: str, enabled: bool) -> None:
        if rule_id not in self.rules:
            raise KeyError(rule_id)
        self.enabled[rule_id] = enabled

    def active(self) -> list[Rule]:
        return [r for i, r in self.rules.items() if self.enabled[i]]


def default_registry() -> RuleRegistry:
    registry = RuleRegistry()
    for rule in RULES:
        registry.register(rule)
    return registry


def in_scope(
    results: DataFrame,
    account_id: str | None = None,
    employee_id: str | None = None,
    entity_id: str | None = None,
) -> DataFrame:
    """Results that match every given scope value."""

    def typed(column, kind, value):
        return F.coalesce((F.col(column) == value) | ((F.col("entity_type") == kind) & (F.col("entity_id") == value)), F.lit(False))

    if account_id is not None:
        results = results.filter(typed("account_id", "Account", account_id))
    if employee_id is not None:
        results = results.filter(typed("employee_id", "Employee", employee_id))
    if entity_id is not None:
        any_of = F.array("entity_id", "account_id", "employee_id", "customer_id")
        results = results.filter(F.exists(any_of, lambda v: v.eqNullSafe(F.lit(entity_id))))
    return results


def _checked(rule: Rule, output: RuleOutput, with_evidence: bool | Collection[str]) -> RuleOutput:
    if not isinstance(output, RuleOutput):
        raise TypeError("a rule must return a RuleOutput")
    if output.results.columns != RESULT_SCHEMA.names or output.evidence.columns != EVIDENCE_SCHEMA.names:
        raise TypeError(f"{rule.rule_id} returned tables of another shape")
    results = materialize(output.results, "results")
    wanted = with_evidence if isinstance(with_evidence, bool) else rule.rule_id in with_evidence
    evidence = materialize(output.evidence, "evidence") if wanted else output.evidence.limit(0)
    if not results.filter(~F.col("rule_id").eqNullSafe(F.lit(rule.rule_id))).isEmpty():
        raise ValueError("rule_id of a result does not match the rule")
    return RuleOutput(results, evidence)


def run_rules(
    registry: RuleRegistry,
    context: Mapping[str, DataFrame],
    configuration: Mapping | None = None,
    with_evidence: bool | Collection[str] = True,
    isolate: bool | Collection[str] = True,
    **scope: str,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(results, evidence, failures)`` of all active rules.

    Plans are lazy, so each rule's results and evidence are written within its own guard: an error
    shows up there and the other rules go on.  ``with_evidence`` may name the rules whose evidence is
    wanted; without it that table stays empty.

    ``isolate`` may name the rules that may fail, or none with False: others raise their error.  Who does not
    pass on the failures wants False, as results without a rule's rows look whole.  A failure of the engine is
    raised always.
    """
    spark = next(iter(context.values())).sparkSession
    results = spark.createDataFrame([], RESULT_SCHEMA)
    evidence = spark.createDataFrame([], EVIDENCE_SCHEMA)
    failures = []
    for rule in registry.active():
        try:
            settings = rule_config.settings_for(configuration, rule.rule_id)
            if not isinstance(settings.get("enabled", True), bool):
                raise ValueError("'enabled' must be boolean")
            if not settings.get("enabled", True):
                continue
            output = _checked(rule, rule.evaluate(context, settings), with_evidence)
        except ENGINE_ERRORS:
            raise
        except Exception as error:
            if not (isolate if isinstance(isolate, bool) else rule.rule_id in isolate):
                raise
            failures.append((rule.rule_id, rule.rule_name, type(error).__name__, str(error)))
            continue
        kept = in_scope(output.results, **scope)
        results = results.unionByName(kept)
        proof = output.evidence
        if scope:
            proof = proof.join(kept.select("rule_id", "result_key"), ["rule_id", "result_key"], "left_semi")
        evidence = evidence.unionByName(proof)
    schema = "rule_id string, rule_name string, error_type string, message string"
    return results, evidence, spark.createDataFrame(failures, schema)


def unique_results(results: DataFrame) -> DataFrame:
    """One result per rule, account and set of records."""
    return keep_first(results, ["rule_id", "account_id", "result_key"], [F.col("window_start")])


def fired_rules(results: DataFrame) -> DataFrame:
    """Per account: distinct fired rules in registration order, and the 0/1 rule score."""
    rank = F.lit(len(RULES))
    for i, rule in enumerate(RULES):
        rank = F.when(F.col("rule_id") == rule.rule_id, i).otherwise(rank)
    found = results.filter("triggered").groupBy("account_id").agg(
        F.array_sort(F.collect_set(F.struct(rank.alias("rank"), "rule_id"))).alias("r")
    )
    return found.select("account_id", F.col("r.rule_id").alias("fired_rules"), F.lit(1.0).alias("rule_score"))
