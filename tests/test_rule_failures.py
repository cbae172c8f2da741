"""A rule that fails must not look like a rule that found nothing."""

from types import SimpleNamespace as Fake

import pytest
from py4j.protocol import Py4JError
from pyspark.sql import functions as F

from moneytrail.operators import rule_config, rules
from moneytrail.plans import rule_queries
from tests.test_rules import CHANGES, EVENTS, context, payments


def failing(error):
    def evaluate(tables, settings):
        raise error

    return rules.Rule("T.FAILS", "Fails", "AML", evaluate)


def folder(spark):
    tables = context(spark, EVENTS, CHANGES)
    ledger = payments(spark, [(i, "A", "B", 1) for i in range(4)]).withColumn("is_synthetic", F.lit(False))
    return Fake(
        ledger=lambda: ledger, access_events=lambda: tables["access_events"], profile_changes=lambda: tables["profile_changes"],
        employees=lambda: tables["employees"],
    )


@pytest.mark.parametrize("query", [rule_queries.fired_rules, rule_queries.rule_evidence, rule_queries.prepared_rule_run, rule_queries.rule_run])
def test_a_query_fails_with_its_rule(spark, monkeypatch, query):
    def late(tables, settings):
        out = rules.privilege_change(tables, {})
        return rules.RuleOutput(out.results.withColumn("account_id", F.raise_error(F.lit("no room")).cast("string")), out.evidence)

    query(folder(spark)).collect()
    monkeypatch.setattr(rules, "RULES", (*rules.RULES, rules.Rule("T.LATE", "Late", "AML", late)))
    with pytest.raises(Exception, match="no room"):
        query(folder(spark)).collect()


@pytest.mark.parametrize("error", [Py4JError("no space left on device"), MemoryError(), ConnectionRefusedError()])
def test_a_failure_of_the_engine_is_never_a_failure_of_a_rule(spark, error):
    registry = rules.RuleRegistry()
    registry.register(failing(error))
    with pytest.raises(type(error)):
        rules.run_rules(registry, context(spark, EVENTS, CHANGES))


def test_only_named_rules_may_fail(spark):
    registry = rules.RuleRegistry()
    registry.register(failing(RuntimeError("no")))
    registry.register(rules.RULES[0])
    tables = context(spark, EVENTS, CHANGES)
    for named in (True, ["T.FAILS"]):
        results, _, failures = rules.run_rules(registry, tables, isolate=named)
        assert [r.rule_id for r in failures.collect()] == ["T.FAILS"] and results.count() == 3
    for named in (False, [rule_config.PRIVILEGE_CHANGE]):
        with pytest.raises(RuntimeError, match="no"):
            rules.run_rules(registry, tables, isolate=named)
