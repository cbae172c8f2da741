"""Evidence audit: every kind of issue planted, and spans against members."""

import random

import pytest
from pyspark.sql import functions as F

from moneytrail.operators import quality, rule_config, rules, windows

PRIVILEGE, RING, SPLIT = rule_config.PRIVILEGE_CHANGE, rule_config.CIRCULAR, rule_config.SPLITTING


def tables(spark):
    scenarios = spark.createDataFrame(
        [("S1", "suspicious", "A;B", "E1", "e1;e2", "t1,t2,t3"), ("S2", "legitimate", "C", "E2", "", "")],
        "scenario_id string, scenario_type string, account_id string, employee_id string, related_event_ids string, "
        "related_transaction_ids string",
    )
    events = spark.createDataFrame([("e1",), ("e2",), ("e3",)], "event_id string")
    changes = spark.createDataFrame([("c1", "A", "E1"), ("c2", "A", "E9")], "change_id string, customer_id string, changed_by_employee_id string")
    payments = spark.createDataFrame([(f"t{i}",) for i in range(1, 6)], "transaction_id string")
    return scenarios, events, changes, payments


def audit(spark, results, evidence, positioned=None):
    scenarios, events, changes, payments = tables(spark)
    results = spark.createDataFrame(
        [(*r, {}) if len(r) == 5 else r for r in results],
        "rule_id string, result_key string, account_id string, record_count long, explanation string, metrics map<string,string>",
    )
    evidence = spark.createDataFrame(evidence, "rule_id string, result_key string, record_type string, record_id string")
    found = quality.evidence_audit(scenarios, results, evidence, events, changes, payments, positioned)
    return {tuple(r) for r in found.select("scenario_id", "rule_id", "issue", "records").collect()}


def test_every_issue(spark):
    results = [
        (PRIVILEGE, "p1", "A", 3, "why"),  # whole: two events, one change
        (PRIVILEGE, "p2", "B", 2, ""),  # no sentence; an event of no table, a change by another employee
        (RING, "r1", "A", 3, "why"),  # claims three, cites one twice and another one
        (RING, "r2", "C", 2, None),  # cites payments of S1 for an account of S2
        (RING, "r3", None, 1, "why"),  # no account at all
        (RING, "r4", "Z", 5, ""),  # an account of no scenario, no evidence
    ]
    evidence = [
        (PRIVILEGE, "p1", "access_event", "e1"), (PRIVILEGE, "p1", "access_event", "e2"), (PRIVILEGE, "p1", "profile_change", "c1"),
        (PRIVILEGE, "p2", "access_event", "e9"), (PRIVILEGE, "p2", "profile_change", "c2"),
        (RING, "r1", "transaction", "t1"), (RING, "r1", "transaction", "t1"), (RING, "r1", "transaction", "t2"),
        (RING, "r2", "transaction", "t1"), (RING, "r2", "transaction", "t4"), (RING, "r3", "transaction", "t3"),
    ]
    assert audit(spark, results, evidence) == {
        ("S1", PRIVILEGE, "unknown_record", 1), ("S1", PRIVILEGE, "outside_scenario", 1), ("S1", PRIVILEGE, "missing_explanation", 1),
        ("S1", RING, "absent_from_evidence", 1), ("S1", RING, "wrong_account", 2),
        ("S2", RING, "outside_scenario", 2), ("S2", RING, "missing_explanation", 1),
    }
    assert audit(spark, [], []) == set()


def test_spans_of_splitting(spark):
    spans = {"t1": (1, 2), "t2": (2, 3), "t3": (3, 9)}  # the last one ends after the last payment
    results = [
        (SPLIT, k, "A", b - a + 1, "why", {"first_position": str(a), "last_position": str(b)}) for k, (a, b) in spans.items()
    ]
    positioned = spark.createDataFrame(
        [("A", f"t{i}", "transaction", i) for i in range(1, 6)], "from_account string, transaction_id string, record_type string, position long"
    )
    members = [(SPLIT, k, "transaction", f"t{i}") for k, (a, b) in spans.items() for i in range(a, min(b, 5) + 1)]
    want = {("S1", SPLIT, "outside_scenario", 2), ("S1", SPLIT, "absent_from_evidence", 4)}
    assert audit(spark, results, members) == want
    assert audit(spark, results, [], positioned) == want
    assert audit(spark, [], [], positioned) == set()


@pytest.mark.parametrize("limit", [10**9, 5])
def test_span_coverage(spark, limit):
    rng = random.Random(3)
    spans = [(a, x, x + rng.randrange(6)) for a in "AB" for x in (rng.randrange(1, 20) for _ in range(15))]
    want = {}
    for account in "ABC":
        for i in range(1, 21):
            n = sum(a == account and x <= i <= y for a, x, y in spans)
            if n:
                want[account, i] = n
    rows = spark.createDataFrame([(a, f"{a}{i}", i) for a in "ABC" for i in range(1, 21)], "from_account string, transaction_id string, position long")
    found = windows.span_coverage(spark.createDataFrame(spans, "from_account string, first_position long, last_position long"), rows, limit)
    assert found.columns == [*rows.columns, "covered"]
    assert {(r.from_account, r.position): r.covered for r in found.collect()} == want


def test_spans_equal_members(spark):
    rng = random.Random(5)
    rows = [(f"t{i}", rng.choice("ABC"), "X", rng.randrange(400), float(rng.randrange(200))) for i in range(120)]
    payments = spark.createDataFrame(rows, "transaction_id string, from_account string, to_account string, h int, amount_paid double")
    payments = payments.withColumns({"ts": F.timestamp_seconds(F.col("h") * 3600), "payment_format": F.lit("Wire")}).drop("h")
    out = rules.transaction_splitting({"payments": payments}, {"below_reporting_boundary": 100})
    each = {(r.account_id, r.record_id): r["count"] for r in out.evidence.join(out.results, "result_key").groupBy("account_id", "record_id").count().collect()}
    ordered = rules.payment_positions(rules.rule_payments(payments))
    found = windows.span_coverage(quality.splitting_spans(out.results), ordered)
    assert each and each == {(r.from_account, r.transaction_id): r.covered for r in found.collect()}


def test_records_times_scenarios_are_never_formed(spark, monkeypatch):
    """Accounts with many scenarios: results by definition, stored rows as many as records."""
    rng = random.Random(5)
    accounts, staff = ["A", "B", "C"], ["E1", "E2"]
    scenarios = [
        (f"S{i}", "suspicious", ";".join(rng.sample(accounts, rng.randrange(1, 3))), rng.choice(staff),
         ";".join(rng.sample(["e1", "e2", "e3"], rng.randrange(0, 3))), ",".join(rng.sample(["t1", "t2", "t3"], rng.randrange(0, 3))))
        for i in range(60)
    ]
    changes = [(f"c{i}", rng.choice(accounts), rng.choice(staff)) for i in range(20)] + [("c0", "A", "E2"), ("c1", None, "E1")]
    results = [(PRIVILEGE, f"p{i}", rng.choice([*accounts, "Z", None]), 0, "why") for i in range(40)]
    records = [("access_event", f"e{i}") for i in range(1, 5)] + [("transaction", f"t{i}") for i in range(1, 5)]
    records += [("profile_change", f"c{i}") for i in range(25)]
    evidence = sorted({(PRIVILEGE, f"p{i}", *rng.choice(records)) for i in range(40) for _ in range(6)})
    want = {}
    for s, _, own, who, events, paid in scenarios:
        own, lists = own.split(";"), {("access_event", x) for x in events.split(";")} | {("transaction", x) for x in paid.split(",")}
        lists |= {("profile_change", c) for c, a, e in changes if a in own and e == who}
        for _, key, kind, record in evidence:
            account = next(r[2] for r in results if r[1] == key)
            known = record[1:] in {str(i) for i in range(20)} if kind == "profile_change" else record[1:] != "4"
            issues = []
            if account in own and not known:
                issues.append("unknown_record")
            elif account in own and (kind, record) not in lists:
                issues.append("outside_scenario")
            if account not in own and (kind, record) in lists:
                issues.append("wrong_account")
            for issue in issues:
                want[s, PRIVILEGE, issue] = want.get((s, PRIVILEGE, issue), 0) + 1
    rows, write = [], quality.materialize
    monkeypatch.setattr(quality, "materialize", lambda df, label="step": rows.append(write(df, label)) or rows[-1])
    found = quality.evidence_audit(
        spark.createDataFrame(scenarios, tables(spark)[0].schema),
        spark.createDataFrame([(*r, {}) for r in results], "rule_id string, result_key string, account_id string, record_count long, explanation string, metrics map<string,string>"),
        spark.createDataFrame(evidence, "rule_id string, result_key string, record_type string, record_id string"),
        spark.createDataFrame([(f"e{i}",) for i in range(1, 4)], "event_id string"),
        spark.createDataFrame(changes, "change_id string, customer_id string, changed_by_employee_id string"),
        spark.createDataFrame([(f"t{i}",) for i in range(1, 4)], "transaction_id string"),
    )
    assert {(r.scenario_id, r.rule_id, r.issue): r.records for r in found.collect()} == want
    assert len(rows) == 2 and all(df.count() <= len(evidence) for df in rows)


def test_open_windows_of_the_stream_are_kept_outside_the_heap(spark, tmp_path):
    import glob

    from moneytrail import session
    from moneytrail.streaming import splitting

    spark.sql("SELECT explode(sequence(0, 99)) AS i").selectExpr(
        "concat('A', i % 3) AS from_account", "double(i) AS amount_paid", "timestamp_seconds(1700000000 + i * 3600) AS ts"
    ).write.parquet(f"{tmp_path}/in")
    payments = spark.readStream.schema("from_account string, amount_paid double, ts timestamp").parquet(f"{tmp_path}/in")
    found = splitting.run_available(splitting.splitting_alerts(payments, "6 hours", minimum=2, boundary=50), spark)
    assert found.count() > 0
    (state,) = glob.glob(f"{session.scratch_dir(spark)}/alerts-state-*/offsets/0")[-1:]
    with open(state) as f:
        assert "RocksDB" in f.read()
    assert all(spark.conf.get(key, None) != value for key, value in splitting.STATE_SETTINGS.items())
