"""Small fixtures for the detection rules."""

import pytest
from pyspark.sql import functions as F

from moneytrail.functions.text import contains_any
from moneytrail.operators import clean, cycles, rule_config, rules, windows

HOUR = 3600


def payments(spark, rows):
    df = spark.createDataFrame(
        [(f"{i}", 1_700_000_000 + int(h * HOUR), a, b, float(x)) for i, (h, a, b, x) in enumerate(rows)],
        "transaction_id string, s long, from_account string, to_account string, amount_paid double",
    )
    return df.withColumns({"ts": F.timestamp_seconds("s"), "payment_format": F.lit("Wire")})


RING = [(0, "A", "B", 1), (12, "B", "C", 1), (24, "C", "A", 1)]


def rings(df, **settings):
    return [(r.account_id, r.transaction_ids, r.accounts) for r in cycles.circular_transfers(df, **settings).collect()]


def test_ring(spark):
    assert rings(payments(spark, RING)) == [("A", ["0", "1", "2"], ["A", "B", "C"])]


def test_ring_at_the_deadline(spark):
    assert len(rings(payments(spark, RING[:2] + [(48, "C", "A", 1)]))) == 1
    assert rings(payments(spark, RING[:2] + [(48 + 1 / HOUR, "C", "A", 1)])) == []


def test_chain_and_short_ring(spark):
    assert rings(payments(spark, RING[:2])) == []
    assert rings(payments(spark, [(0, "A", "B", 1), (1, "B", "A", 1)])) == []


def test_simultaneous_ring_is_found_once(spark):
    found = rings(payments(spark, [(0, "B", "C", 1), (0, "C", "A", 1), (0, "A", "B", 1)]))
    assert found == [("B", ["0", "1", "2"], ["B", "C", "A"])]


def test_rings_match_brute_force(spark):
    import random

    rng = random.Random(5)
    rows = [(rng.randrange(40) / 2, f"A{rng.randrange(6)}", f"A{rng.randrange(6)}", 1) for _ in range(60)]
    df = payments(spark, rows)
    edges = sorted((h, f"{i}", a, b) for i, (h, a, b, _) in enumerate(rows))
    want = {}

    def walk(path):
        h, i, a, b = path[-1]
        if b == path[0][2]:
            if len(path) >= 3:
                ids = [p[1] for p in path]
                key = min(tuple(ids[k:] + ids[:k]) for k in range(len(ids)))
                want.setdefault(key, ids)
            return
        if b in [p[2] for p in path]:
            return
        for e in edges:
            if e[2] == b and h <= e[0] <= path[0][0] + 5 and e[1] not in [p[1] for p in path]:
                walk(path + [e])

    for e in edges:
        walk([e])
    got = rings(df, hours=5, slot_hours=2)
    assert sorted(ids for _, ids, _ in got) == sorted(want.values())


def test_max_hops(spark):
    four = [(0, "A", "B", 1), (1, "B", "C", 1), (2, "C", "D", 1), (3, "D", "A", 1)]
    assert rings(payments(spark, four), max_hops=3) == []
    assert len(rings(payments(spark, four), max_hops=4)) == 1


@pytest.mark.parametrize("amounts, groups", [([9999.99, 10000, 10000], 1), ([10000, 10000, 10000], 0), ([5, 5], 0)])
def test_splitting_boundary(spark, amounts, groups):
    df = payments(spark, [(i, "A", "B", x) for i, x in enumerate(amounts)])
    assert windows.splitting_windows(df).count() == groups


def test_splitting_window_is_inclusive(spark):
    df = payments(spark, [(0, "A", "B", 1), (1, "A", "B", 1), (48, "A", "B", 1)])
    assert windows.splitting_windows(df).count() == 1
    late = payments(spark, [(0, "A", "B", 1), (1, "A", "B", 1), (48 + 1 / HOUR, "A", "B", 1)])
    assert windows.splitting_windows(late).count() == 0


def test_bad_rows_are_dropped(spark):
    rows = [
        ("1", "2024/01/02 03:04", "A", "B", "5", "Wire"),
        (" ", "2024/01/02 03:04", "A", "B", "5", "Wire"),
        ("3", "soon", "A", "B", "5", "Wire"),
        ("4", "2024-1-2 3:4:5", "A", "B", "much", "Wire"),
        ("5", "2024-01-02 03:04", "A", None, "5", "Wire"),
        ("6", "2024-01-02 03:04", "A", "B", "5", ""),
    ]
    df = spark.createDataFrame(rows, "transaction_id string, timestamp string, from_account string, to_account string, amount_paid string, payment_format string")
    assert [r.transaction_id for r in clean.usable_payments(df).collect()] == ["1"]
    kept = clean.usable_payments(df, needs_amount=False).collect()
    assert sorted(r.transaction_id for r in kept) == ["1", "4", "6"]
    assert clean.usable_payments(df.drop("to_account")).count() == 0


def context(spark, events, changes):
    e = spark.createDataFrame(events, "event_id string, employee_id string, action string, target_account_id string, old_value string, new_value string, s long")
    c = spark.createDataFrame(changes, "change_id string, customer_id string, field_changed string, changed_by_employee_id string, s long")
    return {
        "access_events": e.withColumn("ts", F.timestamp_seconds("s")),
        "profile_changes": c.withColumn("ts", F.timestamp_seconds("s")),
        "employees": spark.createDataFrame([("E1", "Ann", "Teller"), ("E1", "Bob", "Clerk")], "employee_id string, name string, role string"),
        "payments": payments(spark, RING),
    }


EVENTS = [
    ("V1", "E1", "modify", "A; B", "", "transfer_limit", 1000),
    ("V2", "E2", "modify", "A", "", "phone", 1000),
    ("V3", "E1", "grant", "C", "", "wire", 2000),
    ("", "E1", "grant", "C", "", "wire", 2000),
]
CHANGES = [("C1", "A", "spending_limit", "E1", 1000), ("C2", "A", "risk_rating", "E2", 1000), ("C3", "C", "risk_rating", "E1", 2300)]


def test_privilege_change(spark):
    out = rules.privilege_change(context(spark, EVENTS, CHANGES), {})
    got = sorted((r.result_key, r.account_id, r.metrics["paired_profile_change_count"]) for r in out.results.collect())
    assert got == [("V1:0", "A", "1"), ("V1:1", "B", "0"), ("V3:0", "C", "0")]
    assert all("Bob (E1)" in r.explanation for r in out.results.collect())
    proof = sorted((r.result_key, r.record_id) for r in out.evidence.collect())
    assert proof == [("V1:0", "C1"), ("V1:0", "V1"), ("V1:1", "V1"), ("V3:0", "V3")]


def test_employee_need_not_match(spark):
    out = rules.privilege_change(context(spark, EVENTS, CHANGES), {"require_matching_employee": False})
    assert {r.result_key: r.record_count for r in out.results.collect()}["V1:0"] == 3


def test_run_isolates_failures_and_scopes(spark):
    registry = rules.default_registry()

    def broken(tables, settings):
        raise RuntimeError("no")

    def late(tables, settings):
        out = rules.privilege_change(tables, {})
        bad = out.results.withColumn("rule_id", F.raise_error(F.lit("late")).cast("string"))
        return rules.RuleOutput(bad, out.evidence)

    def unproven(tables, settings):
        out = rules.privilege_change(tables, {})
        results = out.results.withColumn("rule_id", F.lit("T.UNPROVEN"))
        return rules.RuleOutput(results, out.evidence.withColumn("record_id", F.raise_error(F.lit("x" * 900)).cast("string")))

    registry.register(rules.Rule("T.UNPROVEN", "Unproven", "AML", unproven))
    registry.register(rules.Rule("T.BROKEN", "Broken", "AML", broken))
    registry.register(rules.Rule("T.LATE", "Late", "AML", late))
    registry.switch(rule_config.SPLITTING, False)
    results, evidence, failures = rules.run_rules(registry, context(spark, EVENTS, CHANGES))
    assert sorted(r.rule_id for r in failures.collect()) == ["T.BROKEN", "T.LATE", "T.UNPROVEN"]
    assert "x" * 900 in {r.rule_id: r.message for r in failures.collect()}["T.UNPROVEN"]
    counted = {r.rule_id: r["count"] for r in results.groupBy("rule_id").count().collect()}
    assert counted == {rule_config.PRIVILEGE_CHANGE: 3, rule_config.CIRCULAR: 1}
    assert rules.in_scope(results, account_id="A").count() == 2
    assert rules.in_scope(results, employee_id="E1").count() == 3
    assert rules.in_scope(results, entity_id="C").count() == 1
    scoped, proof, _ = rules.run_rules(registry, context(spark, EVENTS, CHANGES), account_id="C")
    assert scoped.count() == 1 and proof.count() == 1
    fired = {r.account_id: r.fired_rules for r in rules.fired_rules(results).collect()}
    assert fired["A"] == [rule_config.PRIVILEGE_CHANGE, rule_config.CIRCULAR]


def test_rules_drop_unusable_and_repeated_payments(spark):
    good = [(0, "A", "B", 1.0), (1, "A", "B", 1.0)]
    run = lambda df: rules.transaction_splitting({"payments": df}, {}).results.count()
    assert run(payments(spark, [*good, (2, "A", "B", 1.0)])) == 1
    assert run(payments(spark, good).unionByName(payments(spark, [(2, "A", "B", 1.0)]).withColumn("amount_paid", F.lit(None).cast("double")))) == 0
    assert run(payments(spark, good).unionByName(payments(spark, good))) == 0
    blank = payments(spark, [(i, " ", "B", 1.0) for i in range(4)])
    assert run(blank) == 0


def test_evidence_keeps_its_source(spark):
    raw = spark.createDataFrame(
        [(str(i), f"2024-01-01 0{i}:00:00", "A", "B", "5", "Wire") for i in range(4)],
        "transaction_id string, timestamp string, from_account string, to_account string, amount_paid string, payment_format string",
    )
    merged = rules.merged_payments([("injected", "synthetic", raw.limit(1)), ("bank", "real", raw)])
    out = rules.transaction_splitting({"payments": merged}, {})
    proof = {(r.record_id, r.source_dataset, r.record_type) for r in out.evidence.collect()}
    assert {x for x in proof if x[0] == "0"} == {("0", "injected", "synthetic")}
    assert {x[1:] for x in proof if x[0] != "0"} == {("bank", "real")}
    ring = rules.circular_transfer({"payments": payments(spark, RING)}, {}).evidence.collect()
    assert all(r.details["from_account"] and r.details["to_account"] and r.details["timestamp"] for r in ring)


def test_times_before_1970(spark):
    from moneytrail.operators.entities import account_stats

    df = spark.createDataFrame([("1", 7, "A", 9, "B", 0)], "transaction_id string, from_bank int, from_account string, to_bank int, to_account string, is_laundering int")
    df = df.withColumn("ts", F.lit("1969-05-01 10:00:00").cast("timestamp"))
    got = {r.account_id: r.bank_id for r in account_stats(df, df.limit(0)).collect()}
    assert got == {"A": 7, "B": 9}


@pytest.mark.parametrize(
    "kind, settings",
    [
        (rule_config.SplittingConfig, {"time_window_hours": 0}),
        (rule_config.SplittingConfig, {"minimum_outgoing_transactions": 2}),
        (rule_config.SplittingConfig, {"below_reporting_boundary": -1}),
        (rule_config.SplittingConfig, {"enabled": "yes"}),
        (rule_config.CircularConfig, {"minimum_transactions": 2}),
        (rule_config.CircularConfig, {"time_window_hours": "48"}),
        (rule_config.PrivilegeConfig, {"qualifying_administrative_categories": []}),
        (rule_config.PrivilegeConfig, {"qualifying_profile_change_fields": ["", "x"]}),
        (rule_config.PrivilegeConfig, {"matching_timestamp": "near"}),
        (rule_config.PrivilegeConfig, {"minimum_qualifying_events": 2}),
    ],
)
def test_invalid_settings(kind, settings):
    with pytest.raises(ValueError):
        kind.from_mapping(settings)


def test_settings_by_rule_or_flat():
    assert rule_config.settings_for({"R": {"a": 1}}, "R") == {"a": 1}
    assert rule_config.settings_for({"a": 1}, "R") == {"a": 1}


def test_terms_are_sought_in_one_text(spark):
    rows = [(0, "Grant", " wire", None), (1, None, None, None), (2, "x", "Auth", "y"), (3, "au", "th", "li mit")]
    df = spark.createDataFrame(rows, "n int, a string, b string, c string")
    hit = contains_any([F.col("a"), F.col("b"), F.col("c")], ["GRANT ", "auth", "t w", "limit", "risk"])
    assert {r.n: r.hit for r in df.select("n", hit.alias("hit")).collect()} == {0: True, 1: False, 2: True, 3: False}
    assert not any(r[0] for r in df.select(contains_any([F.col("a")], [])).collect())
    # However many terms there are, a row's text is put together once.
    assert df.filter(hit)._jdf.queryExecution().optimizedPlan().toString().count("concat_ws") == 1
