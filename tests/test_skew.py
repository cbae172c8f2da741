"""The skew-proof building blocks give the same rows whether or not a key counts as hot."""

import random

import pytest
from pyspark.sql import functions as F

from moneytrail.operators import entities, history, skew, windows


@pytest.fixture(scope="module")
def payments(spark):
    rng = random.Random(3)
    rows = []
    for i in range(600):
        payer = "A0" if i % 3 == 0 else f"A{rng.randrange(1, 12)}"
        # coarse times, so that many payments tie
        rows.append((f"{i}", 1_700_000_000 + 7200 * rng.randrange(120), payer, f"A{rng.randrange(9)}", float(rng.randrange(40))))
    df = spark.createDataFrame(rows, "transaction_id string, s long, from_account string, to_account string, amount_paid double")
    return df.withColumn("ts", F.timestamp_seconds("s")).withColumn("payment_format", F.lit("Wire")).cache()


def collected(df):
    return sorted(tuple(r) for r in df.collect())


def test_running_hot_equals_cold(payments):
    order = [F.col("ts"), F.col("transaction_id")]
    values = {"n": ("sum", F.lit(1)), "total": ("sum", F.col("amount_paid")), "top": ("max", F.col("amount_paid"))}
    for inclusive in (True, False):
        cold = skew.running(payments, ["from_account"], order, values, inclusive)
        hot = skew.running(payments, ["from_account"], order, values, inclusive, limit=40)
        assert collected(cold) == collected(hot.select(cold.columns))


def test_positions_without_key(payments):
    got = {r.transaction_id: r.position for r in skew.positions(payments, [], [F.col("ts").desc(), F.col("transaction_id")]).collect()}
    want = sorted(payments.collect(), key=lambda r: (-r.s, r.transaction_id))
    assert got == {r.transaction_id: i + 1 for i, r in enumerate(want)}


def test_hot_keys_are_bounded(payments):
    assert [r.from_account for r in skew.hot_keys(payments, ["from_account"], 150).collect()] == ["A0"]
    assert skew.hot_keys(payments, ["from_account"], 600) is None


@pytest.mark.parametrize("limit", [10, 10**9])
def test_quantiles(payments, limit):
    import numpy as np

    rows = payments.collect()
    got = skew.quantiles(payments, "amount_paid", [0.25, 0.5, 0.95], ["from_account"], limit=limit).collect()
    for r in got:
        values = [x.amount_paid for x in rows if x.from_account == r.from_account]
        assert np.allclose([r.q0, r.q1, r.q2], np.percentile(values, [25, 50, 95]))
    one = skew.quantiles(payments, "amount_paid", [0.9]).first().q0
    assert one == pytest.approx(np.percentile([x.amount_paid for x in rows], 90))


def brute_windows(rows, hours, minimum, boundary):
    found = {}
    for payer in {r.from_account for r in rows}:
        own = sorted((r for r in rows if r.from_account == payer), key=lambda r: (r.s, r.transaction_id))
        for i, first in enumerate(own):
            group = [r for r in own[i:] if r.s <= first.s + hours * 3600]
            if len(group) >= minimum and any(r.amount_paid < boundary for r in group):
                found[first.transaction_id] = [r.transaction_id for r in group]
    return found


@pytest.mark.parametrize("limit", [50, 10**9])
def test_splitting_windows_and_members(payments, limit):
    want = brute_windows(payments.collect(), 12, 3, 5.0)
    got = windows.splitting_windows(payments, 12, 3, 5.0, limit=limit).cache()
    assert {r.transaction_id: r.outgoing_transaction_count for r in got.collect()} == {k: len(v) for k, v in want.items()}
    ordered = skew.positions(payments.select("from_account", "transaction_id", "ts"), ["from_account"], [F.col("ts"), F.col("transaction_id")])
    members = {}
    for r in windows.window_members(got, ordered, block=7).collect():
        members.setdefault(r.window_id, {})[r.member_number] = r.transaction_id
    assert {k: [v[i] for i in sorted(v)] for k, v in members.items()} == want


@pytest.mark.parametrize("limit", [50, 10**9])
def test_fan_windows(payments, limit):
    rows = payments.collect()
    want = {}
    for r in rows:
        others = {x.to_account for x in rows if x.from_account == r.from_account and r.s <= x.s <= r.s + 10 * 3600}
        if len(others) >= 4:
            want[r.transaction_id] = len(others)
    got = windows.fan_out(payments, 10, 4, limit=limit)
    assert {r.transaction_id: r.counterparties for r in got.collect()} == want


def test_gather_scatter(payments):
    gathers, scatters = windows.fan_in(payments, 6, 3).cache(), windows.fan_out(payments, 6, 3).cache()
    starts = [(r.hub, r.start_us) for r in scatters.collect()]
    want = {}
    for g in gathers.collect():
        later = [us for hub, us in starts if hub == g.hub and us > g.end_us]
        if later and min(later) - g.end_us <= 24 * 3_600_000_000:
            want[(g.hub, g.transaction_id)] = min(later)
    got = windows.gather_scatter(gathers, scatters, 24, limit=30)
    assert {(r.hub, r.transaction_id): r.scatter_start_us for r in got.collect()} == want


def test_self_transfers_count_once(spark):
    rows = [("1", "A", "A"), ("2", "A", "B"), ("3", "B", "A")]
    df = spark.createDataFrame(rows, "transaction_id string, from_account string, to_account string").withColumn("is_synthetic", F.lit(False))
    roles = sorted((r.account_id, r.account_role) for r in entities.account_payments(df).collect())
    assert roles == [("A", "receiver"), ("A", "self"), ("A", "sender"), ("B", "receiver"), ("B", "sender")]
    counts = {r.account_id: r.total_transactions for r in history.ledger_counts(df).collect()}
    assert counts == {"A": 3, "B": 2}
