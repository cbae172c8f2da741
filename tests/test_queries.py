"""Registered queries against their SQL on the smallest tables; tests/check.py runs all of them."""

import pytest

import __spark_entry__ as driver
from tests.check import compare, connect

FOLDER = "/root/testdata/sf0.001"
SAMPLE = (
    "scan_in_scope_ledger", "usable_payments", "normalized_text", "sequential_ids", "column_profile", "account_table",
    "feature_matrix", "history_summary", "splitting_windows", "privilege_results", "connected_employees", "graph_edges",
    "clustering_coefficients", "evidence_groups", "jackknife_errors", "scenario_integrity", "match_rates",
)


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", SAMPLE)
def test_query(spark, con, name):
    problem, rows = compare(driver.queries()[name](spark, FOLDER), con, driver.oracle_sql()[name])
    assert problem is None
    assert rows > 0


def test_entry(spark):
    assert driver.entry(spark).count() > 0


def test_registry_is_complete():
    assert set(driver.oracle_sql()) <= set(driver.queries())


def test_standard_names():
    from moneytrail.sources.io import standard_names

    names = standard_names(["Timestamp ", "From Bank", "Account", "To-Bank", "Account.1"])
    assert names == ["timestamp", "from_bank", "from_account", "to_bank", "to_account"]


def test_scratch_tables(monkeypatch, spark):
    import os

    from moneytrail import session

    monkeypatch.setattr(session, "_written", [])
    stored = session.materialize(spark.range(3), "x")
    assert stored.count() == 3
    (path,) = session._written
    assert path.startswith(session.scratch_dir(spark)) and os.path.isdir(path)
    assert session.release_scratch(spark) == 1 and not os.path.exists(path)


def test_cluster_needs_a_shared_folder():
    from types import SimpleNamespace as Fake

    from moneytrail import session

    context = Fake(getCheckpointDir=lambda: Fake(isDefined=lambda: False))
    cluster = Fake(
        conf=Fake(get=lambda key, default: default),
        sparkContext=Fake(master="spark://somewhere:7077", _jsc=Fake(sc=lambda: context)),
    )
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.scratch_dir(cluster)
