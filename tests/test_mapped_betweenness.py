"""Betweenness from files that tasks map, against the joins."""

import numpy as np
import pytest

from moneytrail.operators import graph_search


def values(spark, accounts, pairs, **settings):
    accounts = spark.createDataFrame([(a,) for a in accounts], "account_id string")
    simple = spark.createDataFrame(pairs, "src string, dst string")
    rows = graph_search.betweenness(simple, accounts, **settings).collect()
    return {r.account_id: round(r.betweenness_centrality, 12) for r in rows}, len(rows)


def some_pairs(kind):
    rng = np.random.default_rng(6)
    if kind == "path":
        return [(f"N{i}", f"N{i + 1}") for i in range(25)] + [("N25", "N3"), ("P", "N0"), ("P", "N9")]
    if kind == "hubs":
        return sorted({(f"N{a}", f"N{b}") for a, b in zip(rng.integers(0, 60, 400), rng.integers(0, 9, 400))})
    pairs = [(f"N{a}", f"N{b}") for a, b in rng.integers(0, 26, (70, 2))]
    return [*pairs, pairs[0], pairs[1], (None, "N1"), ("N1", None), ("X", "X")]


@pytest.mark.parametrize("kind", ["path", "hubs", "odd"])
@pytest.mark.parametrize("spread", [1 << 22, 50])
@pytest.mark.parametrize("sources", [None, 7])
def test_mapped_paths_equal_joined_ones(spark, monkeypatch, kind, spread, sources):
    accounts = [f"N{i}" for i in range(1, 40)] + ["N1", "ALONE", None]
    joined = values(spark, accounts, some_pairs(kind), sources=sources)
    monkeypatch.setattr(graph_search, "MAPPED_LINKS", (0, 10_000))
    monkeypatch.setattr(graph_search, "SPREAD", spread)
    assert values(spark, accounts, some_pairs(kind), sources=sources) == joined
    assert joined[1] == 41


def test_levels_of_paths_are_not_stored(spark, monkeypatch):
    rng = np.random.default_rng(2)
    pairs = sorted({(f"N{a}", f"N{b}") for a, b in rng.integers(0, 60, (1600, 2)) if a != b})
    labels, write = [], graph_search.materialize
    monkeypatch.setattr(graph_search, "materialize", lambda df, label="step", *a: labels.append(label) or write(df, label, *a))
    found, _ = values(spark, [f"N{i}" for i in range(60)], pairs)
    assert len(pairs) >= 1000 and len(found) == 60 and max(found.values()) > 0
    assert "level" not in labels and "shares" not in labels
