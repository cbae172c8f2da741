"""Clustering coefficients from files that tasks map, against the joins."""

import numpy as np
import pytest

from moneytrail.operators import graph, graph_search


@pytest.mark.parametrize("block", [7, 2048])
@pytest.mark.parametrize("spread", [40, 1 << 22])
def test_mapped_triangles_equal_joined_ones(spark, monkeypatch, block, spread):
    rng = np.random.default_rng(4)
    pairs = [(f"Ä{a}", f"Ä{b}") for a, b in rng.integers(0, 25, (150, 2))] + [(f"P{i}", f"Ä{j}") for i in range(30) for j in range(0, 25, 4)]
    simple = spark.createDataFrame(pairs + [pairs[0], (None, "Ä1"), ("Ä2", None)], "src string, dst string")
    kinds = [simple, simple.filter("src != dst").distinct(), simple.limit(0)]
    joined = [sorted(map(tuple, graph.clustering(x).collect())) for x in kinds]
    monkeypatch.setattr(graph_search, "MAPPED_LINKS", (0, 10_000))
    monkeypatch.setattr(graph_search, "SPREAD", spread)
    monkeypatch.setattr(graph, "BLOCK", block)
    assert [sorted(map(tuple, graph.clustering(x).collect())) for x in kinds] == joined
    assert sum(value > 0 for _, value in joined[1]) > 40


def test_wedges_are_not_rows(spark):
    pairs = [(f"N{a}", f"N{b}") for a in range(40) for b in range(40) if a != b]
    found = graph.clustering(spark.createDataFrame(pairs, "src string, dst string"))
    assert {r.clustering_coefficient for r in found.collect()} == {1.0}
    assert "rx" not in found._jdf.queryExecution().analyzed().toString()  # before: a join of the two sides of a wedge
