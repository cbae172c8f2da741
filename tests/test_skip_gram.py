"""Skip-gram training by blocks of accounts."""

import itertools
import time

import numpy as np
import pytest

from moneytrail.operators import graph_search, mapped

SCHEMA = "start string, walk int, path array<string>"


def some_walks(spark, n, seed=3):
    rng = np.random.default_rng(seed)
    rows = [(f"N{i % n}", i // n, [f"N{x}" for x in rng.integers(0, n, rng.integers(1, 9))]) for i in range(4 * n)]
    return spark.createDataFrame([*rows, ("ALONE", 0, ["ALONE"]), (None, 0, [None])], SCHEMA)


@pytest.mark.parametrize("size", [50, 7])
def test_block_pairs_are_the_pairs_of_walks(spark, size):
    walks = some_walks(spark, 40)
    accounts = walks.selectExpr("explode(path) AS account_id").distinct()
    named, count = mapped.share_names(accounts, ["account_id"])
    names = sorted((r.account_id for r in accounts.collect()), key=lambda x: (x is not None, x))
    assert count == len(names)
    want = {(r.account_id, r.other): r.n for r in graph_search.walk_pairs(walks, 3).collect() if r.account_id and r.other}
    found = {}
    for r in graph_search._block_pairs(walks, named, size, -(-count // size), 3).collect():
        cells, n = np.cumsum(graph_search._unpacked(bytes(r.cells))), graph_search._unpacked(bytes(r.n))
        assert (r.total, r.pairs, r.gap) == (n.sum(), len(n), r.q - r.p) and r.gap >= 0
        for cell, x in zip(cells.tolist(), n.tolist()):
            pair = names[r.p * size + cell // size], names[r.q * size + cell % size]
            assert pair not in found
            found[pair] = found[pair[::-1]] = x
    assert found == want


def objective(u, v, n, weight):
    score, negatives = u @ v.T, graph_search.NEGATIVES * n.sum(1)[:, None] * weight / weight.sum()
    return (n * np.logaddexp(0, -score) + negatives * np.logaddexp(0, score)).sum() / n.sum()


def test_tiles_train_as_far_as_pairs_in_a_fraction_of_the_time():
    rng = np.random.default_rng(1)
    group = np.arange(200) % 5
    n = rng.poisson(np.where(group[:, None] == group, 3.0, 0.6)).astype(float)
    n = np.triu(n, 1) + np.triu(n, 1).T
    weight = n.sum(1) ** 0.75
    a, b = np.nonzero(n)
    start, ends, taken = (rng.random((200, 16)) - 0.5) / 16, [], []
    for way, pairs in ((graph_search._by_pairs, (a, b, n[a, b])), (graph_search._by_tiles, (n,))):
        u, v, gu, gv = start.copy(), np.zeros((200, 16)), np.zeros((200, 16)), np.zeros((200, 16))
        begun = time.perf_counter()
        way(u, v, gu, gv, *pairs, weight, 0.05, 20, np.random.default_rng(2))
        taken.append(time.perf_counter() - begun)
        ends.append(objective(u, v, n, weight))
    first = objective(start, np.zeros((200, 16)), n, weight)
    assert first - ends[1] > 0.97 * (first - ends[0])
    assert taken[1] < taken[0] / 5


@pytest.mark.parametrize("few", [0, 1 << 15])
def test_every_account_has_a_vector(spark, monkeypatch, few):
    monkeypatch.setattr(graph_search, "BLOCK_ACCOUNTS", 9)
    monkeypatch.setattr(graph_search, "FEW_PAIRS", few)
    walks = some_walks(spark, 40)
    runs = [{r.account_id: tuple(r.vector) for r in graph_search.skip_gram(walks, 4, 3, epochs=2).collect()} for _ in range(2)]
    assert runs[0] == runs[1]
    assert set(runs[0]) == {r.account_id for r in walks.selectExpr("explode(path) AS account_id").distinct().collect()}
    # Accounts without a pair stay where they start, others move.
    moved = {k for k, x in runs[0].items() if max(map(abs, x)) > 0.125}
    assert moved == set(runs[0]) - {None, "ALONE"}
    empty = graph_search.skip_gram(walks.limit(0), 4, 3, epochs=1)
    assert empty.columns == ["account_id", "vector"] and empty.count() == 0


def test_few_pairs_are_trained_one_by_one(spark, monkeypatch):
    walks = some_walks(spark, 40)
    names = sorted(itertools.chain.from_iterable(r.path for r in walks.collect()), key=str)
    monkeypatch.setattr(graph_search, "DENSE_SHARE", 2.0)
    found = {r.account_id: r.vector for r in graph_search.skip_gram(walks, 4, 3, epochs=1).collect()}
    assert set(found) == set(names) and all(len(x) == 4 for x in found.values())
