"""Walks that read the links from a mapped file."""

import hashlib

import numpy as np
import pytest

from moneytrail.operators import graph_search, mapped


def walks(spark, accounts, links, *args):
    accounts = spark.createDataFrame([(a,) for a in accounts], "account_id string")
    links = spark.createDataFrame(links, "src string, dst string")
    return sorted((str(r.start), r.walk, r.path) for r in graph_search.random_walks(accounts, links, *args).collect())


def ring(n):
    return [(f"Ä{i}", f"Ä{(i + s) % n}") for i in range(n) for s in (1, 2, n - 2, n - 1)]


@pytest.mark.parametrize("odd", [[], [("Ä1", "NOWHERE"), ("Ä2", "SINK"), ("Ä3", None), (None, "Ä4"), ("Ä5", "Ä6"), ("Ä7", "Ä7")]])
def test_mapped_walks_equal_joined_ones(spark, monkeypatch, odd):
    accounts = [f"Ä{i}" for i in range(0, 30, 2)] + ["ALONE", "SINK", "ALONE", None]
    joined = walks(spark, accounts, ring(30) + odd, 5, 17, 9)
    monkeypatch.setattr(graph_search, "MAPPED_LINKS", (0, 1000))
    assert walks(spark, accounts, ring(30) + odd, 5, 17, 9) == joined
    assert len(joined) == 18 * 5


def test_many_links_are_not_joined_for_each_step(spark, monkeypatch):
    stored, write = [], graph_search.materialize
    monkeypatch.setattr(graph_search, "materialize", lambda df, *a: stored.append(a) or write(df, *a))
    found = walks(spark, [f"Ä{i}" for i in range(300)], ring(300), 3, 20)
    assert len(found) == 900 and {len(path) for *_, path in found} == {20}
    assert stored == []  # before: the links, and the walks every six steps


def test_names_without_links(spark, monkeypatch):
    monkeypatch.setattr(graph_search, "MAPPED_LINKS", (0, 1000))
    assert walks(spark, ["B", "A"], [], 2, 4) == [(a, i, [a]) for a in "AB" for i in range(2)]
    assert walks(spark, [], [], 2, 4) == []
    assert [path for *_, path in walks(spark, ["A"], ring(9), 2, 1)] == [["A"], ["A"]]


def test_numbers_of_texts_are_md5():
    texts = ["".join(chr(97 + (i * k) % 26) for k in range(i)).encode() for i in range(70)] + ["42:Ä:1:".encode()]
    rows = np.array([*range(0, 71, 2), 70, 55, 54, 53, 3])
    for ending in (b"", b"7", b"29"):
        want = [int(hashlib.md5(texts[i] + ending).hexdigest()[:8], 16) for i in rows]
        assert mapped.Texts(texts).numbers(rows, ending).tolist() == want
    assert mapped.Texts([]).numbers(np.array([], int), b"1").tolist() == []
