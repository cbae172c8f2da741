"""Registered queries against their SQL, and the pipeline stage by stage against brute force."""

from collections import Counter

import pytest

import corpus_pipeline
from moneytrail.llm import mixing, registry
from moneytrail.llm.quality import score_documents, train_classifier
from tests.check import compare, connect
from tests.llm.test_text_operators import components, line_want

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(registry.check_sql()))
def test_query(spark, con, name):
    problem, rows = compare(registry.callables()[name](spark, FOLDER), con, registry.check_sql()[name])
    assert problem is None and rows > 0


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.callables()) == list(range(1, 14))


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, docs, FOLDER).write.parquet(path)
        docs = spark.read.parquet(path)
        seen.append((name, docs))
    tables = dict(seen)
    assert all(d.columns == columns for n, d in seen[:-1])
    rows = {n: [(r["doc_id"], r["text"], r["source"]) for r in d.collect()] for n, d in seen[:-1]}

    before = spark.read.parquet(f"{FOLDER}/documents.parquet")
    model = train_classifier(before, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    good = score_documents(before, model).filter("predicted = 1").select("row.doc_id").collect()
    assert Counter(r[0] for r in good) == Counter(r[0] for r in rows["quality"]) and len(good) < before.count()

    assert sorted((i, t) for i, t, _ in rows["line_dedup"]) == sorted((i, t) for i, t, _, _ in line_want(rows["quality"]))
    kept = [i for i, _, _, k in components(rows["line_dedup"], 5, 80) if k]
    assert sorted(i for i, _, _ in rows["near_dedup"]) == sorted(kept)
    taken = Counter()
    for r in mixing.mix(tables["near_dedup"]).collect():
        taken[r["doc_id"]] += r["taken"]
    got = Counter()
    for i, t, _ in rows["mixing"]:
        got[i] += len(t.split())
    assert +got == +taken
    pieces = tables["packing"].collect()
    whole = sum(r["length"] == r["doc_tokens"] for r in pieces)
    assert whole and {r["doc_id"] for r in pieces} == set(got)
