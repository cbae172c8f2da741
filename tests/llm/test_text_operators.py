"""Exact dedup, near dedup, line dedup, mixing and the pipeline on small tables against brute force."""

import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import types as T

from moneytrail.llm import exact_dedup, line_dedup, minhash, mixing
from moneytrail.llm.shingles import Shingler, similar

SPACE = " \t\n\x0b\x0c\r"
# Names that the operators use inside themselves.
SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType())]
    + [T.StructField(c, T.StringType()) for c in ("group", "bytes", "row", "batch", "size", "node", "value", "component", "_id")]
)


def table(spark, rows):
    return spark.createDataFrame([(*r, *["x"] * 9) for r in rows], SCHEMA)


def words(r, n):
    return " ".join(r.choice("ab cd ef gh ij kl mn op qr st uv wx yz".split()) + str(r.randrange(40)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    r = random.Random(4)
    found = []
    base = words(r, 300)
    for i in range(12):  # near copies of one text
        w = base.split()
        for _ in range(i):
            w[r.randrange(300)] = f"edit{r.randrange(99)}"
        found.append(" ".join(w))
    found += [base, base.replace(" ", "  "), base + "\n", base.upper()]
    long_text = words(r, 20_000)
    found += [long_text, long_text + " ", long_text[:-1] + "Z", long_text + long_text]
    line = "A Line That Many Documents Hold"
    for i in range(9):
        found.append(f"{words(r, 20)}\n  {line}\t\n{words(r, 3)}\n{line.upper()}" + ("\nshort\nshort" if i % 2 else ""))
    found += [None, "", " \t\n", "one", "one two three", "ONE two three", "one two three", "ｅ̈ ünï code", "é", "short\nshort"]
    found += [words(r, r.randrange(1, 40)) for _ in range(40)]
    ids = list(range(100, 100 + len(found)))
    r.shuffle(ids)
    sources = [r.choice(["a", "b", "c", "ß", "\U0001f600", None]) for _ in found]
    made = list(zip(ids, found, sources, strict=True))
    return made + [made[0], made[0], (None, "a null id", "a"), (None, "a null id", None), (100_000, line + "\n", "a")]


def test_exact_dedup(spark, rows):
    got = [tuple(r) for r in exact_dedup.dedup(table(spark, rows)).collect()]
    groups = defaultdict(list)
    for doc_id, text, _ in rows:
        groups["".join(c for c in text or "" if c not in SPACE)].append((-len(text or ""), doc_id is None, doc_id))
    want = []
    for key, members in groups.items():
        best = min(members, key=lambda m: (m[0], m[1], m[2] or 0))
        sha = hashlib.sha256(key.encode()).hexdigest()
        kept = False
        for m in members:
            want.append((m[2], best[2], len(members), m == best and not kept, sha))
            kept = kept or m == best
    order = lambda x: (repr(x[0]), x[3])
    assert sorted(got, key=order) == sorted(want, key=order)
    assert sum(x[2] > 1 for x in got) > 5


def components(rows, width, percent):
    shingler = Shingler(width)
    sets = [(i, shingler(t)) for i, t, _ in rows if i is not None]
    label = list(range(len(sets)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if similar(sets[a][1], sets[b][1], percent):
                label[find(a)] = find(b)
    least = defaultdict(lambda: 10**9)
    for k, (i, _) in enumerate(sets):
        least[find(k)] = min(least[find(k)], i)
    return sorted((i, len(s), least[find(k)], i == least[find(k)]) for k, (i, s) in enumerate(sets))


def test_shingles_count_by_definition():
    for text, n in ((None, 0), (" \t", 0), ("a b c", 1), ("a b c d", 1), ("a b a b a b", 2), ("A b\x0bC d e", 2), ("a b", 1)):
        assert len(Shingler(4)(text)) == n
    assert Shingler(4)("A b C d")[0] == Shingler(4)("a  B\nc D")[0] != Shingler(4)("Ä b c d")[0]
    assert Shingler(4)("é b c d")[0] != Shingler(4)("É b c d")[0]


@pytest.mark.parametrize("width", [4, 5])
def test_near_duplicates(spark, rows, width):
    got = [tuple(r) for r in minhash.near_duplicates(table(spark, rows), shingle_words=width).collect()]
    assert sorted(x for x in got if x[0] is not None) == components(rows, width, 80)
    assert [x[2:] for x in got if x[0] is None] == [(None, True)] * 2
    assert sum(not x[3] for x in got) > 10


def test_small_tables_take_few_tasks(spark, rows):
    # Many shuffle partitions: what the rounds store is small and written by a task per core, and only shared classes go on.
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        for k, v in zip(kept, ("64", "false"), strict=True):
            spark.conf.set(k, v)
        state = minhash.NearDuplicates(table(spark, rows).filter("doc_id IS NOT NULL"), 4, 80, 96)
        state.link()
        cores = spark.sparkContext.defaultParallelism
        assert all(0 < len(t.inputFiles()) <= cores for t in (state.classes, state.lists, state.sketches, state.components))
        nodes = {r.node for r in state.lists.select("node").distinct().collect()}
        assert {r.node for r in state.sketches.collect()} == nodes == {r.node for r in state.components.collect()}
        assert 0 < len(nodes) < state.classes.count()
        assert state.lists.groupBy("value").count().filter("count < 2").isEmpty()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_residual_pairs_are_compared(spark, rows, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_ROWS", 3)
    got = [tuple(r) for r in minhash.near_duplicates(table(spark, rows), shingle_words=4).collect()]
    assert sorted(x for x in got if x[0] is not None) == components(rows, 4, 80)


def test_contained_documents_link(spark):
    # A document and the same with a passage at its end: similarity 0.80 to 0.82, and no other pair near.
    r = random.Random(9)
    found = []
    for i in range(500):
        n, part = r.randrange(500, 1000), r.uniform(0.80, 0.82)
        text = [f"w{i}x{j}" for j in range(int(n / part))]
        found += [(2 * i, " ".join(text[:n + 4]), None), (2 * i + 1, " ".join(text), None)]
    got = [tuple(x) for x in minhash.near_duplicates(table(spark, found)).collect()]
    shingler = Shingler(5)
    linked = {a[0] for a, b in zip(found[::2], found[1::2], strict=True) if similar(shingler(a[1]), shingler(b[1]), 80)}
    assert len(linked) > 450
    assert {x[0] - 1 for x in got if not x[3]} == linked


def test_block_pairs_are_estimated_at_once(monkeypatch):
    # Near copies of one text in one list: only sketches that are not full may be estimated one by one.
    r, shingler = random.Random(3), Shingler(4)
    base = [f"w{j}" for j in range(300)]
    sets = []
    for _ in range(30):
        text = list(base)
        for j in r.sample(range(300), r.randrange(2, 40)):
            text[j] = f"x{r.randrange(10_000)}"
        sets.append(shingler(" ".join(text)))
    sketches = [s[:96] for s in sets]
    pairs = [(i, j) for i in range(30) for j in range(i + 1, 30)]
    slow = {(i, j): float(minhash.estimate(sketches[i], sketches[j], 96)) for i, j in pairs}
    wanted = {
        (*p, s) for p, s in slow.items()
        if 100 * (s + minhash.SLACK) >= 80 and len(np.intersect1d(sketches[p[0]], sketches[p[1]])) >= math.floor(96 * minhash.SHARED)
        and 100 * min(len(sets[p[0]]), len(sets[p[1]])) >= 80 * max(len(sets[p[0]]), len(sets[p[1]]))
    }
    ids = [i for i in range(30) for _ in range(2)]
    columns = [[7] * 60, [0] * 60, [0] * 60, [True, False] * 30, ids, [len(sets[i]) for i in ids], ids, [[7]] * 60]
    arrays = [pa.array(c) for c in columns] + [pa.array([sketches[i].view(np.int64) for i in ids], pa.list_(pa.int64()))]
    batch = pa.record_batch(arrays, names=list("abcdefghi"))

    def one_by_one(*_):
        raise AssertionError("a pair of full sketches was estimated by itself")

    monkeypatch.setattr(minhash, "estimate", one_by_one)
    got = {tuple(x.values()) for part in minhash._block_pairs(96, 80)(iter([batch])) for x in part.to_pylist()}
    assert got == wanted and 50 < len(got) < len(pairs)


def line_want(rows, at_least=3):
    keys = lambda t: [x.strip(SPACE).encode().lower() for x in (t or "").split("\n")]
    holders = defaultdict(set)
    for i, t, _ in rows:
        for x, k in zip((t or "").split("\n"), keys(t), strict=True):
            if len(x.strip(SPACE)) >= 20:
                holders[k].add(-1 if i is None else i)
    found = []
    for i, t, _ in rows:
        lines = (t or "").split("\n")
        kept = [x for x, k in zip(lines, keys(t), strict=True) if len(holders[k]) < at_least or (-1 if i is None else i) == max(holders[k])]
        found.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(found, key=repr)


@pytest.mark.parametrize("batches", [1, 4])
def test_line_dedup(spark, rows, batches):
    found = line_dedup.dedup_lines(table(spark, rows), batches=batches)
    got = sorted(((r["row"]["doc_id"], r["kept_text"], r["n_lines"], r["n_dropped"]) for r in found.collect()), key=repr)
    assert got == line_want(rows)
    assert sum(x[3] > 0 for x in got) >= 8


def test_runs_are_merged_by_levels(spark):
    runs = line_dedup.LineRuns(spark, fanout=2, buckets=3)
    kind = "hi bigint, lo bigint, owner bigint, documents bigint"
    for i in range(5):
        keys = spark.createDataFrame([(k, k, 100 - i, 1) for k in range(i, i + 3)], kind)
        assert {r["hi"] for r in runs.seen(keys).collect()} == ({i, i + 1} if i else set())
        runs.add(runs.fresh(keys))
    assert {level: len(names) for level, names in runs.levels.items()} == {0: 1, 2: 1}
    assert sorted(r["hi"] for run in runs.runs() for r in run.collect()) == list(range(7))
    runs.drop()


def test_targets_fill_up_to_their_ceilings(spark):
    sizes = {"0a": 1000, "0b": 10, "0c": 300, "0d": 0, "0e": 5, "1": 700}
    got = {r["source_key"]: r["target"] for r in mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source_key string, source_size bigint")).collect()}
    weight = dict(zip(sorted(sizes), (5, 2, 1, 5, 2, 1), strict=True))
    capped, total = set(), 1.5 * sum(sizes.values())
    while True:
        unit = (total - sum(2 * sizes[s] for s in capped)) / sum(weight[s] for s in sizes if s not in capped)
        above = {s for s in sizes if s not in capped and weight[s] * unit > 2 * sizes[s]}
        if not above:
            break
        capped |= above
    want = {s: 2 * sizes[s] if s in capped else weight[s] * unit for s in sizes}
    assert got == pytest.approx(want) and sum(got.values()) == pytest.approx(total)


def test_mix_takes_budgets_exactly(spark, rows):
    found = mixing.mix(table(spark, rows)).collect()
    assert len(found) == len(rows)
    taken, targets = defaultdict(int), {}
    for r in found:
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source_key"]] += r["taken"]
        targets[r["source_key"]] = r["target"]
    assert set(targets) == {"1", "0a", "0b", "0c", "0ß", "0\U0001f600"}
    for s, target in targets.items():
        assert abs(taken[s] - target) <= 0.5
    assert sorted(map(tuple, found), key=repr) == sorted(map(tuple, mixing.mix(table(spark, rows)).collect()), key=repr)


def test_mixed_documents_hold_what_was_taken(spark, rows):
    docs = table(spark, rows)
    taken = defaultdict(int)
    for r in mixing.mix(docs).collect():
        taken[r["doc_id"], r["source_key"]] += r["taken"]
    made = mixing.mixed_documents(docs)
    assert made.columns == docs.columns
    got = defaultdict(int)
    texts = defaultdict(set)
    for i, t, _ in rows:
        texts[i].add(t)
    for r in made.collect():
        got[r["doc_id"], "1" if r["source"] is None else "0" + r["source"]] += len(r["text"].split())
        assert any(t and t.startswith(r["text"]) for t in texts[r["doc_id"]])
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in taken.items() if v}


@pytest.mark.parametrize("number, lengths", [(1, (10, 10, 10)), (None, (17, 10, 10))])
def test_equal_rows_are_cut_as_decided(spark, number, lengths):
    docs = table(spark, [(number, " ".join(f"w{k}" for k in range(n)), "a") for n in lengths])
    for share in (0.87, 1.5, 3):  # at 3 the source is at its ceiling
        want, taken = [], 0
        for r in mixing.mix(docs, share=share).collect():
            taken += r["taken"]
            want += [r["size"]] * (r["taken"] // r["size"]) + [r["taken"] % r["size"]] * (r["taken"] % r["size"] > 0)
        assert taken == min(2 * sum(lengths), math.floor(share * sum(lengths) + 0.5))
        words = [len(r["text"].split()) for r in mixing.mixed_documents(docs, share=share).collect()]
        assert sorted(words) == sorted(want)


@pytest.mark.parametrize(
    "operator",
    [exact_dedup.dedup, minhash.near_duplicates, line_dedup.dedup_lines, mixing.mix, mixing.mixed_documents, minhash.without_near_duplicates],
)
def test_empty_table(spark, operator):
    assert operator(table(spark, [])).count() == 0


def test_block_links_of_whole_sets_are_a_forest():
    # 40 near copies of one text, all linked and each a component: as many links come out as join them, not all pairs.
    r, shingler = random.Random(5), Shingler(4)
    base = [f"w{j}" for j in range(200)]
    sets = [shingler(" ".join(base[:i] + [f"x{i}"] + base[i + 1 :])) for i in r.sample(range(200), 40)]
    ids = [i for i in range(40) for _ in range(2)]
    columns = [[7] * 80, [0] * 80, [0] * 80, [True, False] * 40, ids, [len(sets[i]) for i in ids], ids, [[7]] * 80]
    arrays = [pa.array(c) for c in columns] + [pa.array([sets[i].view(np.int64) for i in ids], pa.list_(pa.int64()))]
    batch = pa.record_batch(arrays, names=list("abcdefghi"))
    got = [tuple(x.values())[:2] for part in minhash._block_pairs(512, 80)(iter([batch])) for x in part.to_pylist()]
    assert len(got) == 39 and all(similar(sets[a], sets[b], 80) for a, b in got)
    reached = {0}
    for _ in range(40):
        reached |= {x for pair in got if reached & set(pair) for x in pair}
    assert reached == set(range(40))
