"""Graph searches and clustering against brute force."""

import itertools
import random

import numpy as np
import pytest

from moneytrail import session
from moneytrail.operators import density, graph, graph_search


def random_edges(n, m, seed):
    rng = random.Random(seed)
    return sorted({(f"N{rng.randrange(n)}", f"N{rng.randrange(n)}") for _ in range(m)})


def frame(spark, edges):
    return spark.createDataFrame([e for e in edges if e[0] != e[1]], "src string, dst string")


def distances(edges):
    out = {}
    for a, b in edges:
        if a != b:
            out.setdefault(a, set()).add(b)
    nodes = {x for e in edges for x in e}
    dist, paths = {}, {}
    for s in nodes:
        seen, level, d = {s: 0}, {s: 1}, 0
        paths[s, s] = 1
        while level:
            d, new = d + 1, {}
            for v, k in level.items():
                for w in out.get(v, ()):
                    if w not in seen or seen[w] == d:
                        seen[w] = d
                        new[w] = new.get(w, 0) + k
            level = new
            paths.update({(s, w): k for w, k in new.items()})
        dist[s] = seen
    return nodes, out, dist, paths


@pytest.mark.parametrize("hub_pairs", [1e8, 3])
def test_accounts_on_cycles(spark, hub_pairs):
    edges = random_edges(40, 60, 1) + [(f"R{i}", f"R{(i + 1) % 6}") for i in range(6)] + [(f"Q{i}", f"Q{(i + 1) % 7}") for i in range(7)]
    nodes, out, dist, _ = distances(edges)
    want = {v for v in nodes if any(dist[w].get(v, 99) + 1 <= 6 for w in out.get(v, ()))}
    assert "R0" in want and "Q0" not in want
    got = {r.account_id for r in graph_search.accounts_on_cycles(frame(spark, edges), hub_pairs=hub_pairs).collect()}
    assert got == want


def test_shortest_cycles(spark):
    edges = random_edges(25, 40, 2) + [("R0", "R1"), ("R1", "R2"), ("R2", "R3"), ("R3", "R0")]
    nodes, out, _, _ = distances(edges)
    want = {}
    for v in nodes:
        paths = [[v]]
        for length in range(2, 7):
            paths = [p + [w] for p in paths for w in sorted(out.get(p[-1], ())) if w not in p]
            closed = [p for p in paths if v in out.get(p[-1], ())]
            if closed:
                want[v] = min(closed)
                break
    df = frame(spark, edges)
    accounts = df.selectExpr("src as account_id").distinct()
    got = {r.account_id: r.path for r in graph_search.shortest_cycles(df, accounts).collect()}
    assert got == want and len(want["R0"]) == 4


def test_betweenness(spark):
    edges = random_edges(18, 40, 4)
    nodes, _, dist, paths = distances(edges)
    n = len(nodes)
    want = {}
    for v in nodes:
        total = 0.0
        for s, t in itertools.permutations(nodes - {v}, 2):
            if t in dist[s] and v in dist[s] and t in dist[v] and dist[s][v] + dist[v][t] == dist[s][t]:
                total += paths[s, v] * paths[v, t] / paths[s, t]
        want[v] = total / ((n - 1) * (n - 2))
    accounts = spark.createDataFrame([(v,) for v in nodes], "account_id string")
    for in_flight in (graph_search.ROWS_IN_FLIGHT, 7 * n):  # one wave, a few
        before = session.scratch_tables()
        found = graph_search.betweenness(frame(spark, edges), accounts, rows_in_flight=in_flight)
        assert session.scratch_tables() - before == 4  # edges, accounts, sources and the sums
        assert {r.account_id: r.betweenness_centrality for r in found.collect()} == pytest.approx(want)


def test_betweenness_without_paths(spark):
    accounts = spark.createDataFrame([("a",), ("b",), ("c",)], "account_id string")
    for edges in ([], [("a", "b"), ("c", "b")]):
        found = graph_search.betweenness(frame(spark, edges), accounts, rows_in_flight=1)
        assert {tuple(r) for r in found.collect()} == {("a", 0.0), ("b", 0.0), ("c", 0.0)}


def test_clustering(spark):
    edges = random_edges(15, 70, 6)
    simple = [e for e in edges if e[0] != e[1]]
    nodes = sorted({x for e in simple for x in e})
    at = {v: i for i, v in enumerate(nodes)}
    a = np.zeros((len(nodes), len(nodes)))
    for u, v in simple:
        a[at[u], at[v]] = 1
    s = a + a.T
    cube = np.linalg.matrix_power(s, 3)
    want = {}
    for v, i in at.items():
        total, mutual = s[i].sum(), (s[i] == 2).sum()
        want[v] = cube[i, i] / (2 * (total * (total - 1) - 2 * mutual)) if cube[i, i] else 0.0
    got = {r.account_id: r.clustering_coefficient for r in graph.clustering(frame(spark, edges)).collect()}
    assert got == pytest.approx(want)


def test_components(spark):
    edges = random_edges(60, 45, 8) + [(f"C{i:03d}", f"C{i + 1:03d}") for i in range(80)] + [("HUB", f"L{i}") for i in range(50)]
    nodes = {x for e in edges for x in e} | {"ALONE"}
    root = {v: v for v in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(root[a], root[b])
            if root[a] != low or root[b] != low:
                root[a] = root[b] = low
                changed = True
    vertices = spark.createDataFrame([(v,) for v in nodes], "id string")
    all_edges = spark.createDataFrame(edges, "src string, dst string")
    got = {r.id: r.component for r in graph_search.connected_components(vertices, all_edges).collect()}
    assert got == root


def test_walks_follow_edges_and_repeat(spark):
    links = graph.undirected_edges(frame(spark, random_edges(12, 20, 9)))
    accounts = spark.createDataFrame([(f"N{i}",) for i in range(12)] + [("ALONE",)], "account_id string")
    pairs = {(r.src, r.dst) for r in links.collect()}
    first = {(r.start, r.walk): r.path for r in graph_search.random_walks(accounts, links, 4, 9).collect()}
    again = {(r.start, r.walk): r.path for r in graph_search.random_walks(accounts, links, 4, 9).collect()}
    assert first == again and len(first) == 13 * 4
    assert first["ALONE", 0] == ["ALONE"]
    assert all(step in pairs for path in first.values() for step in zip(path, path[1:]))


def brute_dbscan(x, eps, minimum):
    near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)) <= eps
    core = near.sum(1) >= minimum
    label, count = np.full(len(x), -1), 0
    for i in range(len(x)):
        if core[i] and label[i] < 0:
            stack = [i]
            label[i] = count
            while stack:
                for k in np.flatnonzero(near[stack.pop()]):
                    if label[k] < 0:
                        label[k] = count
                        if core[k]:
                            stack.append(k)
            count += 1
    return label


@pytest.mark.parametrize("block", [8, 64])
def test_dbscan(spark, block):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(c, 0.25, (25, 2)) for c in ((0, 0), (1.4, 0), (4, 4))] + [rng.uniform(-2, 6, (25, 2))])
    x = np.concatenate([x, np.repeat(x[:1], 12, axis=0)])
    rows = [(i, [float(a) for a in v]) for i, v in enumerate(x)]
    points = spark.createDataFrame(rows, "id long, vector array<double>")
    radii = [0.2, 0.35, 0.6]
    got = {}
    for r in density.dbscan(points, radii, 5, block=block, fanout=6).collect():
        got.setdefault(r.eps, {})[r.id] = r.cluster_label
    for eps in radii:
        want = brute_dbscan(x, eps, 5)
        assert [got[eps][i] for i in range(len(x))] == want.tolist()


def cloud(seed):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(c, 0.25, (40, 3)) for c in ((0, 0, 0), (1.4, 0, 0), (4, 4, 0), (4, 4, 1))] + [rng.uniform(-2, 6, (60, 3))])
    return np.concatenate([x, np.repeat(x[:1], 12, axis=0)])


def as_points(spark, x):
    return spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "id long, vector array<double>")


@pytest.mark.parametrize("tree", [False, True])
def test_dbscan_with_and_without_pivots(spark, monkeypatch, tree):
    monkeypatch.setattr(density, "FEW_BLOCKS", 0 if tree else 1e9)
    monkeypatch.setattr(density, "all_near", lambda *_: False)
    x, radii = cloud(3), [0.35, 0.5, 1.0]
    got = {}
    for r in density.dbscan(as_points(spark, x), radii, 5, block=9, fanout=6).collect():
        got.setdefault(r.eps, {})[r.id] = r.cluster_label
    for eps in radii:
        assert [got[eps][i] for i in range(len(x))] == brute_dbscan(x, eps, 5).tolist()
    near = (np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)) <= 0.5).sum(1)
    counted = {r.id: r.neighbours for r in density.neighbour_counts(as_points(spark, x), 0.5, block=9, fanout=6).collect()}
    assert [counted[i] for i in range(len(x))] == near.tolist()


def test_points_without_pivots_meet_few_blocks(spark, monkeypatch):
    x = np.random.default_rng(8).normal(size=(600, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    points, compared = as_points(spark, x), []
    monkeypatch.setattr(density, "FEW_BLOCKS", 0)
    layout = density._layout(points, 1.3, block=30)
    assert isinstance(layout, density.AllPairs) and layout.blocks == 20
    met = density.AllPairs._met
    monkeypatch.setattr(
        density.AllPairs, "_met", lambda self, members, visitors, offsets, few=False: compared.append(members.count() * len(offsets)) or met(self, members, visitors, offsets, few)
    )
    got = {r.key: r.n for r in layout.counts([1.3, 1.35], stop=5).collect()}
    near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    keys = {r.id: r.key for r in layout.ids.collect()}
    for e, r in enumerate((1.3, 1.35)):
        for i, n in enumerate((near <= r).sum(1)):
            assert got[keys[i]][e] == n if n < 5 else 5 <= got[keys[i]][e] <= n
    assert sum(compared) < 600 * 20 / 2  # (point, block) pairs; all of them would be 12,000


@pytest.mark.parametrize("size", [1.0, 1e3, 1e20])
def test_close_pairs_at_the_radius(size):
    rng = np.random.default_rng(1)
    a, b = rng.integers(-3, 4, (70, 5)) * size, rng.integers(-3, 4, (50, 5)) * size
    radii = [2.0 * size, 5.0 * size]  # whole numbers: many distances are the radius itself
    d, got = density._distances(a, b), [set(), set()]
    for e, i, j in density._close_pairs(a, b, radii):
        got[e] |= set(zip(i.tolist(), j.tolist(), strict=True))
    assert got == [{tuple(p) for p in np.argwhere(d <= r).tolist()} for r in radii]


def test_walks_carry_a_few_accounts_only(spark, monkeypatch):
    links = [(f"N{i}", f"N{(i + s) % 9}") for i in range(9) for s in (1, 2, 7, 8)]
    links = spark.createDataFrame(links, "src string, dst string")
    accounts = spark.createDataFrame([(f"N{i}",) for i in range(9)] + [("ALONE",)], "account_id string")
    stored, write = [], graph_search.materialize

    def kept(df, label="step"):
        stored.append(write(df, label))
        return stored[-1]

    monkeypatch.setattr(graph_search, "materialize", kept)
    found = {(r.start, r.walk): r.path for r in graph_search.random_walks(accounts, links, 3, 20).collect()}
    longest = max(df.selectExpr("max(size(path)) AS n").first().n for df in stored if "path" in df.columns)
    assert longest <= graph_search.WALK_PART + 1
    monkeypatch.setattr(graph_search, "WALK_PART", 100)
    assert found == {(r.start, r.walk): r.path for r in graph_search.random_walks(accounts, links, 3, 20).collect()}
    assert found["ALONE", 0] == ["ALONE"] and all(len(p) == 20 for (s, _), p in found.items() if s != "ALONE")


def test_cycle_searches_leave_out_accounts_that_only_pay(spark, monkeypatch):
    ring = [("A", "B"), ("B", "C"), ("C", "A"), ("C", "B")]
    edges = frame(spark, ring + [(f"P{i}", x) for i in range(300) for x in "ABC"] + [("A", "END"), ("Q", "P0")])
    rows, write = [], graph_search.materialize

    def counted(df, label="step"):
        stored = write(df, label)
        rows.append((label, stored.count()))
        return stored

    monkeypatch.setattr(graph_search, "materialize", counted)
    assert {r.account_id for r in graph_search.accounts_on_cycles(edges).collect()} == set("ABC")
    found = graph_search.shortest_cycles(edges, edges.selectExpr("src AS account_id").distinct()).collect()
    assert {(r.account_id, r.cycle_length, tuple(r.path)) for r in found} == {("A", 3, tuple("ABC")), ("B", 2, tuple("BC")), ("C", 2, tuple("CB"))}
    assert max(n for label, n in rows if label != "simple") < 20


def test_betweenness_with_many_payers(spark):
    """An account paid by many: its dependencies go back to those on a way to it only."""
    first, other = [f"P{i}" for i in range(3000)], [f"Q{i}" for i in range(3000)]
    edges = [(p, "X") for p in first] + [("X", "Z")] + [(q, "Z") for q in other] + [("Z", "W")]
    nodes = {x for e in edges for x in e} | {"ALONE"}
    accounts = spark.createDataFrame([(v,) for v in sorted(nodes)], "account_id string")
    got = {r.account_id: r.betweenness_centrality for r in graph_search.betweenness(frame(spark, edges), accounts).collect()}
    n = len(nodes)
    assert got["X"] == pytest.approx(3000 * 2 / ((n - 1) * (n - 2))) and got["Z"] == pytest.approx(6001 / ((n - 1) * (n - 2)))
    assert sum(v > 0 for v in got.values()) == 2 and len(got) == n


def test_walk_pairs_count_both_ways(spark):
    walks = [(a, i, list(p)) for i, (a, p) in enumerate((("A", "ABACBD"), ("B", "BB"), ("C", "C"), ("D", "DCBABCDA")))]
    found = graph_search.walk_pairs(spark.createDataFrame(walks, "start string, walk int, path array<string>"), 2).collect()
    want = {}
    for _, _, p in walks:
        for i, j in itertools.permutations(range(len(p)), 2):
            if abs(i - j) <= 2 and p[i] != p[j]:
                want[p[i], p[j]] = want.get((p[i], p[j]), 0) + 1
    assert {(r.account_id, r.other): r.n for r in found} == want and len(found) == len(want)


def test_projection_keeps_communities_apart(spark):
    walks = spark.createDataFrame(
        [(a, 0, [a, b, a, b]) for a, b in (("A", "B"), ("B", "A"), ("C", "D"), ("D", "C"))] + [("E", 0, ["E"])],
        "start string, walk int, path array<string>",
    )
    got = {r.account_id: np.array(r.vector) for r in graph_search.embed_walks(walks, 8, 2).collect()}
    assert set(got) == set("ABCDE") and not got["E"].any() and got["A"].any()


def test_biased_walks_follow_the_definition(spark):
    edges = [("A", "B"), ("A", "C"), ("B", "C"), ("C", "D")]
    both = spark.createDataFrame(edges + [(b, a) for a, b in edges], "src string, dst string")
    accounts = spark.createDataFrame([(a,) for a in "ABCDE"], "account_id string")
    p, q = 4.0, 0.5
    rows = graph_search.random_walks(accounts, both, 4000, 3, seed=3, p=p, q=q).collect()
    seen = {}
    for r in rows:
        if r.start == "E":
            assert r.path == ["E"]
        else:
            seen.setdefault((r.path[0], r.path[1]), []).append(r.path[2])
    out = {a: {y for x, y in edges + [(y, x) for x, y in edges] if x == a} for a in "ABCD"}
    for (t, v), nexts in seen.items():
        weight = {x: 1 / p if x == t else 1.0 if x in out[t] else 1 / q for x in out[v]}
        for x, w in weight.items():
            assert abs(nexts.count(x) / len(nexts) - w / sum(weight.values())) < 0.06


def test_uniform_walks_do_not_change_with_the_bias_off(spark):
    both = spark.createDataFrame([("A", "B"), ("B", "A"), ("A", "C"), ("C", "A")], "src string, dst string")
    accounts = spark.createDataFrame([("A",), ("B",), ("C",)], "account_id string")
    walks = [sorted(graph_search.random_walks(accounts, both, 20, 5, 7, *bias).collect()) for bias in ((), (1.0, 1.0))]
    assert walks[0] == walks[1] and all(len(r.path) == 5 for r in walks[0])


@pytest.mark.parametrize("block", [1024, 9])
def test_skip_gram_keeps_communities_together(spark, monkeypatch, block):
    monkeypatch.setattr(graph_search, "BLOCK_ACCOUNTS", block)
    names = [[f"{g}{i}" for i in range(10)] for g in "ABC"]
    edges = [(x, y) for group in names for x in group for y in group if x != y] + [("A0", "B0"), ("B0", "A0"), ("B1", "C1"), ("C1", "B1")]
    accounts = spark.createDataFrame([(x,) for group in names for x in group], "account_id string")
    walks = graph_search.random_walks(accounts, spark.createDataFrame(edges, "src string, dst string"), 20, 12, seed=5).cache()
    runs = [{r.account_id: tuple(r.vector) for r in graph_search.skip_gram(walks, 16, 4, seed=1, epochs=4).collect()} for _ in range(2)]
    assert runs[0] == runs[1] and len(runs[0]) == 30
    v = {k: np.array(x) / np.linalg.norm(x) for k, x in runs[0].items()}
    near = [max((x for x in v if x != k), key=lambda x: v[x] @ v[k])[0] == k[0] for k in v]
    assert sum(near) >= 28


def test_pivot_tree_compares_in_proportion_to_the_points(spark):
    rng, compared = np.random.default_rng(4), []
    for groups in (30, 150):
        centres = rng.uniform(-60, 60, (groups, 3))
        x = np.concatenate([rng.normal(c, 0.3, (40, 3)) for c in centres])
        points = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "id long, vector array<double>")
        layout = density.NeighbourBlocks(points, 0.5, fanout=8, block=16)
        compared.append(layout.compared_pairs() / len(x))
        got = {r.key: r.n[0] for r in layout.counts([0.5]).collect()}
        keys = {r.id: r.key for r in layout.ids.collect()}
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)) if groups == 30 else None
        if d is not None:
            assert [got[keys[i]] for i in range(len(x))] == (d <= 0.5).sum(axis=1).tolist()
    assert compared[1] < 2 * compared[0]
