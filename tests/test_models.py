"""Models, measures and fusion."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from moneytrail.operators import boosting, features, isolation, metrics, models, risk
from moneytrail.session import scratch_path

NAMES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def matrix(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(120, 3))
    y = (x[:, 0] + 0.5 * x[:, 1] > 0).astype(int)
    rows = [(f"A{i:03d}", f"S{i}", f"E{i % 3}", int(y[i]), *map(float, x[i])) for i in range(120)]
    return spark.createDataFrame(rows, "account_id string, scenario_id string, employee_id string, label int, a double, b double, c double").cache()


@pytest.fixture(scope="module")
def model(matrix):
    return models.fit_classifier(matrix, NAMES, trees=4)


def probabilities(df):
    return {r.account_id: r.model_probability for r in df.collect()}


def test_trees_split_values_that_are_neighbours():
    # Two values with no number between them: a draw that rounds to the upper one would leave a side empty.
    x = np.array([[0.1], [np.nextafter(0.1, 1)]] * 4)
    for tree in range(40):
        grown = isolation._grow(tree, x, 42)
        assert grown["size"].tolist() == [8, 4, 4] and (grown["size"] > 0).all()


def test_contributions_are_looked_up_by_path():
    # Three leaves, one with four features; values that miss or follow each bound, and null as NaN.
    inf = float("inf")
    leaves = [
        (0.7, {0: (-inf, 0.5, 0.25), 2: (0.1, 0.9, 0.5), 1: (0.3, inf, 0.75), 3: (-inf, 0.2, 0.1)}),
        (-0.4, {1: (-inf, 0.3, 0.6)}), (0.2, {}),
    ]
    rng = np.random.default_rng(1)
    x = np.vstack([rng.uniform(size=(60, 4)), [[0.5, 0.3, 0.1, 0.2], [np.nan] * 4]])
    got = models._contributions(x, models._leaf_tables(leaves))
    for row, phi in zip(x, got, strict=True):
        want = np.zeros(4)
        for value, path in leaves:
            for order in itertools.permutations(path):
                product = value * np.prod([p[2] for p in path.values()])
                for f in order:
                    low, high, share = path[f]
                    after = product / share * (low < row[f] <= high)
                    want[f] += (after - product) / math.factorial(len(path))
                    product = after
        assert phi == pytest.approx(want, abs=1e-12)


def test_contributions_match_shapley_definition(spark, model, matrix):
    nodes = models.tree_nodes(model)
    table = {}
    for n in nodes.collect():
        table.setdefault(n.tree, {})[n.node] = n

    def expected(x, known):
        def at(tree, i):
            n = tree[i]
            if n.left < 0:
                return n.value
            if n.feature in known:
                return at(tree, n.left if x[n.feature] <= n.threshold else n.right)
            return sum(tree[k].cover / n.cover * at(tree, k) for k in (n.left, n.right))

        return sum(at(t, 0) for t in table.values())

    sample = matrix.limit(5)
    got = {(r.account_id, r.feature): r.contribution for r in models.feature_contributions(nodes, sample, NAMES).collect()}
    for r in sample.collect():
        x = [r.a, r.b, r.c]
        for f in range(3):
            others = [g for g in range(3) if g != f]
            value = 0.0
            for k, weight in ((0, 1 / 3), (1, 1 / 6), (2, 1 / 3)):
                for known in itertools.combinations(others, k):
                    value += weight * (expected(x, {*known, f}) - expected(x, set(known)))
            assert got[r.account_id, NAMES[f]] == pytest.approx(value, abs=1e-9)
        p = probabilities(models.score_accounts(model, sample))[r.account_id]
        total = models.expected_log_odds(nodes) + sum(got[r.account_id, n] for n in NAMES)
        assert total == pytest.approx(np.log(p / (1 - p)), abs=1e-6)


def test_node_table_scores_like_the_model(model, matrix):
    rows = models.score_by_nodes(models.tree_nodes(model), matrix, NAMES, 3, 4)
    assert probabilities(rows) == pytest.approx(probabilities(models.score_accounts(model, matrix)))


def test_reload(spark, model, matrix):
    path = scratch_path(spark, "model")
    models.save_model(model, path, note="kept")
    again, facts = models.load_model(path)
    assert facts == {"feature_names": NAMES, "note": "kept"}
    assert probabilities(models.score_accounts(again, matrix)) == pytest.approx(probabilities(models.score_accounts(model, matrix)), abs=1e-6)


def test_trees_match_brute_force(spark, matrix):
    """Gains, splits and leaf values of every node of two trees, for the model on all rows and each fold."""
    settings = dict(trees=2, l1=0.3, l2=0.7, row_share=1.0, column_share=1.0)
    models_of, scored = boosting.fit_folds(matrix, NAMES, "employee_id", **settings)
    rows = matrix.orderBy("account_id").collect()
    x = np.array([[r.a, r.b, r.c] for r in rows])
    y, group = np.array([r.label for r in rows]), np.array([r.employee_id for r in rows])
    probability = {r.account_id: r.model_probability for r in scored.collect()}
    s = boosting.Settings(**settings)
    cut = lambda g: np.sign(g) * max(abs(g) - s.l1, 0)
    assert sorted(models_of) == ["*", "E0", "E1", "E2"]
    for fold, model in models_of.items():
        use, margin = group != fold, np.zeros(len(y))
        for tree in model.trees:
            p = 1 / (1 + np.exp(-margin))
            g, h = (p - y) * use, p * (1 - p) * use
            at, done = {0: np.ones(len(y), bool)}, np.zeros(len(y))
            for node in range(len(tree.value)):
                if node not in at:
                    continue
                inside = at[node]
                part = lambda m: cut(g[m].sum()) ** 2 / (h[m].sum() + s.l2)
                best = (-np.inf, None, None)
                for f in range(3):
                    for edge in model.edges[f]:
                        left, right = inside & (x[:, f] <= edge), inside & (x[:, f] > edge)
                        if h[left].sum() >= 1 and h[right].sum() >= 1:
                            gain = (part(left) + part(right) - part(inside)) / 2
                            best = max(best, (gain, f, edge), key=lambda b: (round(b[0], 9), -(b[1] or 0)))
                if tree.feature[node] >= 0:
                    f, edge = tree.feature[node], model.edges[tree.feature[node]][tree.split[node]]
                    assert tree.gain[node] == pytest.approx(best[0]) and f == best[1]
                    at[2 * node + 1], at[2 * node + 2] = inside & (x[:, f] <= edge), inside & (x[:, f] > edge)
                else:
                    assert node > 6 or best[0] <= 1e-6
                    want = -s.rate * cut(g[inside].sum()) / (h[inside].sum() + s.l2)
                    assert tree.value[node] == pytest.approx(want)
                    done[inside] = want
            margin += done
        for r, m in zip(rows, margin, strict=True):
            if r.employee_id == fold:
                assert probability[r.account_id] == pytest.approx(1 / (1 + np.exp(-m)))


def test_feature_sets_grow_as_if_alone(matrix):
    rows = matrix.withColumn("d", F.col("a") * 2 - F.col("c"))
    sets = {"first": ["a", "b", "c"], "second": ["d", "b"]}
    both = boosting.fit_sets(rows, sets, "employee_id", whole=False, trees=3)
    for name, names in sets.items():
        alone, scored = boosting.fit_folds(rows.drop(*{"a", "b", "c", "d"} - set(names)), names, "employee_id", whole=False, trees=3, row_share=1.0)
        again = boosting.fit_sets(rows, sets, "employee_id", whole=False, trees=3, row_share=1.0)[name]
        assert {k: m.node_rows() for k, m in alone.items()} == {k: m.node_rows() for k, m in again[0].items()}
        assert probabilities(scored) == probabilities(again[1])
    assert both["first"][1].count() == 120


def test_boosting_of_odd_rows(spark, matrix, monkeypatch):
    monkeypatch.setattr(boosting, "FOLDS_AT_ONCE", 2)
    odd = matrix.withColumn("a", F.when(F.col("a") > 1, None).otherwise(F.col("a"))).withColumn("b", F.lit(1.0))
    odd = odd.withColumn("employee_id", F.when(F.col("employee_id") != "E2", F.col("employee_id")))
    models_of, scored = boosting.fit_folds(odd, NAMES, "employee_id", trees=3)
    assert set(models_of) == {"*", "E0", "E1", None} and scored.count() == 120 and scored.filter("model_probability IS NULL").count() == 0
    assert not models_of["*"].edges[1]
    again, _ = boosting.fit_folds(odd.repartition(3), NAMES, trees=3)
    assert [t.feature.tolist() for t in again["*"].trees] == [t.feature.tolist() for t in models_of["*"].trees]


def test_missing_feature(model, matrix):
    with pytest.raises(ValueError):
        models.score_accounts(model, matrix.drop("b"))


def test_leave_one_group_out(matrix):
    found = models.leave_one_group_out(matrix, NAMES, "employee_id", trees=3)
    assert found.count() == 120 and found.select("fold").distinct().count() == 3
    quality = {r.measure: r.value for r in models.quality_table(found).collect()}
    assert quality["roc_auc"] > 0.8


def test_forest(matrix):
    nodes = isolation.fit_forest(matrix, NAMES, trees=30, size=64)
    again = isolation.fit_forest(matrix, NAMES, trees=30, size=64)
    assert sorted(map(tuple, nodes.collect())) == sorted(map(tuple, again.collect()))
    assert {r["size"] for r in nodes.filter("node = 0").collect()} == {64}
    far = matrix.limit(1).withColumns({"account_id": F.lit("far"), **{n: F.lit(30.0) for n in NAMES}})
    scores = isolation.isolation_scores(nodes, matrix.unionByName(far), NAMES).collect()
    values = {r.account_id: r.isolation_score for r in scores}
    assert all(0 < v < 1 for v in values.values())
    assert values["far"] > np.percentile(list(values.values()), 90)
    base = metrics.feature_baselines(matrix, NAMES)
    far = far.withColumns({n: F.lit(r.median) for n, r in zip("bc", base.filter("feature != 'a'").orderBy("feature").collect())})
    top = isolation.top_attributions(isolation.attributions(nodes, far, NAMES, base), 1).first()
    assert top.feature == "a" and top.direction == "elevated" and top.score_delta > 0


def test_forest_score_matches_node_table(matrix):
    nodes = isolation.fit_forest(matrix, NAMES, trees=5, size=32)
    table = {(n.tree, n.node): n for n in nodes.collect()}
    c = lambda n: 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n
    got = {r.account_id: r.isolation_score for r in isolation.isolation_scores(nodes, matrix, NAMES).collect()}
    for r in matrix.limit(10).collect():
        lengths = []
        for tree in range(5):
            n = table[tree, 0]
            while n.feature >= 0:
                n = table[tree, n.left if r[NAMES[n.feature]] <= n.threshold else n.right]
            lengths.append(n.depth + c(n["size"]))
        assert got[r.account_id] == pytest.approx(2 ** (-np.mean(lengths) / c(32)))


def test_unknown_label_fails(spark):
    df = spark.createDataFrame([("S1", "unknown_typo", "A")], "scenario_id string, scenario_type string, account_id string")
    with pytest.raises(Exception, match="scenario_type"):
        features.labeled_scenarios(df).collect()


def test_label_columns_are_refused(spark):
    from moneytrail.operators.clean import assert_no_labels

    with pytest.raises(ValueError):
        assert_no_labels(spark.createDataFrame([(1,)], "is_laundering int"))


# Component scores, risk and tiers of published scenarios.
GOLDEN = [
    ("S01", 1.0, 0.9048, 0.6688, 0.25, 0.76, "High", 0.756, "Critical"),
    ("S02", 1.0, 0.7741, 0.6203, 0.2941, 0.7264, "High", 0.6927, "High"),
    ("S18", 1.0, 0.4299, 0.5839, 0.1941, 0.6131, "High", 0.4955, "Medium"),
    ("S19", 1.0, 0.8454, 0.6343, 0.6011, 0.8084, "Critical", 0.7917, "Critical"),
    ("L15", 1.0, 0.5826, 0.5888, 0.35, 0.6834, "High", 0.6037, "High"),
    ("L19", 0.0, 0.1416, 0.5489, 0.4, 0.2252, "Low", 0.2276, "Low"),
]


def test_golden_risk(spark):
    spine = spark.createDataFrame([(g[0],) for g in GOLDEN] + [("X",)], "account_id string")
    fired = spark.createDataFrame([(g[0], ["R"], g[1]) for g in GOLDEN if g[1]], "account_id string, fired_rules array<string>, rule_score double")
    prob = spark.createDataFrame([(g[0], g[2]) for g in GOLDEN], "account_id string, model_probability double")
    iso = spark.createDataFrame([(g[0], g[3], True) for g in GOLDEN], "account_id string, isolation_score double, is_isolation_flagged boolean")
    gr = spark.createDataFrame([(g[0], g[4]) for g in GOLDEN], "account_id string, graph_anomaly_score double")
    got = {r.account_id: r for r in risk.fused_risk(spine, fired, prob, iso, gr).collect()}
    for name, *_, baseline, baseline_tier, score, tier in GOLDEN:
        r = got[name]
        assert (r.baseline_score, r.risk_score) == (pytest.approx(baseline, abs=1e-4), pytest.approx(score, abs=1e-4))
        assert (r.baseline_tier, r.risk_tier) == (baseline_tier, tier)
    assert got["X"].risk_score == 0.0 and got["X"].fired_rules == []


def test_jackknife_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    y, p = rng.integers(0, 2, 30), np.round(rng.uniform(size=30), 1)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, p)], "label int, score double")

    def auc(y, p):
        a, b = p[y == 1], p[y == 0]
        return ((a[:, None] > b).sum() + 0.5 * (a[:, None] == b).sum()) / (len(a) * len(b))

    def f1(y, p):
        tp, fp, fn = ((y == 1) & (p >= 0.5)).sum(), ((y == 0) & (p >= 0.5)).sum(), ((y == 1) & (p < 0.5)).sum()
        return 2 * tp / (2 * tp + fp + fn)

    got = {r.measure: r.standard_error for r in metrics.jackknife(df, "label", "score").collect()}
    for name, fn in (("roc_auc", auc), ("f1", f1)):
        each = np.array([fn(np.delete(y, i), np.delete(p, i)) for i in range(30)])
        assert got[name] == pytest.approx(np.sqrt(29 * each.var()))


def test_jackknife_of_a_users_measure(spark):
    rng = np.random.default_rng(3)
    y, p = rng.integers(0, 2, 25), rng.uniform(size=25)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, p)] + [(None, None)], "label int, score double")
    hit = ((F.col("label") == 1) & (F.col("score") >= 0.3)).cast("int")
    share = metrics.SumMeasure({"hit": hit, "all": F.col("label")}, lambda t: t["hit"] / t["all"] - 0.1 * t["all"])
    got = metrics.jackknife_of(df, {"own": share}).collect()
    own = lambda y, p: ((y == 1) & (p >= 0.3)).sum() / y.sum() - 0.1 * y.sum()
    y, p = np.append(y, 0), np.append(p, 0.0)  # the row of nulls adds nothing
    each = np.array([own(np.delete(y, i), np.delete(p, i)) for i in range(26)])
    assert [r.measure for r in got] == ["own"] and got[0].value == pytest.approx(own(y, p))
    assert got[0].standard_error == pytest.approx(np.sqrt(25 * each.var()))
