"""Queries over evaluation measures and data quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features, metrics, quality, rule_config, rules
from ..operators.skew import quantiles
from ..session import materialize
from .feature_queries import ALL_FEATURES, FEATURE_RELATIONS, FEATURES, matrix, r6, rounded
from .oracle import sql
from .rule_queries import RULE_RELATIONS, RULE_ROWS, rule_results


def scored(s):
    """Label and score of every labelled document."""
    docs = s.table("documents").select("doc_id", "n_chars", "source")
    return s.table("labels").join(docs, "doc_id").select(
        F.col("doc_id").cast("string").alias("account_id"),
        "source",
        (1 - F.col("quality")).alias("label"),
        (F.col("n_chars") / (F.col("n_chars") + 1000.0)).alias("score"),
    )


SCORED = {
    "sc": "SELECT CAST(doc_id AS VARCHAR) AS account_id, source, 1 - quality AS label, n_chars / (n_chars + 1000.0::DOUBLE) "
    "AS score FROM labels JOIN documents USING (doc_id)"
}


def roc_auc(s):
    ranked = metrics.ranking_table(scored(s), "label", "score")
    return rounded(metrics.ranking_quality(ranked).select("roc_auc"))


def average_precision(s):
    ranked = metrics.ranking_table(scored(s), "label", "score")
    return rounded(metrics.ranking_quality(ranked).select("average_precision"))


def ranking_by_source(s):
    """Every source, the null one too; a source with one class has no measures."""
    key = F.when(F.col("source").isNull(), "1").otherwise(F.concat(F.lit("0"), "source"))
    ranked = metrics.ranking_table(scored(s).withColumn("key", key), "label", "score", ["key"])
    found = metrics.ranking_quality(materialize(ranked, "ranked"), ["key"])
    source = F.when(F.col("key") != "1", F.expr("substring(key, 2)")).alias("source")
    return rounded(found.select(source, "roc_auc", "average_precision"))


def cut_quality(s):
    return rounded(metrics.cut_quality(scored(s), "label", "score", 0.5))


def jackknife_errors(s):
    return rounded(metrics.jackknife(scored(s), "label", "score", 0.5))


def jackknife_of_measures(s):
    """Two measures of a user's own: specificity at 0.5, and the mean squared error of the score."""
    negative, low = (F.col("label") == 0).cast("int"), (F.col("score") < 0.5).cast("int")
    measures = {
        "specificity": metrics.SumMeasure({"kept": negative * low, "all": negative}, lambda t: t["kept"] / F.nullif(t["all"], F.lit(0.0))),
        "squared_error": metrics.SumMeasure(
            {"sum": F.pow(F.col("score") - F.col("label"), F.lit(2)), "n": F.lit(1)}, lambda t: t["sum"] / F.nullif(t["n"], F.lit(0.0))
        ),
    }
    return rounded(metrics.jackknife_of(scored(s), measures))


def leave_one_out_means(s):
    return rounded(metrics.leave_one_out_means(scored(s), "score").select("account_id", "mean_of_others"))


def score_distribution(s):
    return rounded(metrics.score_distribution(scored(s), "label", "score", 0.5))


def background_threshold(s):
    background = scored(s).filter("label = 0")
    return rounded(quantiles(background, "score", [0.95, 0.5]).select(F.col("q0").alias("threshold"), F.col("q1").alias("median")))


BASELINE_FEATURES = [n for group, names in features.FEATURE_GROUPS.items() if group != "rules" for n in names]


def feature_baselines(s):
    stored = materialize(matrix(s).select("account_id", *BASELINE_FEATURES), "matrix")
    return rounded(metrics.feature_baselines(stored, BASELINE_FEATURES))


def ranked_anomalies(s):
    df = scored(s)
    threshold = quantiles(df.filter("label = 0"), "score", [0.95]).select("q0").scalar()
    return rounded(metrics.ranked_anomalies(df, "score", threshold, 15).drop("source"))


def top_features(s):
    stored = materialize(matrix(s).select("account_id", *BASELINE_FEATURES), "matrix")
    long = metrics.long_features(stored, BASELINE_FEATURES).withColumn("value", F.round(F.col("value") + 1e-9, 6))
    return metrics.top_per_account(long, [F.abs("value").desc(), F.col("feature")], 4).withColumn("rank", F.col("rank").cast("bigint"))


def match_rates(s):
    known = s.ledger().select("from_account").unionByName(s.ledger().select(F.col("to_account").alias("from_account")))
    known = materialize(known.distinct(), "known")
    checks = (
        ("access events", s.access_events(), "target_account_id"),
        ("profile changes", s.profile_changes(), "customer_id"),
        ("employee map", s.employee_map(), "customer_id"),
        ("customers", s.customers(), "customer_id"),
    )
    found = None
    for name, df, column in checks:
        one = quality.match_rate(name, df, column, known)
        found = one if found is None else found.unionByName(one)
    return rounded(found)


def _lists(df):
    return df.select([F.array_join(c, ";").alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes])


def scenario_signals(s):
    results, _ = rule_results(s)
    return _lists(quality.scenario_signals(s.scenarios(), results)).withColumn("matched", F.col("matched").cast("int"))


def detection_summary(s):
    results, _ = rule_results(s)
    signals = materialize(quality.scenario_signals(s.scenarios(), results), "signals")
    return rounded(quality.detection_summary(signals, results, s.scenarios()))


def evidence_audit(s):
    results, evidence = rule_results(s, with_evidence=[rule_config.PRIVILEGE_CHANGE, rule_config.CIRCULAR])
    positioned = rules.payment_positions(rules.rule_payments(s.ledger()))
    return quality.evidence_audit(
        s.scenarios(), results, evidence, s.access_events(), s.profile_changes(), s.injected(), positioned
    )


def scenario_integrity(s):
    return quality.scenario_integrity(s.scenarios(), s.access_events(), s.injected())


_RANKS = {
    **SCORED,
    "g": "SELECT score, sum(label) AS pos, count(*) - sum(label) AS neg FROM sc GROUP BY 1",
    "t": "SELECT sum(pos) AS p, sum(neg) AS n FROM g",
    "x": "SELECT *, sum(neg) OVER (ORDER BY score) - neg AS nb, sum(pos) OVER (ORDER BY score DESC) AS tp, "
    "sum(neg) OVER (ORDER BY score DESC) AS fp FROM g, t",
}

_JACK = """WITH RECURSIVE sc AS ({sc}), c AS (SELECT i.account_id AS i, j.label, j.score FROM sc i JOIN sc j ON
    i.account_id <> j.account_id),
    pairs AS (SELECT p.i, avg(CASE WHEN p.score > q.score THEN 1.0::DOUBLE WHEN p.score = q.score THEN 0.5::DOUBLE ELSE 0 END)
        AS auc FROM c p JOIN c q ON q.i = p.i AND p.label = 1 AND q.label = 0 GROUP BY 1),
    k AS (SELECT i, count(*) FILTER (label = 1 AND score >= 0.5)::DOUBLE AS tp, count(*) FILTER (label = 0 AND score >= 0.5)
        AS fp, count(*) FILTER (label = 1 AND score < 0.5) AS fn, count(*) AS n, count(*) FILTER ((label = 1) = (score >= 0.5))
        AS ok FROM c GROUP BY 1),
    m AS (SELECT i, 'roc_auc' AS measure, auc AS x FROM pairs UNION ALL SELECT i, 'precision', CASE WHEN tp + fp > 0 THEN
        tp / (tp + fp) ELSE 0 END FROM k UNION ALL SELECT i, 'recall', CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END
        FROM k UNION ALL SELECT i, 'f1', CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END FROM k
        UNION ALL SELECT i, 'accuracy', ok::DOUBLE / n FROM k)
    SELECT measure, round(sqrt((count(*) - 1) * var_pop(x)) + 1e-9, 6) AS standard_error FROM m GROUP BY 1"""

_LONG = (
    "SELECT account_id, unnest([" + ", ".join(f"'{c}'" for c in BASELINE_FEATURES) + "]) AS feature, unnest(["
    + ", ".join(f"CAST({c} AS DOUBLE)" for c in BASELINE_FEATURES) + f"]) AS value FROM {ALL_FEATURES}"
)

_RATE = """SELECT '{name}' AS "check", count(*) AS distinct_keys, count(*) FILTER (hit) AS matched_keys,
    CAST(sum(n) AS BIGINT) AS rows, CAST(coalesce(sum(n) FILTER (hit), 0) AS BIGINT) AS matched_rows,
    round(count(*) FILTER (hit) * 100.0::DOUBLE / count(*) + 1e-9, 6) AS match_percent,
    count(*) FILTER (hit) * 100.0 / count(*) < 50 AS warning FROM (SELECT {column} AS k, count(*) AS n,
    {column} IN (SELECT account_id FROM touch) AS hit FROM {table} GROUP BY 1)"""

_SIGNAL_ROWS = {
    **RULE_ROWS,
    "exp": "SELECT DISTINCT scenario_id, trim(t.x) AS sig FROM scenarios, unnest(string_split(expected_signals, ',')) AS t(x) "
    "WHERE trim(t.x) <> ''",
    "det": """SELECT DISTINCT scenario_id, CASE rule_id WHEN 'INSIDER.PRIVILEGE_CHANGE' THEN 'privilege_change'
        WHEN 'AML.CIRCULAR_TRANSFER' THEN 'circular_transfer' ELSE 'transaction_splitting' END AS sig
        FROM scenario_accounts JOIN (SELECT DISTINCT rule_id, account_id FROM results) USING (account_id)""",
    "testable": "SELECT * FROM exp WHERE sig IN ('privilege_change', 'circular_transfer', 'transaction_splitting')",
    "sigs": """SELECT s.scenario_id, s.scenario_type,
        coalesce((SELECT string_agg(sig, ';' ORDER BY sig) FROM testable t WHERE t.scenario_id = s.scenario_id), '') AS testable,
        coalesce((SELECT string_agg(sig, ';' ORDER BY sig) FROM exp t WHERE t.scenario_id = s.scenario_id AND sig NOT IN
            (SELECT sig FROM testable)), '') AS not_testable,
        coalesce((SELECT string_agg(sig, ';' ORDER BY sig) FROM det t WHERE t.scenario_id = s.scenario_id), '') AS detected,
        coalesce((SELECT string_agg(v, '; ' ORDER BY o, v) FROM (
            SELECT 0 AS o, t.sig || CASE WHEN d.sig IS NULL THEN ': MISS' ELSE ': MATCH' END AS v FROM testable t LEFT JOIN det d
                ON d.scenario_id = t.scenario_id AND d.sig = t.sig WHERE t.scenario_id = s.scenario_id
            UNION ALL SELECT 1, d.sig || ': UNEXPECTED' FROM det d WHERE d.scenario_id = s.scenario_id AND (d.scenario_id,
                d.sig) NOT IN (SELECT (scenario_id, sig) FROM testable))), 'none') AS verdict,
        (SELECT CAST(count(*) AS INTEGER) FROM testable t JOIN det d USING (scenario_id, sig) WHERE t.scenario_id =
            s.scenario_id) AS matched,
        CASE WHEN scenario_type = 'legitimate' THEN coalesce((SELECT string_agg(sig, ';' ORDER BY sig) FROM det d WHERE
            d.scenario_id = s.scenario_id AND (d.scenario_id, d.sig) NOT IN (SELECT (scenario_id, sig) FROM testable)), '')
            ELSE '' END AS unexpected_on_legitimate FROM scenarios s""",
}

_AUDIT = {
    **RULE_ROWS,
    "cited": """SELECT 'INSIDER.PRIVILEGE_CHANGE' AS rule_id, account_id, 'access_event' AS kind, event_id AS id, event_id
            || ':' || n AS key FROM pe
        UNION ALL SELECT 'INSIDER.PRIVILEGE_CHANGE', account_id, 'profile_change', change_id, event_id || ':' || n FROM pairs
        UNION ALL SELECT 'AML.CIRCULAR_TRANSFER', account_id, 'transaction', t.x, ids FROM rings,
            unnest(string_split(ids, ';')) AS t(x)
        UNION ALL SELECT 'AML.TRANSACTION_SPLITTING', w.from_account, 'transaction', m.transaction_id, w.transaction_id FROM split w JOIN
            (SELECT from_account, transaction_id, row_number() OVER (PARTITION BY from_account ORDER BY ts, transaction_id)
            AS rn FROM ledger) m ON m.from_account = w.from_account AND m.rn BETWEEN w.first_position AND w.last_position""",
    "known": "SELECT event_id AS id, 'access_event' AS kind FROM access_events UNION SELECT change_id, 'profile_change' FROM "
    "profile_changes UNION SELECT transaction_id, 'transaction' FROM injected",
    "truth": """SELECT scenario_id, 'access_event' AS kind, trim(t.x) AS id FROM scenarios,
            unnest(string_split(related_event_ids, ';')) AS t(x)
        UNION SELECT scenario_id, 'transaction', trim(t.x) FROM scenarios, unnest(string_split(related_transaction_ids, ','))
            AS t(x)
        UNION SELECT scenario_id, 'profile_change', change_id FROM scenario_accounts a JOIN (SELECT scenario_id, employee_id
            FROM scenarios) USING (scenario_id) JOIN profile_changes p ON p.customer_id = a.account_id AND
            p.changed_by_employee_id = employee_id""",
}


def _features(body):
    return sql(body, *FEATURE_RELATIONS, **FEATURES)


QUERIES = {
    "roc_auc": (
        roc_auc,
        sql("SELECT round(sum(pos * (nb + neg / 2.0::DOUBLE)) / any_value(p * n) + 1e-9, 6) AS roc_auc FROM x", **_RANKS),
    ),
    "average_precision": (
        average_precision,
        sql("SELECT round(sum(pos / p::DOUBLE * tp / (tp + fp)) + 1e-9, 6) AS average_precision FROM x", **_RANKS),
    ),
    "ranking_by_source": (
        ranking_by_source,
        sql(
            "SELECT g.source, auc AS roc_auc, CASE WHEN auc IS NOT NULL THEN ap END AS average_precision FROM (SELECT DISTINCT source "
            "FROM sc) g LEFT JOIN (SELECT a.source, round(avg(CASE WHEN a.score > b.score THEN 1.0::DOUBLE WHEN a.score = b.score "
            "THEN 0.5::DOUBLE ELSE 0 END) + 1e-9, 6) AS auc FROM sc a JOIN sc b ON b.source IS NOT DISTINCT FROM a.source "
            "AND a.label = 1 AND b.label = 0 GROUP BY 1) r ON r.source IS NOT DISTINCT FROM g.source LEFT JOIN "
            "(SELECT source, round(sum(pos / p * tp / (tp + fp)) + 1e-9, 6) AS ap FROM "
            "(SELECT source, pos, sum(pos) OVER (PARTITION BY source)::DOUBLE AS p, sum(pos) OVER w AS tp, sum(neg) OVER w AS "
            "fp FROM (SELECT source, score, sum(label) AS pos, count(*) - sum(label) AS neg FROM sc GROUP BY 1, 2) WINDOW w "
            "AS (PARTITION BY source ORDER BY score DESC)) GROUP BY 1) v ON v.source IS NOT DISTINCT FROM g.source",
            **SCORED,
        ),
    ),
    "cut_quality": (
        cut_quality,
        sql(
            f"SELECT {r6('precision', 'recall', 'f1', 'accuracy')} FROM (SELECT CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE "
            "0 END AS precision, tp / (tp + fn) AS recall, 2 * tp / (2 * tp + fp + fn) AS f1, (tp + tn) / (tp + fp + fn + tn) "
            "AS accuracy FROM (SELECT count(*) FILTER (label = 1 AND score >= 0.5)::DOUBLE AS tp, count(*) FILTER (label = 0 "
            "AND score >= 0.5) AS fp, count(*) FILTER (label = 1 AND score < 0.5) AS fn, count(*) FILTER (label = 0 AND score "
            "< 0.5) AS tn FROM sc))",
            **SCORED,
        ),
    ),
    "jackknife_errors": (jackknife_errors, _JACK.format(sc=SCORED["sc"])),
    "jackknife_of_measures": (
        jackknife_of_measures,
        sql(
            "SELECT measure, round(any_value(whole) + 1e-9, 6) AS value, round(sqrt((count(*) - 1) * var_pop(x)) + 1e-9, 6) AS "
            "standard_error FROM (SELECT i.account_id, 'specificity' AS measure, count(*) FILTER (j.label = 0 AND j.score < 0.5)::DOUBLE "
            "/ count(*) FILTER (j.label = 0) AS x, (SELECT count(*) FILTER (label = 0 AND score < 0.5)::DOUBLE / count(*) FILTER "
            "(label = 0) FROM sc) AS whole FROM sc i JOIN sc j ON i.account_id <> j.account_id GROUP BY 1 UNION ALL SELECT "
            "i.account_id, 'squared_error', avg((j.score - j.label) ** 2), (SELECT avg((score - label) ** 2) FROM sc) FROM sc i "
            "JOIN sc j ON i.account_id <> j.account_id GROUP BY 1) GROUP BY 1",
            **SCORED,
        ),
    ),
    "leave_one_out_means": (
        leave_one_out_means,
        sql(
            "SELECT i.account_id, round(avg(j.score) + 1e-9, 6) AS mean_of_others FROM sc i JOIN sc j ON i.account_id <> "
            "j.account_id GROUP BY 1",
            **SCORED,
        ),
    ),
    "score_distribution": (
        score_distribution,
        sql(
            f"SELECT label, n, {r6('mean', 'std', 'min', 'max', 'share_above', 'median')} FROM (SELECT label, count(*) AS n, "
            "avg(score) AS mean, stddev_samp(score) AS std, min(score) AS min, max(score) AS max, avg(CAST(score >= 0.5 AS "
            "INTEGER)) AS share_above, quantile_cont(score, 0.5) AS median FROM sc GROUP BY 1)",
            **SCORED,
        ),
    ),
    "background_threshold": (
        background_threshold,
        sql(
            f"SELECT {r6('threshold', 'median')} FROM (SELECT quantile_cont(score, 0.95) AS threshold, quantile_cont(score, 0.5) "
            "AS median FROM sc WHERE label = 0)",
            **SCORED,
        ),
    ),
    "feature_baselines": (
        feature_baselines,
        _features(
            f"SELECT feature, {r6('median', 'iqr')} FROM (SELECT feature, quantile_cont(value, 0.5) AS median, CASE WHEN "
            "quantile_cont(value, 0.75) = quantile_cont(value, 0.25) THEN 1 ELSE quantile_cont(value, 0.75) - "
            f"quantile_cont(value, 0.25) END AS iqr FROM ({_LONG}) GROUP BY 1)"
        ),
    ),
    "ranked_anomalies": (
        ranked_anomalies,
        sql(
            "SELECT account_id, label, round(score + 1e-9, 6) AS score, rank, score >= (SELECT quantile_cont(score, 0.95) FROM "
            "sc WHERE label = 0) AS above_threshold FROM (SELECT *, row_number() OVER (ORDER BY score DESC, account_id) AS rank "
            "FROM sc) WHERE rank <= 15",
            **SCORED,
        ),
    ),
    "top_features": (
        top_features,
        _features(
            "SELECT account_id, feature, value, rank FROM (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY "
            f"abs(value) DESC, feature) AS rank FROM (SELECT account_id, feature, {r6('value')} FROM ({_LONG}))) WHERE rank <= 4"
        ),
    ),
    "match_rates": (
        match_rates,
        sql(
            " UNION ALL ".join(
                _RATE.format(name=n, column=c, table=t)
                for n, c, t in (
                    ("access events", "account_id", "targets"), ("profile changes", "customer_id", "profile_changes"),
                    ("employee map", "customer_id", "emp_map"), ("customers", "customer_id", "customers"),
                )
            ),
            "targets", "profile_changes", "emp_map", "customers", "touch",
        ),
    ),
    "scenario_signals": (
        scenario_signals,
        sql("SELECT * FROM sigs", *RULE_RELATIONS, "scenario_accounts", recursive=True, **_SIGNAL_ROWS),
    ),
    "detection_summary": (
        detection_summary,
        sql(
            """SELECT matched, expected, round(matched::DOUBLE / expected + 1e-9, 6) AS true_positive_rate, false_alarms,
            legitimate, round(false_alarms::DOUBLE / legitimate + 1e-9, 6) AS false_positive_rate, unexpected_signals,
            (SELECT count(*) FROM results WHERE account_id NOT IN (SELECT account_id FROM scenario_accounts)) AS
            background_results FROM (SELECT CAST(sum(matched) FILTER (scenario_type = 'suspicious') AS BIGINT) AS matched,
            (SELECT count(*) FROM testable JOIN scenarios USING (scenario_id) WHERE scenario_type = 'suspicious') AS expected,
            count(*) FILTER (unexpected_on_legitimate <> '') AS false_alarms, count(*) FILTER (scenario_type = 'legitimate') AS
            legitimate, CAST(sum(CASE WHEN unexpected_on_legitimate = '' THEN 0 ELSE
            len(string_split(unexpected_on_legitimate, ';')) END) AS BIGINT) AS unexpected_signals FROM sigs)""",
            *RULE_RELATIONS, "scenario_accounts", recursive=True, **_SIGNAL_ROWS,
        ),
    ),
    "evidence_audit": (
        evidence_audit,
        sql(
            """SELECT scenario_id, rule_id, issue, CAST(sum(n) AS BIGINT) AS records FROM (SELECT a.scenario_id, c.rule_id,
            1 AS n, CASE WHEN k.id IS NULL THEN 'unknown_record' WHEN t.id IS NULL THEN 'outside_scenario' END AS issue
            FROM cited c JOIN scenario_accounts a USING (account_id) LEFT JOIN known k ON k.id = c.id AND k.kind = c.kind
            LEFT JOIN truth t ON t.scenario_id = a.scenario_id AND t.kind = c.kind AND t.id = c.id
            UNION ALL SELECT t.scenario_id, c.rule_id, 1, 'wrong_account' FROM cited c JOIN truth t ON t.kind = c.kind AND
            t.id = c.id WHERE (t.scenario_id, c.account_id) NOT IN (SELECT (scenario_id, account_id) FROM scenario_accounts)
            UNION ALL SELECT a.scenario_id, r.rule_id, r.record_count - coalesce(h.n, 0), 'absent_from_evidence' FROM results r
            JOIN scenario_accounts a USING (account_id) LEFT JOIN (SELECT rule_id, key, count(*) AS n FROM cited GROUP BY ALL) h
            ON h.rule_id = r.rule_id AND h.key = r.result_key WHERE r.record_count > coalesce(h.n, 0))
            WHERE issue IS NOT NULL GROUP BY ALL""",
            *RULE_RELATIONS, "scenario_accounts", "injected", recursive=True, **_AUDIT,
        ),
    ),
    "scenario_integrity": (
        scenario_integrity,
        sql(
            """SELECT scenario_id, scenario_type, CASE WHEN NOT has_transactional_consequence THEN CASE WHEN
            related_transaction_ids <> '' THEN 'payments without consequence' ELSE 'PASS' END
            WHEN related_transaction_ids = '' THEN 'no payments listed' WHEN p.found < p.listed THEN 'unresolved payments'
            WHEN scenario_type = 'suspicious' AND a.last_access IS NULL THEN 'no access events'
            WHEN scenario_type = 'suspicious' AND a.last_access >= p.first_payment THEN 'access after payment' ELSE 'PASS' END
            AS status FROM scenarios LEFT JOIN (SELECT scenarios.scenario_id, count(*) AS listed, count(i.ts) AS found, min(i.ts) AS
            first_payment FROM scenarios, unnest(string_split(related_transaction_ids, ',')) AS t(x) LEFT JOIN injected i ON
            i.transaction_id = t.x WHERE t.x <> '' GROUP BY 1) p USING (scenario_id) LEFT JOIN (SELECT scenarios.scenario_id,
            max(e.ts) AS last_access FROM scenarios, unnest(string_split(related_event_ids, ';')) AS t(x) JOIN access_events e ON
            e.event_id = t.x GROUP BY 1) a USING (scenario_id)""",
            "scenarios", "injected", "access_events",
        ),
    ),
}
