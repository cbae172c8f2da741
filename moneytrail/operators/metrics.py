"""Evaluation measures as distributed aggregates."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .skew import HOT_ROWS, positions, quantiles, running


def _with_totals(df: DataFrame, totals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Attach per-key totals; without keys they are scalar subqueries."""
    if keys:
        return df.join(totals, list(keys))
    return df.withColumns({c: totals.select(c).scalar() for c in totals.columns})


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def ranking_table(df: DataFrame, label: str, score: str, keys: Sequence[str] = (), limit: int = HOT_ROWS) -> DataFrame:
    """One row per distinct score: positives, negatives, and how many lie at or below it."""
    keys = list(keys)
    positive = (F.col(label) == 1).cast("bigint")
    counted = df.groupBy(*keys, F.col(score).alias("score")).agg(
        F.sum(positive).alias("pos"), F.sum(1 - positive).alias("neg")
    )
    counted = materialize(counted, "scores")
    through = running(
        counted, keys, [F.col("score")],
        {"pos_through": ("sum", F.col("pos")), "neg_through": ("sum", F.col("neg"))}, limit=limit,
    )
    totals = counted.groupBy(*keys).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    return _with_totals(through, totals, keys)


def _standing() -> dict[str, Column]:
    """How a score row of the ranking table counts towards the measures."""
    c = F.col
    return {
        # negatives below a positive, and positives above a negative; ties count half
        "below": c("neg_through") - c("neg") + c("neg") / 2,
        "above": c("P") - c("pos_through") + c("pos") / 2,
        "tp": c("P") - c("pos_through") + c("pos"),
        "fp": c("N") - c("neg_through") + c("neg"),
    }


def ranking_quality(ranked: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """ROC-AUC (ties count half) and average precision; null where one of the two classes is absent."""
    at = _standing()
    both = (F.max("P") > 0) & (F.max("N") > 0)
    pairs = F.nullif(F.max("P") * F.max("N"), F.lit(0))
    precision = at["tp"] / F.nullif(at["tp"] + at["fp"], F.lit(0))
    return ranked.groupBy(*keys).agg(
        (F.sum(F.col("pos") * at["below"]) / pairs).alias("roc_auc"),
        F.when(both, F.sum(F.col("pos") / F.nullif(F.col("P"), F.lit(0)) * precision)).alias("average_precision"),
    )


def _measures(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    precision, recall = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    return {
        "precision": precision,
        "recall": recall,
        "f1": _ratio(2 * tp, 2 * tp + fp + fn),
        "accuracy": _ratio(tp + tn, tp + fp + fn + tn),
    }


def confusion(df: DataFrame, label: str, score: str, cut: float = 0.5, keys: Sequence[str] = ()) -> DataFrame:
    actual, said = F.col(label) == 1, F.col(score) >= cut
    return df.groupBy(*keys).agg(
        F.count_if(actual & said).alias("tp"),
        F.count_if(~actual & said).alias("fp"),
        F.count_if(actual & ~said).alias("fn"),
        F.count_if(~actual & ~said).alias("tn"),
    )


def cut_quality(df: DataFrame, label: str, score: str, cut: float = 0.5, keys: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1 and accuracy at a cut; precision is 0 when nothing is predicted."""
    counts = confusion(df, label, score, cut, keys)
    values = _measures(*[F.col(c) for c in ("tp", "fp", "fn", "tn")])
    return counts.select(*keys, *[v.alias(n) for n, v in values.items()])


def jackknife(df: DataFrame, label: str, score: str, cut: float = 0.5, keys: Sequence[str] = ()) -> DataFrame:
    """Leave-one-out standard error of every measure.

    No row is compared with all the others.  Leaving a row out changes the AUC by the pairs it won,
    which its rank tells; the other measures change by which of four outcomes the row had.
    """
    keys, at = list(keys), _standing()
    ranked = ranking_table(df, label, score, keys)
    wins = ranked.groupBy(*keys).agg(F.sum(F.col("pos") * at["below"]).alias("U"))
    each = _with_totals(ranked, wins, keys)
    without_pos = (F.col("U") - at["below"]) / ((F.col("P") - 1) * F.col("N"))
    without_neg = (F.col("U") - at["above"]) / (F.col("P") * (F.col("N") - 1))
    auc = each.select(
        *keys,
        F.explode(
            F.array(
                F.struct(F.col("pos").alias("w"), F.when(F.col("P") > 1, without_pos).alias("x")),
                F.struct(F.col("neg").alias("w"), F.when(F.col("N") > 1, without_neg).alias("x")),
            )
        ).alias("o"),
    ).select(*keys, F.lit("roc_auc").alias("measure"), "o.w", "o.x")

    counts = confusion(df, label, score, cut, keys)
    names = ("tp", "fp", "fn", "tn")
    outcomes = []
    for left_out in names:
        parts = {n: F.col(n) - (1 if n == left_out else 0) for n in names}
        for measure, value in _measures(*[parts[n] for n in names]).items():
            outcomes.append(F.struct(F.lit(measure).alias("measure"), F.col(left_out).alias("w"), value.alias("x")))
    others = counts.select(*keys, F.explode(F.array(*outcomes)).alias("o")).select(*keys, "o.measure", "o.w", "o.x")

    rows = auc.unionByName(others).filter("w > 0")
    by = [*keys, "measure"]
    means = rows.groupBy(*by).agg(F.sum("w").alias("n"), (F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("m"))
    spread = rows.join(means, by).groupBy(*by).agg(
        F.sqrt(
            (F.max("n") - 1) * F.sum(F.col("w") * (F.col("x") - F.col("m")) * (F.col("x") - F.col("m"))) / F.max("n")
        ).alias("standard_error")
    )
    return spread


@dataclass(frozen=True)
class SumMeasure:
    """A measure that follows from sums over rows: ``parts`` are what a row adds, ``finish`` makes the value of the sums."""

    parts: Mapping[str, Column]
    finish: Callable[[Mapping[str, Column]], Column]


def jackknife_of(df: DataFrame, measures: Mapping[str, SumMeasure]) -> DataFrame:
    """(measure, value, standard_error) of any measures of sums, without working them out once per row.

    Leaving a row out takes its parts off the sums, so all values come from one more pass over the rows.
    Null parts add nothing; rows for which a measure has no value are left out of its error.
    """
    parts = {f"{m}:{p}": F.coalesce(c.cast("double"), F.lit(0.0)) for m, own in measures.items() for p, c in own.parts.items()}
    rows = materialize(df.select(*[c.alias(n) for n, c in parts.items()]), "parts")
    sums = rows.agg(*[F.sum(f"`{n}`").alias(n) for n in parts])
    sums = materialize(sums, "sums")  # one row
    total = {n: sums.select(f"`{n}`").scalar() for n in parts}
    values, found = [], []
    for name, measure in measures.items():
        whole = {p: total[f"{name}:{p}"] for p in measure.parts}
        without = {p: total[f"{name}:{p}"] - F.col(f"`{name}:{p}`") for p in measure.parts}
        values.append(measure.finish(without).alias(name))
        found.append((name, measure.finish(whole)))
    errors = rows.select(*values).agg(
        *[F.sqrt((F.count(f"`{n}`") - 1) * F.var_pop(f"`{n}`")).alias(n) for n in measures]
    )
    pairs = F.explode(F.array(*[
        F.struct(F.lit(n).alias("measure"), value.alias("value"), F.col(f"`{n}`").alias("standard_error")) for n, value in found
    ]))
    return errors.select(pairs.alias("p")).select("p.*")


def leave_one_out_means(df: DataFrame, value: str) -> DataFrame:
    """Mean of all other rows: total minus own."""
    totals = df.agg(F.sum(value).alias("t"), F.count(value).alias("n"))
    total, n = totals.select("t").scalar(), totals.select("n").scalar()
    return df.withColumn("mean_of_others", (total - F.col(value)) / (n - 1))


def score_distribution(df: DataFrame, group: str, score: str, cut: float) -> DataFrame:
    """Mean, sample deviation, median, extremes and share at or above the cut."""
    stats = df.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(score).alias("mean"),
        F.stddev_samp(score).alias("std"),
        F.min(score).alias("min"),
        F.max(score).alias("max"),
        F.avg((F.col(score) >= cut).cast("double")).alias("share_above"),
    )
    middle = quantiles(df, score, [0.5], [group]).withColumnRenamed("q0", "median")
    return stats.join(middle, group)


def long_features(matrix: DataFrame, names: Sequence[str]) -> DataFrame:
    """(account_id, feature, value)."""
    pairs = [F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("value")) for n in names]
    return matrix.select("account_id", F.explode(F.array(*pairs)).alias("p")).select("account_id", "p.*")


def feature_baselines(matrix: DataFrame, names: Sequence[str]) -> DataFrame:
    """(feature, median, iqr): the middle and the spread of each feature; no spread counts as 1."""
    q = quantiles(long_features(matrix, names), "value", [0.25, 0.5, 0.75], ["feature"])
    iqr = F.col("q2") - F.col("q0")
    return q.select("feature", F.col("q1").alias("median"), F.when(iqr == 0, 1.0).otherwise(iqr).alias("iqr"))


def ranked_anomalies(df: DataFrame, score: str, threshold: float | Column, keep: int | None = 15) -> DataFrame:
    """Rank by falling score (ties by account); ``keep=None`` keeps all."""
    order = [F.col(score).desc(), F.col("account_id")]
    if keep is not None:
        df = df.orderBy(*order).limit(keep)  # a top-k: no more rows than asked for are ranked
        ranked = df.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("bigint"))
    else:
        ranked = positions(df, [], order, "rank")
    return ranked.withColumn("above_threshold", F.col(score) >= threshold)


def top_per_account(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """The first ``k`` rows of every account.  The rank filter is applied before the shuffle too."""
    w = Window.partitionBy("account_id").orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
