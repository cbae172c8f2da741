"""Mixing sources to target weights: random order by hash, prefix sums per source, exact budgets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import WORD_PATTERN, key_of, prefix_sums, table, word_count

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CEILING = 2
SEED = "mix"


def source_targets(
    sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, ceiling: int = CEILING
) -> DataFrame:
    """(source_key, source_size, target) from one row per source with its key and size.

    Sources by key take the weights in turn and share ``share`` times all words; no target exceeds
    ``ceiling`` times its source, the excess goes to the others by weight.  With ``share`` at or above
    ``ceiling`` every source has its ceiling as target.  In order of ceiling / weight the sources that hit their ceiling come first, so one pass of prefix sums finds
    the level at which the budget is used up.
    """
    sizes = sizes.withColumn("one", F.lit(1).cast("bigint"))
    ranked = prefix_sums(sizes, [], ["source_key"], {"rank": "one"}, "ranks")
    choices = F.array(*[F.lit(int(w)).cast("bigint") for w in weights])
    ranked = ranked.withColumn("weight", F.element_at(choices, (F.col("rank") % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("top", F.col("source_size") * ceiling).withColumn("level", F.col("top") / F.col("weight"))
    ranked = prefix_sums(ranked, [], ["level", "source_key"], {"tops": "top", "weights": "weight"}, "levels")
    ranked = materialize(ranked, "levels-done")
    totals = ranked.agg(
        (F.sum("source_size") * F.lit(float(share))).alias("budget"), F.sum("weight").alias("all_weights")
    )
    own = (totals.select("budget").scalar() - F.col("tops")) / (totals.select("all_weights").scalar() - F.col("weights"))
    ranked = materialize(ranked.withColumn("full", F.col("weight") * own > F.col("top")), "full")
    open_weights = F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight")))
    open_words = F.sum("source_size") * F.lit(float(share)) - F.sum(F.when(F.col("full"), F.col("top")).otherwise(0))
    left = ranked.agg(F.when(open_weights > 0, open_words / open_weights).alias("unit"))
    target = F.when(F.col("full"), F.col("top").cast("double")).otherwise(F.col("weight") * left.scalar())
    return materialize(ranked.select("source_key", "source_size", target.alias("target")), "targets")


def mix(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    share: float = SHARE,
    ceiling: int = CEILING,
    seed: str = SEED,
) -> DataFrame:
    """How many words the mix takes of every document.

    Returns doc_id, source_key, size, source_size, target and taken, one row per input row.  Each
    source is put in the order of a hash of the document ids.  Its budget, the rounded target, takes
    whole epochs first; the rest is cut exactly at its prefix sum, so at most one document of a
    source is taken in part.

    Null text has size 0 and is taken 0 times.  Null source is a source of its own, ordered last.
    Null ids hash like empty text.  Repeated rows count each time; they tie in the order, and only
    equal rows may swap.  An empty table gives no rows.
    """
    rows = docs.select("doc_id", key_of(F.col("source")).alias("source_key"), word_count(F.col("text")).alias("size"))
    mark = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    rows = materialize(rows.withColumn("mark", mark), "sizes")
    sizes = rows.groupBy("source_key").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes, weights, share, ceiling)
    placed = prefix_sums(rows, ["source_key"], ["mark", "doc_id", "size"], {"before": "size"}, "mix")
    budget = F.floor(F.col("target") + 0.5)
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    rest = budget - whole * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before")))
    taken = (whole * F.col("size") + part).cast("bigint")
    # One row per source; Spark broadcasts it only while it is small.
    return placed.join(targets, "source_key").select(
        "doc_id", "source_key", "size", "source_size", "target", taken.alias("taken")
    )


def mixed_documents(docs: DataFrame, **settings) -> DataFrame:
    """The mixed corpus: each document as often as it is taken, the last time cut after whole words.

    Keeps the columns of ``docs``; ``n_chars``, where there is one, follows the text.  A document
    that is not taken goes; one taken in part loses the words after its budget and keeps the white
    space between the others.  Rows with the same id, source and size get one of the decisions made
    for them each: the first ones one epoch more, the next one the words up to the cut.
    """
    names = docs.columns
    packed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"),
        "doc_id",
        key_of(F.col("source")).alias("source_key"),
        word_count(F.col("text")).alias("size"),
    )
    decided = (
        mix(docs, **settings)
        .groupBy("doc_id", "source_key", "size")
        .agg(F.sum("taken").alias("taken"), F.count(F.lit(1)).alias("rows"))
    )
    decided = materialize(decided, "decided")
    # Words beyond the epochs that all equal rows get.  The cut of a source goes through one group of
    # equal rows at most, so groups of several rows with such words are no more than the sources.
    extra = F.when(F.col("size") > 0, F.expr("taken % (rows * size)")).otherwise(0)
    cut = (F.col("rows") > 1) & (extra > 0)
    zero = F.lit(0).cast("bigint")

    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("source_key") == F.col("s")) & (F.col("size") == F.col("z"))
    plain, parted = (
        decided.filter(kind).select(
            F.col("doc_id").alias("d"), F.col("source_key").alias("s"), F.col("size").alias("z"), "taken", "rows"
        )
        for kind in (~cut, cut)
    )
    joined = packed.join(plain.hint("merge"), same).withColumn("number", zero)  # at every size, so each text moves once
    if not parted.isEmpty():
        pieces = materialize(packed.join(parted, same).withColumn("row_id", F.monotonically_increasing_id()), "parted")
        ids = pieces.select("s", "z", key_of(F.col("d")).alias("k"), "row_id", F.lit(1).cast("bigint").alias("one"))
        numbers = prefix_sums(ids, ["s", "z", "k"], ["row_id"], {"number": "one"}, "numbers").select("row_id", "number")
        joined = joined.unionByName(pieces.join(numbers.hint("merge"), "row_id").drop("row_id"))
    epochs = F.when(F.col("size") > 0, F.expr("taken div (rows * size)")).otherwise(zero)
    share = F.greatest(zero, F.least(F.col("size"), extra - F.col("number") * F.col("size")))
    copies = epochs + F.when((F.col("size") > 0) & (share == F.col("size")), 1).otherwise(0)
    part = F.when(share < F.col("size"), share).otherwise(zero)
    spread = joined.select(
        "row",
        "size",
        F.explode(
            F.concat(
                F.array_repeat(F.col("size"), copies.cast("int")),
                F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<bigint>")),
            )
        ).alias("words"),
    )
    words = F.regexp_extract_all(F.col("row.text"), F.lit(rf"[\x20\x09-\x0D]*{WORD_PATTERN}"), F.lit(0))
    text = F.when(F.col("words") == F.col("size"), F.col("row.text")).otherwise(
        F.array_join(F.slice(words, F.lit(1), F.col("words").cast("int")), "")
    )
    fields = []
    for c in names:
        if c == "text":
            fields.append(F.col("cut").alias(c))
        elif c == "n_chars":
            whole = F.col("words") == F.col("size")
            fields.append(F.when(whole, F.col(f"row.`{c}`")).otherwise(F.length("cut")).alias(c))
        else:
            fields.append(F.col(f"row.`{c}`").alias(c))
    return spread.withColumn("cut", text).select(*fields)


def op3_mixing(spark, folder):
    mixed = mix(table(spark, folder, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS size
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) + 1] AS weight
  FROM d GROUP BY source
), l AS (
  SELECT *, 2 * source_size AS top,
         coalesce(sum(2 * source_size) OVER w, 0) AS tops, coalesce(sum(weight) OVER w, 0) AS weights,
         sum(source_size) OVER () * 1.5::DOUBLE AS budget, sum(weight) OVER () AS all_weights
  FROM s WINDOW w AS (ORDER BY (2 * source_size) / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), f AS (
  SELECT *, weight * ((budget - tops) / (all_weights - weights)) > top AS is_full FROM l
), u AS (
  SELECT (max(budget) - sum(CASE WHEN is_full THEN top ELSE 0 END)) / sum(CASE WHEN is_full THEN 0 ELSE weight END) AS unit FROM f
), t AS (
  SELECT source, source_size, CASE WHEN is_full THEN top::DOUBLE ELSE weight * unit END AS target FROM f, u
), p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CAST(floor(t.target + 0.5) AS BIGINT) AS budget,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5('mix:' || coalesce(d.doc_id::VARCHAR, '')), d.doc_id, d.size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(CASE WHEN source_size = 0 THEN 0 ELSE
         (budget // source_size) * size + greatest(0, least(size, budget % source_size - before)) END AS BIGINT) AS taken
FROM p
"""
