"""Exact deduplication by distributed MSD radix partitioning."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, scratch_path
from .common import SPACE, table

# Bytes of the first digit that every row is split by, after the length, and of the next digits,
# each so many times wider than the one before.
HEAD_BYTES = 24
FIRST_BYTES = 64
WIDER = 8
_SPACE_BYTES = SPACE.encode()


def _digits(with_rest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [(t or b"").translate(None, _SPACE_BYTES) for t in part.column(1).cast(pa.binary()).to_pylist()]
                columns = {"bytes": pa.array(map(len, texts), pa.int64()), "head": pa.array([t[:HEAD_BYTES] for t in texts], pa.binary())}
                if with_rest:
                    columns |= {
                        "doc_id": part.column(0),
                        "chars": pa.array([len(t or "") for t in part.column(1).to_pylist()], pa.int64()),
                        "text_sha256": pa.array([hashlib.sha256(t).hexdigest() for t in texts]),
                        "rest": pa.array([t[HEAD_BYTES:] for t in texts], pa.binary()),
                    }
                yield pa.RecordBatch.from_pydict(columns)

    return run


def digit_bounds(level: int) -> tuple[int, int]:
    """Where digit ``level`` of the rest of a text begins, and its width."""
    return FIRST_BYTES * (WIDER**level - 1) // (WIDER - 1), FIRST_BYTES * WIDER**level


def radix_groups(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` with their group: doc_id, chars, text_sha256, row_id, group_id.

    A text is its normalised bytes led by their number.  The first digit, length and head, splits all
    rows by counts alone; only groups of several rows take their bytes along.  These are then split
    by one digit per round, with group ids instead of prefixes, until every group has one row or has
    ended; the length is in the first digit, so the rows of a group end together.  Digits lie in a
    table by level, so each byte is read in its own round only.  ``group_id`` is null for rows that
    are alone.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    first = rows.mapInArrow(_digits(False), "bytes bigint, head binary").groupBy("bytes", "head")
    shared = first.agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("bytes", "head")
    shared = materialize(shared.withColumn("group", F.monotonically_increasing_id()), "radix-first")

    kind = "bytes bigint, head binary, doc_id bigint, chars bigint, text_sha256 string, rest binary"
    # A merge join at every size: each row moves once, and a hot digit is split over several tasks.
    split = rows.mapInArrow(_digits(True), kind).join(shared.hint("merge"), ["bytes", "head"], "left").select(
        "bytes", "doc_id", "chars", "text_sha256", "group", F.when(F.col("group").isNotNull(), F.col("rest")).alias("rest")
    )
    split = materialize(split.withColumn("row_id", F.monotonically_increasing_id()), "radix-rows")
    left = F.col("bytes") - HEAD_BYTES
    members = split.filter(F.col("group").isNotNull())
    ended = members.filter(left <= 0).select("row_id", "group")
    active = members.filter(left > 0).select("row_id", "group", left.alias("left"))

    longest = active.agg(F.max("left")).first()[0] or 0
    levels = 0
    while digit_bounds(levels)[0] < longest:
        levels += 1
    if levels:
        digits = F.array(*[F.struct(F.lit(i).alias("level"), F.substring("rest", digit_bounds(i)[0] + 1, digit_bounds(i)[1]).alias("digit")) for i in range(levels)])
        deep = members.filter(left > 0).select("row_id", F.explode(F.filter(digits, lambda d: F.octet_length(d["digit"]) > 0)).alias("d"))
        path = scratch_path(spark, "radix-digits")
        deep.select("row_id", "d.digit", "d.level").write.partitionBy("level").parquet(path)
        stored = spark.read.schema("row_id bigint, digit binary, level int").parquet(path)

    done = [ended]
    for level in range(levels):
        if level and active.isEmpty():
            break
        here = active.join(stored.filter(F.col("level") == level).select("row_id", "digit"), "row_id")
        here = materialize(here, "radix-level")
        parts = here.groupBy("group", "digit").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("group", "digit")
        parts = materialize(parts.withColumn("next", F.monotonically_increasing_id()), "radix-groups")
        found = here.join(parts, ["group", "digit"]).select("row_id", F.col("next").alias("group"), "left")
        found = materialize(found, "radix-split")
        end = sum(digit_bounds(level))
        done.append(found.filter(F.col("left") <= end).select("row_id", "group"))
        active = found.filter(F.col("left") > end)

    # Group numbers start anew on every level: the level tells them apart.
    groups = None
    for level, part in enumerate(done):
        named = part.select("row_id", F.struct(F.lit(level).alias("level"), F.col("group").alias("number")).alias("group_id"))
        groups = named if groups is None else groups.unionByName(named)
    return split.select("row_id", "doc_id", "chars", "text_sha256").join(groups, "row_id", "left")


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row, dropped ones too.

    Texts are equal if they are without all ASCII white space; null counts as empty.  Of a group the
    row with the most code points stays, then the one with the smallest id; a null id comes after all
    others.  Of repeated rows that tie in both one stays and all count.  An empty table gives no rows.
    """
    rows = materialize(radix_groups(docs), "exact-rows")
    alone = rows.filter(F.col("group_id").isNull()).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"), "text_sha256"
    )
    best = F.min(F.struct((-F.col("chars")).alias("chars"), F.col("doc_id").isNull().alias("none"), "doc_id", "row_id"))
    together = rows.filter(F.col("group_id").isNotNull()).select("row_id", "doc_id", "chars", "text_sha256", "group_id.*")
    kept = together.groupBy("level", "number").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size"))
    kept = materialize(kept, "exact-kept")
    joined = together.join(kept, ["level", "number"]).select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("row_id") == F.col("best.row_id")).alias("kept"), "text_sha256"
    )
    return alone.unionByName(joined)


def op1_exact_dedup(spark, folder):
    return dedup(table(spark, folder, "documents"))


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS k FROM documents
)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY k) AS group_size,
       row_number() OVER w = 1 AS kept, sha256(k) AS text_sha256
FROM d WINDOW w AS (PARTITION BY k ORDER BY chars DESC, doc_id)
"""
