"""Line deduplication with levelled sorted runs of line hashes."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize, scratch_path
from .common import SPACE, table

LEAST_CHARS = 20
LEAST_DOCUMENTS = 3
BATCHES = 4
# So many runs of one level are merged into one of the next.
FANOUT = 2
KEY = ["hi", "lo"]


def line_key(line: str) -> bytes | None:
    """128-bit hash of a line's key, None for keys that are too short to count."""
    key = line.strip(SPACE)
    if len(key) < LEAST_CHARS:
        return None
    # bytes.lower changes A-Z alone.
    return hashlib.blake2b(key.encode("utf-8", "surrogatepass").lower(), digest_size=16).digest()


def _hash_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            counts, found = [], []
            for text in part.column(1).to_pylist():
                keys = {k for k in map(line_key, (text or "").split("\n")) if k}
                counts.append(len(keys))
                found.extend(keys)
            rows = pa.array(np.repeat(np.arange(len(counts)), counts))
            pairs = np.frombuffer(b"".join(found), ">i8").astype("i8").reshape(-1, 2)
            columns = [part.column(0).take(rows), pa.array(pairs[:, 0]), pa.array(pairs[:, 1])]
            yield pa.record_batch(columns, names=["doc_id", "hi", "lo"])


class LineRuns:
    """Sorted runs of line hashes in levels, as bucketed tables in the scratch folder.

    A run has one row per key: the hash, the largest document id that held it when it was first seen,
    and in how many documents of that batch it was.  All runs have the same buckets and are sorted in
    them, so a new batch is shuffled once and merge-joined with every run where it lies.
    """

    def __init__(self, spark: SparkSession, fanout: int = FANOUT, buckets: int | None = None):
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: dict[int, list[str]] = {}

    def _write(self, rows: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        path = scratch_path(self.spark, "line-run")
        dealt = rows.repartition(self.buckets, *KEY)
        dealt.write.format("parquet").option("path", path).bucketBy(self.buckets, *KEY).sortBy(*KEY).saveAsTable(name)
        return name

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(n) for level in sorted(self.levels) for n in self.levels[level]]

    def fresh(self, keys: DataFrame) -> DataFrame:
        """The rows of ``keys`` whose hash is in no run."""
        for run in self.runs():
            keys = keys.join(run.select(*KEY).hint("merge"), KEY, "left_anti")
        return keys

    def seen(self, keys: DataFrame) -> DataFrame:
        """The rows of ``keys`` whose hash is in a run; a hash is in one run at most."""
        found = None
        for run in self.runs():
            part = keys.join(run.select(*KEY).hint("merge"), KEY, "left_semi")
            found = part if found is None else found.unionByName(part)
        return keys.limit(0) if found is None else found

    def add(self, rows: DataFrame) -> None:
        """Add a run of new keys and merge full levels upward."""
        level = 0
        self.levels.setdefault(0, []).append(self._write(rows))
        while len(self.levels[level]) >= self.fanout:
            merged = self.levels.pop(level)
            union = None
            for name in merged:
                run = self.spark.table(name)
                union = run if union is None else union.unionByName(run)
            level += 1
            self.levels.setdefault(level, []).append(self._write(union))
            for name in merged:
                self.spark.sql(f"DROP TABLE {name}")

    def drop(self) -> None:
        for names in self.levels.values():
            for name in names:
                self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.levels = {}


def repeated_lines(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, batches: int = BATCHES, fanout: int = FANOUT):
    """``(lines, repeated)``: one row per document and line key, and the keys held by enough documents.

    Documents go in batches from the largest ids down, so the batch that first holds a key has the
    document whose lines stay (``owner``).  Each batch keeps the keys that no run holds as its own
    run; how many of its documents hold older keys is counted beside the runs.  A null id counts as
    one document below all others.
    """
    spark = docs.sparkSession
    lowest = F.lit(-(2**63)).cast("bigint")
    rows = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), lowest).alias("doc_id"), F.col("text").cast("string"))
    lines = rows.mapInArrow(_hash_lines, "doc_id bigint, hi bigint, lo bigint")
    ids = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"))
    shares = [1 - i / batches for i in range(1, batches)]
    cuts = ids.approxQuantile("doc_id", shares, 0.01) if shares else []
    batch = F.lit(0)
    for cut in cuts:
        batch = batch + F.when(F.col("doc_id") <= F.lit(int(cut)), 1).otherwise(0)
    path = scratch_path(spark, "line-keys")
    lines.withColumn("batch", batch).write.partitionBy("batch").parquet(path)
    schema = T.StructType([*lines.schema.fields, T.StructField("batch", T.IntegerType())])
    lines = spark.read.schema(schema).parquet(path)

    runs, again = LineRuns(spark, fanout), []
    for number in range(len(cuts) + 1):
        mine = lines.filter(F.col("batch") == number).select("doc_id", *KEY)
        # Ids may repeat among rows, and documents are counted, not rows.
        keys = mine.distinct().groupBy(*KEY).agg(F.max("doc_id").alias("owner"), F.count(F.lit(1)).alias("documents"))
        keys = materialize(keys, "line-batch")
        if number:
            again.append(materialize(runs.seen(keys).select(*KEY, "documents"), "line-again"))
        runs.add(runs.fresh(keys))
    counted = None
    for run in runs.runs():
        counted = run if counted is None else counted.unionByName(run)
    none = F.lit(None).cast("bigint")
    for part in again:
        counted = counted.unionByName(part.select(*KEY, none.alias("owner"), "documents"))
    total = counted.groupBy(*KEY).agg(F.max("owner").alias("owner"), F.sum("documents").alias("documents"))
    repeated = materialize(total.filter(F.col("documents") >= least_documents).select(*KEY, "owner"), "line-repeated")
    runs.drop()
    return lines, repeated


def drop_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, text, keys to drop) to (row, text without their lines, lines before, lines dropped)."""
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            texts, before, gone = [], [], []
            for text, drop in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                lines = (text or "").split("\n")
                kept = lines
                if drop:
                    keys = {k["hi"].to_bytes(8, "big", signed=True) + k["lo"].to_bytes(8, "big", signed=True) for k in drop}
                    kept = [x for x in lines if line_key(x) not in keys]
                texts.append("\n".join(kept))
                before.append(len(lines))
                gone.append(len(lines) - len(kept))
            columns = [part.column(0), pa.array(texts, pa.string()), pa.array(before, pa.int64()), pa.array(gone, pa.int64())]
            yield pa.record_batch(columns, names=["row", "kept_text", "n_lines", "n_dropped"])


def dedup_lines(docs: DataFrame, **settings) -> DataFrame:
    """``row`` (a struct of all columns), ``kept_text``, ``n_lines`` and ``n_dropped`` of every row.

    A line's key is the line without white space at its ends and with A-Z lower-cased.  Keys of at
    least LEAST_CHARS code points in at least ``least_documents`` documents lose all their lines but
    those of the largest document id that holds them.  Null text counts as empty: one empty line.
    Rows with one id are one document for the count and lose the same lines; null ids are one
    document below all others.  A document can lose every line: its text is then empty.
    """
    lines, repeated = repeated_lines(docs, **settings)
    lowest = F.lit(-(2**63)).cast("bigint")
    keys = [F.col("l.hi") == F.col("r.hi"), F.col("l.lo") == F.col("r.lo"), F.col("l.doc_id") != F.col("r.owner")]
    lost = lines.alias("l").join(repeated.alias("r"), keys).select("l.doc_id", "l.hi", "l.lo")
    # Bounded by the lines of one document.
    lost = lost.groupBy("doc_id").agg(F.collect_set(F.struct("hi", "lo")).alias("drop"))
    lost = materialize(lost, "line-lost").select(F.col("doc_id").alias("_id"), "drop")
    packed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col("text").cast("string").alias("text"),
        F.coalesce(F.col("doc_id").cast("bigint"), lowest).alias("_key"),
    )
    # A merge join at every size: each text moves once.
    joined = packed.join(lost.hint("merge"), F.col("_key") == F.col("_id"), "left").select("row", "text", "drop")
    schema = T.StructType(
        [
            packed.schema["row"], T.StructField("kept_text", T.StringType()), T.StructField("n_lines", T.LongType()),
            T.StructField("n_dropped", T.LongType()),
        ]
    )
    return joined.mapInArrow(drop_lines, schema)


def without_repeated_lines(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` with the repeated lines gone; ``n_chars``, where there is one, follows the text.

    Documents that lose nothing keep their text as it is, null included.
    """
    changed = F.col("n_dropped") > 0
    new = {"text": F.col("kept_text"), "n_chars": F.length("kept_text")}
    fields = [
        F.when(changed, new[c]).otherwise(F.col(f"row.`{c}`")).cast(docs.schema[c].dataType).alias(c)
        if c in new
        else F.col(f"row.`{c}`").alias(c)
        for c in docs.columns
    ]
    return dedup_lines(docs, **settings).select(*fields)


def op9_line_dedup(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return dedup_lines(docs).select(
        F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256")
    )


OP9_SQL = r"""
WITH l AS (
  SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents)
), r AS (
  SELECT k, max(doc_id) AS owner FROM l WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
)
SELECT l.doc_id, count(*) AS n_lines, count(*) FILTER (r.k IS NOT NULL) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (r.k IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN r ON l.k = r.k AND l.doc_id <> r.owner GROUP BY l.doc_id
"""
