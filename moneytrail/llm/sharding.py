"""Sharding by a consistent-hash ring with virtual nodes and bounded loads."""

from __future__ import annotations

import bisect
import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prefix_sums, table

SHARDS = 16
VIRTUAL_NODES = 128
# The ring is cut into 2**RING_BITS cells; the plan holds one row per cell and cut, whatever the data.
RING_BITS = 14


def ring_nodes(shards: int, virtual_nodes: int = VIRTUAL_NODES, bits: int = RING_BITS) -> list[tuple[int, int]]:
    """(cell, shard) of every virtual node, clockwise.  A shard's nodes do not depend on the others."""
    nodes = []
    for shard in range(shards):
        for copy in range(virtual_nodes):
            digest = hashlib.blake2b(f"{shard}/{copy}".encode(), digest_size=8).digest()
            nodes.append((int.from_bytes(digest, "big") >> (64 - bits), shard))
    return sorted(nodes)


def ring_plan(
    counts: dict[int, int], shards: int, virtual_nodes: int = VIRTUAL_NODES, bits: int = RING_BITS
) -> list[tuple[int, int, int, int, int]]:
    """Pieces (cell, first, end, shard, slot of the first) that put every row of every cell somewhere.

    Each cell first goes to the shard of its next node clockwise, up to the shard's capacity; what
    does not fit continues clockwise to the next node whose shard has room.  Capacities add up to
    the number of rows and are at most one apart, so every shard ends exactly full.
    """
    total = sum(counts.values())
    room = [total // shards + (shard < total % shards) for shard in range(shards)]
    nodes = ring_nodes(shards, virtual_nodes, bits)
    cells = [cell for cell, _ in nodes]
    pieces: list[tuple[int, int, int, int]] = []
    over: list[tuple[int, int, int, int]] = []
    for cell in sorted(counts):
        at = bisect.bisect_left(cells, cell) % len(nodes)
        home = nodes[at][1]
        fits = min(counts[cell], room[home])
        if fits:
            room[home] -= fits
            pieces.append((cell, 0, fits, home))
        if fits < counts[cell]:
            over.append((cell, fits, counts[cell], at))
    for cell, first, end, at in over:
        while first < end:
            at = (at + 1) % len(nodes)
            shard = nodes[at][1]
            fits = min(end - first, room[shard])
            if fits:
                room[shard] -= fits
                pieces.append((cell, first, first + fits, shard))
                first += fits
    used = [0] * shards
    planned = []
    for cell, first, end, shard in sorted(pieces):
        planned.append((cell, first, end, shard, used[shard]))
        used[shard] += end - first
    return planned


def shard_rows(
    rows: DataFrame, position: Column, order: list[str], shards: int = SHARDS,
    virtual_nodes: int = VIRTUAL_NODES, bits: int = RING_BITS,
) -> DataFrame:
    """``rows`` with ``shard`` and ``slot``; ``position`` is a 64-bit hash, its top bits name a ring cell.

    Rows with one hash sit together on the ring and part only where a shard is full.  The order
    inside a cell comes from prefix sums over range slices; the plan is made from one count per cell
    (at most 2**bits numbers) and comes back as a literal, so it may be broadcast.
    """
    spark = rows.sparkSession
    placed = rows.withColumn("position", position).withColumn(
        "cell", F.shiftrightunsigned("position", 64 - bits).cast("int")
    )
    placed = placed.withColumn("one", F.lit(1).cast("bigint"))
    placed = prefix_sums(placed, ["cell"], ["position", *order], {"index": "one"}, "ring")
    counts = {r["cell"]: r["rows"] for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("rows")).collect()}
    plan = ring_plan(counts, shards, virtual_nodes, bits)
    kind = "array<struct<cell:int,first:bigint,end:bigint,shard:int,base:bigint>>"
    names = ("cell", "first", "end", "shard", "base")
    text = json.dumps([dict(zip(names, piece, strict=True)) for piece in plan])
    pieces = spark.range(1).select(F.inline(F.from_json(F.lit(text), kind)))
    inside = (F.col("index") >= F.col("first")) & (F.col("index") < F.col("end"))
    joined = placed.join(F.broadcast(pieces.withColumnRenamed("cell", "_cell")), (F.col("cell") == F.col("_cell")) & inside)
    return joined.select(*rows.columns, "shard", (F.col("base") + F.col("index") - F.col("first")).alias("slot"))


def shard_documents(docs: DataFrame, shards: int = SHARDS, **settings) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard for every document.

    The law is ``rows``: row counts of shards differ by one at most.  The ring position is a hash of
    the text, so equal texts share a shard unless it is full.  ``grown_shard`` is null, as it belongs
    to another law.  Null text counts as empty: size 1.  Null ids sort first; repeated rows are
    placed one by one.  An empty table gives no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("text_hash"),
    )
    found = shard_rows(rows, F.col("text_hash"), ["doc_id", "size", "text_crc32"], shards, **settings)
    return found.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op8_sharding(spark, folder):
    return shard_documents(table(spark, folder, "documents"))
