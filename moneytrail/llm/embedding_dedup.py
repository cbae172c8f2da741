"""Embedding near-dedup: sorted projection passes with bounded neighbour windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph_search import connected_components
from ..session import materialize
from .common import partitions, table

THRESHOLD = 0.98
PASSES = 24
WINDOW = 64
# One-bit hashes that are concatenated to a sort key.
BITS = 64
SEED = 5
# Passes go on in a label until this part of its probes, pairs right at the threshold, is found.
RECALL = 0.99
PROBES = 512


def usable(vector) -> F.Column:
    """Not null, not zero, and without null or non-finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    """Unit vectors in double precision; all rows have one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype("f8")
    rows = flat.reshape(len(column), -1)
    rows = rows / np.abs(rows).max(1, keepdims=True)  # keeps the squares of very large or small ones in range
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


def _centres(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the unit vectors of each label and length in a batch."""
    for batch in batches:
        groups: dict[tuple[int, int], list[int]] = {}
        for i, key in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
            groups.setdefault(key, []).append(i)
        if groups:
            sums = [_matrix(batch.column(2).take(pa.array(rows))).sum(0).tolist() for rows in groups.values()]
            labels, sizes = zip(*groups, strict=True)
            columns = [pa.array(labels, pa.int64()), pa.array(sizes, pa.int32()), pa.array(sums, pa.list_(pa.float64()))]
            yield pa.record_batch(columns, names=["label", "size", "total"])


def _probes(threshold: float, seed: int):
    """A vector right above the threshold for each row, in a random direction, with the id -1 - vec_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cosine = min(1.0, threshold + 1e-6)
        for batch in batches:
            ids, sizes = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            made = []
            for i in range(batch.num_rows):
                unit = _matrix(batch.column(3).slice(i, 1))[0]
                aside = np.random.default_rng([seed, int(ids[i])]).normal(size=sizes[i])
                aside -= unit * (aside @ unit)
                length = np.sqrt(aside @ aside)
                made.append((cosine * unit + (np.sqrt(1 - cosine * cosine) / length * aside if length > 0 else 0)).tolist())
            columns = [pa.array(-1 - ids), batch.column(1), batch.column(2), pa.array(made, pa.list_(pa.float64()))]
            yield pa.record_batch(columns, names=["vec_id", "label", "size", "vector"])

    return run


def _sort_keys(numbers: range, bits: int, seed: int):
    """Each vector once per pass with the key of the pass: the signs of random projections from its label's centre."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                sizes = part.column(2).to_numpy()
                for size in np.unique(sizes).tolist():
                    mine = part.take(pa.array(np.flatnonzero(sizes == size)))
                    n = mine.num_rows
                    aside = _matrix(mine.column(3)) - mine.column(4).flatten().to_numpy().reshape(n, -1)
                    for number in numbers:
                        if (number, size) not in planes:
                            planes[number, size] = np.random.default_rng([seed, number, size]).normal(size=(size, bits))
                        keys = np.packbits(aside @ planes[number, size] > 0, axis=1)
                        columns = [
                            pa.array(np.full(n, number, "i4")), mine.column(1), pa.array(np.full(n, size, "i4")),
                            pa.array([k.tobytes() for k in keys], pa.binary()), mine.column(0), mine.column(3),
                        ]
                        yield pa.record_batch(columns, names=["number", "label", "size", "key", "vec_id", "vector"])

    return run


def _window_pairs(window: int, threshold: float):
    """Compare each row with the ``window`` rows before it in its pass, label and vector length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, ids, rows = None, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            groups = np.stack([batch.column(i).to_numpy() for i in range(3)], axis=1)
            edges = np.flatnonzero((groups[1:] != groups[:-1]).any(1)) + 1
            for first, end in zip([0, *edges], [*edges, len(groups)], strict=True):
                part = batch.slice(first, end - first)
                mine, unit = part.column(4).to_numpy(), _matrix(part.column(5))
                if last is not None and (last == groups[first]).all():
                    held = len(ids)
                    ids, rows = np.concatenate([ids, mine]), np.concatenate([rows, unit])
                else:
                    held, ids, rows = 0, mine, unit
                last = groups[first].copy()
                left, right = [], []
                for at in range(held, len(ids), 256):
                    low, high = max(0, at - window), min(len(ids), at + 256)
                    close = rows[at:high] @ rows[low:high].T >= threshold
                    i, j = np.nonzero(close)
                    gap = (i + at) - (j + low)
                    good = (gap > 0) & (gap <= window)
                    left.append(ids[i[good] + at])
                    right.append(ids[j[good] + low])
                if left:
                    a, b = np.concatenate(left), np.concatenate(right)
                    other = a != b
                    a, b = a[other], b[other]
                    yield pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["src", "dst"])
                ids, rows = ids[-window:], rows[-window:]

    return run


def _block_pairs(threshold: float):
    """All pairs between two blocks of a label; rows of one pair of blocks follow each other."""

    def compare(key, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        ids, blocks, unit = rows.column(5).to_numpy(), rows.column(4).to_numpy(), _matrix(rows.column(6))
        a, b = np.flatnonzero(blocks == key[2]), np.flatnonzero(blocks == key[3])
        close = unit[a] @ unit[b].T >= threshold
        if key[2] == key[3]:
            close = np.triu(close, 1)
        i, j = np.nonzero(close)
        left, right = ids[a[i]], ids[b[j]]
        return pa.record_batch([pa.array(np.minimum(left, right)), pa.array(np.maximum(left, right))], names=["src", "dst"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, parts = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            groups = np.stack([batch.column(i).to_numpy() for i in range(4)], axis=1)
            edges = np.flatnonzero((groups[1:] != groups[:-1]).any(1)) + 1
            for first, end in zip([0, *edges], [*edges, len(groups)], strict=True):
                key = tuple(groups[first].tolist())
                if parts and key != last:
                    yield compare(last, parts)
                    parts = []
                last = key
                parts.append(batch.slice(first, end - first))
        if parts:
            yield compare(last, parts)

    return run


def _all_pairs(rows: DataFrame, labels: DataFrame, threshold: float) -> DataFrame:
    """Every pair of the vectors of ``labels`` (label, size, n), compared in blocks."""
    per = F.least(F.lit(4096), F.greatest(F.lit(256), F.ceil(F.col("n") / 64)))
    sized = rows.join(labels.filter("n > 1").select("label", "size", F.ceil(F.col("n") / per).alias("blocks")), ["label", "size"])
    mine = sized.withColumn("block", F.pmod(F.xxhash64("vec_id"), "blocks"))
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("other")
    both = mine.select("label", "size", "block", "vec_id", "vector", other)
    keys = ["label", "size", "bi", "bj"]
    dealt = both.select(
        "label", F.col("size").cast("bigint").alias("size"), F.least("block", "other").alias("bi"),
        F.greatest("block", "other").alias("bj"), "block", "vec_id", "vector",
    ).repartition(partitions(rows), *keys).sortWithinPartitions(*keys)
    return materialize(dealt.mapInArrow(_block_pairs(threshold), "src bigint, dst bigint"), "all-pairs")


def near_pairs(
    rows: DataFrame, threshold: float = THRESHOLD, passes: int = PASSES, window: int = WINDOW, bits: int = BITS, seed: int = SEED
) -> DataFrame:
    """Distinct pairs (src < dst) of vector ids with one label and a cosine of at least ``threshold``.

    ``rows`` holds vec_id (0 or more), label and vector, all usable.  Labels with no more rows than
    the windows of all passes hold have all their pairs compared, in blocks.  Others go through rounds
    of ``passes`` passes: the vectors of a label are ordered by their key across the whole cluster,
    and each is compared with a fixed number of neighbours.  Ties are broken by a hash of their own in
    every pass.  Probes, vectors right at the threshold from some of the label's, run along; rounds go
    on until ``RECALL`` of them are found.  A label that would need as many comparisons as it has
    pairs has all of them compared instead.
    """
    label = ["label", "size"]
    kind = rows.schema["vector"].dataType.simpleString()
    kind = kind if kind == "array<float>" else "array<double>"
    rows = rows.select("vec_id", "label", F.size("vector").alias("size"), F.col("vector").cast(kind).alias("vector"))
    counts = materialize(rows.groupBy(*label).agg(F.count(F.lit(1)).alias("n")), "label-counts")
    exact, per_round = F.col("n") <= 2 * passes * window, passes * window
    found = _all_pairs(rows, counts.filter(exact), threshold)
    large = counts.filter(~exact)
    if large.isEmpty():
        return found
    mine = rows.join(large, label)
    sums = mine.select(*label, "vector").mapInArrow(_centres, "label bigint, size int, total array<double>")
    means = sums.select(*label, F.posexplode("total").alias("at", "x")).groupBy(*label, "at").agg(F.sum("x").alias("x"))
    centre = F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda v: v["x"])
    means = means.groupBy(*label).agg(centre.alias("total"))
    centred = large.join(means, label).withColumn("centre", F.transform("total", lambda x: x / F.col("n"))).drop("total")
    left = materialize(centred, "large-labels")

    some = F.pmod(F.xxhash64(F.lit(seed), "vec_id"), F.col("n")) < F.least(F.lit(PROBES), F.col("n") / 16)
    probes = mine.filter(some).select("vec_id", *label, "vector").mapInArrow(
        _probes(threshold, seed), "vec_id bigint, label bigint, size int, vector array<double>"
    )
    probes = materialize(probes.withColumn("vector", F.col("vector").cast(kind)), "probes")
    asked = materialize(probes.groupBy(*label).agg(F.count(F.lit(1)).alias("asked")), "asked")
    hits, done = None, 0
    while True:
        run = rows.unionByName(probes).join(left.select(*label, "centre"), label).select("vec_id", *label, "vector", "centre")
        keyed = run.mapInArrow(
            _sort_keys(range(done * passes, (done + 1) * passes), bits, seed),
            f"number int, label bigint, size int, key binary, vec_id bigint, vector {kind}",
        )
        order = ["number", *label, "key", F.xxhash64("number", "vec_id"), "vec_id"]
        ordered = keyed.repartitionByRange(partitions(rows), *order).sortWithinPartitions(*order)
        pairs = materialize(ordered.mapInArrow(_window_pairs(window, threshold), "src bigint, dst bigint").distinct(), "near-pairs")
        found = found.unionByName(pairs.filter("src >= 0"))
        done += 1
        hit = pairs.filter("src < 0 AND dst = -1 - src").select(F.col("src").alias("vec_id"))
        hits = hit if hits is None else hits.unionByName(hit)
        got = probes.join(hits.distinct(), "vec_id").groupBy(*label).agg(F.count(F.lit(1)).alias("got"))
        recall = F.coalesce(F.col("got") / F.col("asked"), F.lit(0.0))
        state = left.join(asked, label, "left").join(got, label, "left").withColumn("recall", recall).drop("asked", "got")
        state = materialize(state.filter(F.col("recall") < RECALL), "open-labels")
        if state.isEmpty():
            break
        # Rounds that the measured recall lets expect, against all pairs.
        more = F.when(F.col("recall") > 0, F.log(F.lit(1 - RECALL)) / F.log1p(-F.col("recall"))).otherwise(F.col("n")) * done
        dear = F.greatest(more, F.lit(done + 1.0)) * per_round >= F.col("n") / 2
        found = found.unionByName(_all_pairs(rows, state.filter(dear), threshold))
        left = materialize(state.filter(~dear).drop("recall"), "large-labels")
        if left.isEmpty():
            break
    return materialize(found.distinct(), "near-pairs")


def _reached(groups: DataFrame, sizes: DataFrame, several: DataFrame) -> DataFrame:
    """(g, n_links): the ids but one in the classes of each group; ``groups`` holds distinct (g, node)."""
    alone = groups.join(sizes, "node").groupBy("g").agg(F.sum("ids").alias("alone"))
    shared = groups.join(several, "node").select("g", "vec_id").distinct().groupBy("g").agg(F.count(F.lit(1)).alias("shared"))
    count = F.coalesce("alone", F.lit(0)) + F.coalesce("shared", F.lit(0)) - 1
    return alone.join(shared, "g", "full").select("g", count.alias("n_links"))


def dedup_embeddings(vectors: DataFrame, **settings) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of ``vectors`` (vec_id, label, embedding).

    Null labels, ids and vectors, zero vectors and those with null or non-finite components link with
    nothing.  Vectors link only with those of their own length.  Rows with one id are one vector:
    a link of any of them counts for all.  A null id has itself as component.

    Equal vectors of a label are one class, which all passes see as one row and links count by its ids.
    """
    known = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & usable(F.col("embedding"))
    rows = vectors.filter(known).select(
        F.col("vec_id").cast("bigint"), F.col("label").cast("bigint"), F.col("embedding").alias("vector")
    )
    classes = rows.select("label", "vector").distinct().withColumn("node", F.monotonically_increasing_id())
    classes = materialize(classes, "vector-classes")
    members = materialize(rows.join(classes.hint("merge"), ["label", "vector"]).select("vec_id", "node").distinct(), "members")
    pairs = near_pairs(classes.select(F.col("node").alias("vec_id"), "label", "vector"), **settings)

    # Ids of several classes belong to each of them and count once.
    repeated = members.groupBy("vec_id").agg(F.count(F.lit(1)).alias("c"), F.min("node").alias("first")).filter("c > 1")
    repeated = materialize(repeated, "repeated-ids")
    several = materialize(members.join(repeated, "vec_id").select("vec_id", "node", "first"), "several")
    single = members.join(repeated, "vec_id", "left_anti")
    sizes = materialize(single.groupBy("node").agg(F.count(F.lit(1)).alias("ids")), "class-sizes")
    itself = classes.select("node", F.col("node").alias("other"))
    both = pairs.select(F.col("src").alias("node"), F.col("dst").alias("other"))
    near = itself.unionByName(both).unionByName(pairs.select(F.col("dst").alias("node"), F.col("src").alias("other")))
    shared = several.select("vec_id", "node")
    of_class = _reached(near.select(F.col("node").alias("g"), F.col("other").alias("node")), sizes, shared)
    links = single.join(of_class.withColumnRenamed("g", "node"), "node").select("vec_id", "n_links")
    if not repeated.isEmpty():
        groups = shared.join(near, "node").select(F.col("vec_id").alias("g"), F.col("other").alias("node")).distinct()
        links = links.unionByName(_reached(groups, sizes, shared).withColumnRenamed("g", "vec_id"))

    bridges = several.select(F.col("first").alias("src"), F.col("node").alias("dst"))
    components = connected_components(classes.select(F.col("node").alias("id")), pairs.unionByName(bridges))
    named = members.join(components.withColumnRenamed("id", "node"), "node").select("vec_id", "component").distinct()
    named = materialize(named, "named")
    smallest = named.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    found = named.join(smallest, "component").select("vec_id", "component_id").join(links, "vec_id")
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"))
    joined = rows.join(found, "vec_id", "left")
    component = F.coalesce("component_id", "vec_id")
    return joined.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )


def op10_embedding_dedup(spark, folder):
    return dedup_embeddings(table(spark, folder, "embeddings"))
