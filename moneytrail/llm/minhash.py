"""Near-duplicate documents by bottom-k sketches, inverted lists, sketch estimates and exact Jaccard."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph_search import connected_components
from ..session import materialize
from .common import partitions, table
from .shingles import Shingler, set_digest, similar

SHINGLE_WORDS = 5
PERCENT = 80
SKETCH = 96
# Two sketches of linked documents share this part of their values, bar an event of more than 4
# standard deviations: sets right at the threshold share 89 % of either at equal size, but only 80 %
# of the larger one if it contains the other; 59 of 96 values are then missed with a chance of 7e-6.
SHARED = 0.62
# How far below the threshold an estimate from a union sketch may lie: more than 4 standard deviations.
SLACK = 0.18
# Rounds at most in which every list compares all its members with one of them, before all pairs of
# components that still share a list are compared; fewer if those pairs are at most so many times
# the rows of all lists.
STAR_ROUNDS = 4
PAIRS_PER_ROW = 64
# Values of the sketches that are compared in blocks: most sets lie in them whole, so that their pairs are settled there.
WIDE_SKETCH = 512
# Rows of a list that are compared with so many others in one block.
BLOCK_ROWS = 256
SKETCH_SCHEMA = "doc_id bigint, n_shingles bigint, digest binary, sketch array<bigint>"


def _sketches(width: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                counts, digests, values = [], [], []
                for text in part.column(1).to_pylist():
                    found = shingler(text)
                    counts.append(len(found))
                    digests.append(set_digest(found) if len(found) else None)
                    values.append(found[:size].view(np.int64))
                offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype("i4")
                flat = np.concatenate(values) if values else np.empty(0, "i8")
                columns = [
                    part.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)),
                ]
                yield pa.record_batch(columns, names=["doc_id", "n_shingles", "digest", "sketch"])

    return run


def estimate(a: np.ndarray, b: np.ndarray, size: int) -> float:
    """Jaccard similarity from the bottom-k of the union of two sketches (sorted, unsigned)."""
    union = np.union1d(a, b)[:size]
    return (np.isin(union, a) & np.isin(union, b)).sum() / len(union)


def full_estimates(a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    """``estimate`` of rows of ``a`` (or its one row) and ``b`` at once, all sketches of ``size`` values."""
    both = np.sort(np.concatenate([np.broadcast_to(a, b.shape), b], axis=1), axis=1)
    again = both[:, 1:] == both[:, :-1]
    place = np.arange(2, 2 * size + 1) - np.cumsum(again, axis=1)  # in the union, from 1
    return (again & (place <= size)).sum(axis=1) / size


def _estimates(size: int, percent: int):
    """Keep pairs that may be similar; ``score`` is the estimate.  Whole sets are compared exactly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, scores = [], []
            n1, n2 = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            sides = []
            for column in (batch.column(4), batch.column(5)):
                offsets, flat = column.offsets.to_numpy(), column.values.to_numpy().view(np.uint64)
                sides.append((offsets, flat))
            (o1, f1), (o2, f2) = sides
            full = np.flatnonzero((np.diff(o1) == size) & (np.diff(o2) == size) & (np.maximum(n1, n2) > size))
            each = np.arange(size)
            known = np.zeros(batch.num_rows)
            known[full] = full_estimates(f1[o1[full][:, None] + each], f2[o2[full][:, None] + each], size)
            at_once = np.zeros(batch.num_rows, bool)
            at_once[full] = True
            for i in range(batch.num_rows):
                a, b = f1[o1[i] : o1[i + 1]], f2[o2[i] : o2[i + 1]]
                found = known[i] if at_once[i] else estimate(a, b, size if max(n1[i], n2[i]) > size else len(a) + len(b))
                whole = n1[i] <= size and n2[i] <= size
                if similar(a, b, percent) if whole else 100 * (found + SLACK) >= percent:
                    keep.append(i)
                    scores.append(found)
            rows = batch.take(pa.array(keep, pa.int64()))
            yield pa.record_batch([rows.column(0), rows.column(1), pa.array(scores, pa.float64())], names=["hub", "node", "score"])

    return run


def least_shared(n: np.ndarray, size: int, percent: int) -> np.ndarray:
    """How many values the sketch of a set of ``n`` shares at least with that of a linked set."""
    whole = n <= math.floor(size * percent / 100)  # then both sets lie in their sketches
    return np.where(whole, -(-n * percent // 100), math.floor(size * SHARED))


def _owners(values: np.ndarray, owners: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Owners of all places of ``values`` (sorted) that hold one of ``wanted`` (distinct)."""
    low, high = np.searchsorted(values, wanted, "left"), np.searchsorted(values, wanted, "right")
    size = high - low
    return owners[np.arange(size.sum()) + np.repeat(low - (np.cumsum(size) - size), size)]


def _block_pairs(size: int, percent: int):
    """Possible pairs of the blocks that follow each other in a partition.

    Rows: value, bi, bj, outer, node, n, component, lists, sketch.  A pair is compared only in the block
    of the smallest list that both are in.  Overlaps and estimates of an outer row are counted against all
    rows of its block at once, if any are left to meet there; only pairs that pass both come out, and of
    links between whole sets only those that join two components which no link of the task joined before.
    """
    slack = SLACK * math.sqrt(SKETCH / size)  # as many standard deviations at every size

    def root(joined: dict[int, int], component: int) -> int:
        while component in joined:
            upper = joined[component]
            if upper in joined:
                joined[component] = joined[upper]
            component = upper
        return component

    def compare(rows: list[tuple], found: list[tuple], joined: dict[int, int]) -> None:
        inner = [r for r in rows if not r[3]]
        outer = [r for r in rows if r[3]]
        if not inner or not outer:
            return
        value = rows[0][0]
        length = np.array([len(r[8]) for r in inner])
        owned = np.repeat(np.arange(len(inner)), length)
        values = np.concatenate([r[8] for r in inner])
        order = np.argsort(values, kind="stable")
        values, owned = values[order], owned[order]
        # Lists of the inner rows below this one: a pair that shares any of them is met there.
        lower = [r[7][r[7] < value] for r in inner]
        met = np.concatenate(lower)
        met_by = np.repeat(np.arange(len(inner)), [len(x) for x in lower])
        order = np.argsort(met, kind="stable")
        met, met_by = met[order], met_by[order]
        node, n, component = (np.array([r[i] for r in inner]) for i in (4, 5, 6))
        least = least_shared(n, size, percent)
        for r in outer:
            fits = (component != r[6]) & (100 * np.minimum(n, r[5]) >= percent * np.maximum(n, r[5]))
            fits[_owners(met, met_by, r[7][r[7] < value])] = False
            if not fits.any():
                continue
            shared = np.bincount(_owners(values, owned, r[8]), minlength=len(inner))
            need = np.minimum(least, least_shared(np.array([r[5]]), size, percent))
            left = np.flatnonzero(fits & (shared >= need))
            union = n[left] + r[5] - shared[left]
            whole = np.maximum(n[left], r[5]) <= size
            score, good = shared[left] / union, 100 * shared[left] >= percent * union
            full = ~whole & (length[left] == size) & (len(r[8]) == size)
            if full.any():
                score[full] = full_estimates(r[8][None, :], np.stack([inner[i][8] for i in left[full]]), size)
            for k in np.flatnonzero(~whole & ~full):
                score[k] = estimate(r[8], inner[left[k]][8], size)
            good = np.flatnonzero(np.where(whole, good, 100 * (score + slack) >= percent))
            good = good[np.argsort(~whole[good], kind="stable")]  # sure links first
            for k, i, c, at in zip(good.tolist(), node[left[good]].tolist(), component[left[good]].tolist(), score[good].tolist(), strict=True):
                a, b = root(joined, r[6]), root(joined, c)
                if a == b:
                    continue
                if whole[k]:
                    joined[max(a, b)] = min(a, b)
                found.append((min(r[4], i), max(r[4], i), at))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, rows, found, joined = None, [], [], {}

        def drain():
            hubs, nodes, scores = zip(*set(found), strict=True) if found else ((), (), ())
            found.clear()
            return pa.record_batch([pa.array(hubs, pa.int64()), pa.array(nodes, pa.int64()), pa.array(scores, pa.float64())], names=["hub", "node", "score"])

        for batch in batches:
            (in_lists, at_lists), (flat, at) = ((c.values.to_numpy(), c.offsets.to_numpy()) for c in (batch.column(7), batch.column(8)))
            flat = flat.view(np.uint64)
            for i, row in enumerate(zip(*[batch.column(c).to_pylist() for c in range(7)], strict=True)):
                if row[:3] != last:
                    compare(rows, found, joined)
                    last, rows = row[:3], []
                rows.append((*row, in_lists[at_lists[i] : at_lists[i + 1]], flat[at[i] : at[i + 1]]))
            if found:
                yield drain()
        compare(rows, found, joined)
        yield drain()

    return run


def _verified(width: int, percent: int):
    """Pairs whose full shingle sets are similar; the set of a repeated hub is kept from row to row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, last, hub_set = Shingler(width), None, None
        for batch in batches:
            keep = []
            hubs = batch.column(0).to_pylist()
            for i, hub in enumerate(hubs):
                if hub != last:
                    last, hub_set = hub, shingler(batch.column(2)[i].as_py())
                if similar(hub_set, shingler(batch.column(3)[i].as_py()), percent):
                    keep.append(i)
            rows = batch.take(pa.array(keep, pa.int64()))
            yield pa.record_batch([rows.column(0), rows.column(1)], names=["src", "dst"])

    return run


class NearDuplicates:
    """The state of one run: classes of equal sets, inverted lists, texts, links and components."""

    def __init__(self, docs: DataFrame, shingle_words: int, percent: int, sketch: int):
        self.width, self.percent, self.size = shingle_words, percent, sketch
        plain = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
        rows = plain.mapInArrow(_sketches(shingle_words, sketch), SKETCH_SCHEMA)
        self.rows = materialize(rows.withColumn("row_id", F.monotonically_increasing_id()), "sketches")
        each, value = self.rows.count(), 8  # bytes
        # Rows with one set are one class: equal 128-bit digests of the full sets.  Null ids link with nothing.
        usable = self.rows.filter(F.col("digest").isNotNull() & F.col("doc_id").isNotNull())
        classes = usable.groupBy("digest").agg(F.min(F.struct("doc_id", "row_id")).alias("first"))
        self.classes = materialize(
            classes.select("digest", F.col("first.doc_id").alias("doc_id"), F.col("first.row_id").alias("node")), "classes", 32 * each
        )
        nodes = self.classes.select(F.col("node").alias("row_id"))
        first = self.rows.join(nodes.hint("merge"), "row_id", "left_semi")
        self.sketches = materialize(
            first.select(F.col("row_id").alias("node"), F.col("n_shingles").alias("n"), "sketch"), "class-sketches", value * (sketch + 2) * each
        )
        lists = materialize(self._inverted_lists(each), "lists", 3 * value * sketch * each)
        # Only what two or more classes share goes on: lists, and the sketches and texts of their members.
        shared = lists.groupBy("value").agg(F.count(F.lit(1)).alias("members")).filter("members > 1").select("value")
        self.lists = materialize(lists.join(shared, "value", "left_semi"), "shared-lists", 3 * value * lists.count())
        self.entries = self.lists.count()
        nodes = materialize(self.lists.select("node").distinct(), "nodes", value * self.entries)
        self.members = nodes.count()
        self.sketches = materialize(
            self.sketches.join(nodes, "node", "left_semi"), "shared-sketches", value * (sketch + 2) * self.members
        )
        self.texts = materialize(self._texts(plain, nodes), "texts")
        self.links: DataFrame | None = None
        self.linked = 0
        self.components: DataFrame | None = None

    def _inverted_lists(self, each: int) -> DataFrame:
        """(value, node, n): the rarest retained values of every class, as many as a link needs.

        If two sketches share at least ``o`` values, their ``size - o + 1`` rarest ones share one.
        Values that one class alone retains come first in that order and need no list.
        """
        postings = self.sketches.select("node", "n", F.explode("sketch").alias("value"))
        common = postings.groupBy("value").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
        common = materialize(common, "common-values", 8 * self.size * each)
        size, part = F.least(F.col("n"), F.lit(self.size)), self.percent / 100
        small = math.floor(self.size * part)  # up to here both sets lie in their sketches whole
        shared = F.when(F.col("n") <= small, F.ceil(F.col("n") * self.percent / 100)).otherwise(math.floor(self.size * SHARED))
        found = postings.join(common, "value").groupBy("node", "n").agg(
            F.array_sort(F.collect_list(F.struct("df", "value"))).alias("values")  # at most a sketch
        )
        alone = size - F.size("values")
        count = F.greatest(F.lit(0), size - shared + 1 - alone).cast("int")
        return found.select("node", "n", F.explode(F.slice("values", F.lit(1), count)).alias("v")).select(
            F.col("v.value").alias("value"), "node", "n"
        )

    def _texts(self, plain: DataFrame, nodes: DataFrame) -> DataFrame:
        """(node, text) of the classes ``nodes``."""
        wanted = materialize(self.classes.join(nodes, "node").select("node", "doc_id", "digest"), "wanted", 32 * self.members)
        width = self.width

        def digests(batches):
            shingler = Shingler(width)
            for batch in batches:
                for at in range(0, batch.num_rows, 512):
                    part = batch.slice(at, 512)
                    found = [set_digest(shingler(t)) for t in part.column(1).to_pylist()]
                    yield pa.record_batch([*part.columns, pa.array(found, pa.binary())], names=["node", "text", "digest", "found"])

        # An id may repeat with other texts: the digest tells which row is meant.
        # A merge join at every size: each text moves once.
        candidates = plain.join(wanted.hint("merge"), "doc_id").select("node", "text", "digest")
        checked = candidates.mapInArrow(digests, "node bigint, text string, digest binary, found binary")
        return checked.filter(F.col("digest") == F.col("found")).dropDuplicates(["node"]).select("node", "text")

    def _possible(self, pairs: DataFrame) -> DataFrame:
        """Pairs (hub, node) that pass the union-sketch estimate, with their score."""
        hub = self.sketches.select(F.col("node").alias("hub"), F.col("n").alias("n1"), F.col("sketch").alias("s1"))
        other = self.sketches.select("node", F.col("n").alias("n2"), F.col("sketch").alias("s2"))
        both = pairs.join(other, "node").join(hub, "hub").select("hub", "node", "n1", "n2", "s1", "s2")
        return materialize(both.mapInArrow(_estimates(self.size, self.percent), "hub bigint, node bigint, score double"), "possible")

    def _verify(self, pairs: DataFrame) -> None:
        hub = self.texts.select(F.col("node").alias("hub"), F.col("text").alias("t1"))
        other = self.texts.select("node", F.col("text").alias("t2"))
        both = pairs.select("hub", "node").join(other, "node").join(hub, "hub").select("hub", "node", "t1", "t2")
        found = materialize(both.mapInArrow(_verified(self.width, self.percent), "src bigint, dst bigint"), "links")
        count = found.count()
        if not count and self.components is not None:
            return  # nothing new is connected
        self.links, self.linked = found if self.links is None else self.links.unionByName(found), self.linked + count
        ids = self.lists.select(F.col("node").alias("id"))
        named = connected_components(ids, self.links, self.linked).withColumnRenamed("id", "node")
        self.components = materialize(named, "components", 16 * self.members)

    def _apart(self, pairs: DataFrame) -> DataFrame:
        """Pairs whose ends are not connected yet."""
        if self.components is None:
            return pairs
        a = self.components.select(F.col("node").alias("hub"), F.col("component").alias("c1"))
        b = self.components.select("node", F.col("component").alias("c2"))
        return pairs.join(a, "hub").join(b, "node").filter("c1 <> c2").drop("c1", "c2")

    def _compare(self, possible: DataFrame) -> None:
        """Verify the best pair of each node first, then those whose ends it did not connect."""
        best = possible.groupBy("node").agg(F.max(F.struct("score", "hub")).alias("b")).select("node", F.col("b.hub").alias("hub"))
        self._verify(best)
        rest = self._apart(possible.select("hub", "node")).join(best, ["hub", "node"], "left_anti")
        rest = materialize(rest, "rest", 16 * possible.count())
        if not rest.isEmpty():
            self._verify(rest)

    def _sized(self, a: str, b: str):
        return 100 * F.least(a, b) >= self.percent * F.greatest(a, b)

    def link(self) -> None:
        """Find every link that connects two components.

        A list never yields all its pairs while it is long: each round compares all members of a
        list with its first member, which then leaves the list, and lists of one component end.
        What is left after a few rounds is compared pair by pair across components.
        """
        lists, rows = self.lists, self.entries
        if not rows:
            return
        for _ in range(STAR_ROUNDS):
            hubs = lists.groupBy("value").agg(F.min(F.struct("node", "n")).alias("h"), F.count(F.lit(1)).alias("members"))
            hubs = materialize(
                hubs.filter("members > 1").select("value", F.col("h.node").alias("hub"), F.col("h.n").alias("n1")), "hubs", 24 * rows
            )
            joined = lists.select("value", "node", "n").join(hubs, "value").filter(F.col("node") != F.col("hub"))
            pairs = joined.filter(self._sized("n", "n1")).select("hub", "node").distinct()
            self._compare(self._possible(materialize(self._apart(pairs), "pairs", 16 * rows)))
            lists, left = self._open_lists(joined.select("value", "node", "n"))
            if not left:
                return
            if left <= PAIRS_PER_ROW * rows:
                break
        # Each member outside the largest component of its list meets the whole list, in blocks.
        # A row carries the lists it is still in, so that a pair is compared in the smallest common one.
        own = lists.groupBy("node").agg(F.array_sort(F.collect_list("value")).alias("lists"))  # at most a sketch
        own = materialize(own, "own-lists", 8 * (self.size + 1) * self.members)
        wide = max(self.size, WIDE_SKETCH)
        texts = self.texts.join(own.select("node"), "node", "left_semi").select("node", "text")
        sketches = materialize(texts.mapInArrow(_sketches(self.width, wide), SKETCH_SCHEMA), "wide-sketches")
        sketched = lists.join(own, "node").join(sketches.select(F.col("doc_id").alias("node"), "sketch"), "node")
        outer = F.col("component") != F.col("largest")
        bi = F.pmod(F.xxhash64("node"), F.ceil(F.col("outers") / BLOCK_ROWS))
        bj = F.pmod(F.xxhash64("node"), F.ceil(F.col("members") / BLOCK_ROWS))
        columns = [F.col(c) for c in ("node", "n", "component", "lists", "sketch")]
        each = lambda blocks: F.explode(F.sequence(F.lit(0).cast("bigint"), F.ceil(F.col(blocks) / BLOCK_ROWS) - 1))
        left = sketched.filter(outer).select("value", bi.alias("bi"), each("members").alias("bj"), F.lit(True).alias("outer"), *columns)
        right = sketched.select("value", each("outers").alias("bi"), bj.alias("bj"), F.lit(False).alias("outer"), *columns)
        order = ["value", "bi", "bj"]
        dealt = left.unionByName(right).repartition(partitions(lists), *order).sortWithinPartitions(*order)
        found = dealt.mapInArrow(_block_pairs(wide, self.percent), "hub bigint, node bigint, score double")
        self._compare(materialize(found.groupBy("hub", "node").agg(F.max("score").alias("score")), "possible"))

    def _open_lists(self, lists: DataFrame) -> tuple[DataFrame, int]:
        """Lists of several components with the largest one of each, and how many pairs they may yield."""
        rows = self.entries
        named = materialize(lists.join(self.components, "node"), "named-lists", 32 * rows)
        counts = named.groupBy("value", "component").agg(F.count(F.lit(1)).alias("m"))
        top = counts.groupBy("value").agg(F.max(F.struct("m", "component")).alias("top"), F.sum("m").alias("members"))
        mixed = materialize(
            top.filter("members > top.m").select(
                "value", F.col("top.component").alias("largest"), (F.col("members") - F.col("top.m")).alias("outers"), "members"
            ),
            "mixed", 32 * rows,
        )
        left = mixed.agg(F.sum(F.col("outers") * F.col("members"))).first()[0] or 0
        return materialize(named.join(mixed, "value"), "lists", 56 * rows), left

    def result(self) -> DataFrame:
        named = self.classes
        if self.components is not None:
            named = self.classes.join(self.components, "node", "left")
            label = F.coalesce("component", "node")
        else:
            label = F.col("node")
        size = 32 * self.rows.count()
        named = materialize(named.select("digest", "doc_id", label.alias("component")), "named", size)
        smallest = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
        smallest = materialize(smallest, "smallest", size)
        known = materialize(named.join(smallest, "component").select(F.col("digest").alias("_digest"), "component_id"), "known", size)
        rows = self.rows.select("doc_id", "n_shingles", "digest")
        linked = rows.filter(F.col("doc_id").isNotNull()).join(known, F.col("digest") == F.col("_digest"), "left")
        nameless = rows.filter(F.col("doc_id").isNull()).withColumn("component_id", F.lit(None).cast("bigint"))
        both = linked.select("doc_id", "n_shingles", "component_id").unionByName(nameless.drop("digest"))
        component = F.coalesce("component_id", "doc_id")
        return both.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def near_duplicates(
    docs: DataFrame, shingle_words: int = SHINGLE_WORDS, percent: int = PERCENT, sketch: int = SKETCH
) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of ``docs``.

    Documents link if 100 * intersection >= percent * union of their shingle sets; components follow
    links.  Candidates come from inverted lists of sketch values, so a link is missed only if two
    sketches deviate by more than four standard deviations, also if one set contains the other; sets that fit a sketch are found without fail.

    Null and blank texts have no shingles and link with nothing.  Null ids link with nothing and have
    a null component.  Rows with one id and other texts are documents of their own.  Repeated rows
    get equal results.  An empty table gives no rows.
    """
    state = NearDuplicates(docs, shingle_words, percent, sketch)
    state.link()
    return state.result()


def without_near_duplicates(docs: DataFrame, **settings) -> DataFrame:
    """One document of every group of linked ones: the one with the smallest id, with all its columns.

    Rows with one id stay together if one of them stays; equal rows become one.  Null ids stay.
    """
    kept = near_duplicates(docs, **settings).filter("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("id")).distinct()
    kept = materialize(kept, "kept").alias("k").hint("merge")  # at every size, so each text moves once
    packed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("bigint").alias("key"), F.col("text").alias("said")
    )
    mine = packed.join(kept, F.col("key") == F.col("k.id")).dropDuplicates(["key", "said"]).select("row")
    both = mine.unionByName(packed.filter(F.col("key").isNull()).select("row"))
    return both.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op2_minhash(spark, folder):
    return near_duplicates(table(spark, folder, "documents"), shingle_words=4)


OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 OR words IS NULL THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' '))) END AS shingles FROM w
), n AS (SELECT doc_id, len(shingles) AS n FROM s),
x AS (SELECT doc_id, unnest(shingles) AS shingle FROM s),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM x a JOIN x b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL
), e AS (
  SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * common >= 80 * (na.n + nb.n - common)
), r AS (
  SELECT doc_id AS a, doc_id AS b FROM n
  UNION SELECT r.a, y.b FROM r JOIN (SELECT a, b FROM e UNION ALL SELECT b, a FROM e) y ON r.b = y.a
)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, min(r.b) AS component_id, n.doc_id = min(r.b) AS kept
FROM n JOIN r ON r.a = n.doc_id GROUP BY n.doc_id, n.n
"""
