"""Ranked lexical search over an index of length strata: equal normalisers together, postings by frequency."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import partitions, prefix_sums, table

TOP = 20
# Term occurrences of the documents in one block of a stratum, about; a longer document is a block of its own.
BLOCK_TERMS = 1 << 16
# A pass over the index takes queries of so many distinct terms together (an item counts 256 at least),
# so what is sent to the tasks has a fixed bound; more queries take more passes.
PASS_TERMS = 1 << 18
ITEM_TERMS = 256
# Postings of query terms that a task holds while it orders its visits.
HELD_POSTINGS = 4_000_000
# The parts of the score: a term's weight times floor(10^9 tf / (1000 tf + 12 m)).
SCALE, TF_PART, M_PART, FLAT, SLOPE = 1_000_000_000, 1000, 12, 75, 25

# Letters, digits and all beyond ASCII are of terms, with A-Z in lower case; the rest parts them.
_TERM_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256)
)
BLOCK_SCHEMA = (
    "m bigint, doc_ids array<bigint>, terms binary, dfs array<int>, runs array<int>, run_tf array<int>, run_size array<int>, docs array<int>"
)
_BLOCK_NAMES = ["m", "doc_ids", "terms", "dfs", "runs", "run_tf", "run_size", "docs"]


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TERM_BYTES).split()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, text) to (key, n, distinct, terms, tfs): distinct terms in one string, their counts as 64-bit numbers."""
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            sizes, distinct, terms, tfs = [], [], [], []
            for text in part.column(1).to_pylist():
                found = Counter(terms_of(text))
                tf = np.fromiter(found.values(), "<i8", len(found))
                sizes.append(int(tf.sum()))
                distinct.append(len(found))
                terms.append(b" ".join(found))
                tfs.append(tf.tobytes())
            columns = [part.column(0), *map(pa.array, (sizes, distinct)), *(pa.array(c, pa.binary()) for c in (terms, tfs))]
            yield pa.record_batch(columns, names=["key", "n", "distinct", "terms", "tfs"])


def _block(m: int, rows: list[tuple]) -> pa.RecordBatch:
    """One block: terms, and for each term its runs of equal tf with the documents (places) that have it."""
    numbers: dict[bytes, int] = {}
    split = [r[1].split(b" ") for r in rows]
    term = np.array([numbers.setdefault(t, len(numbers)) for terms in split for t in terms])
    doc = np.repeat(np.arange(len(rows), dtype=np.int32), [len(s) for s in split])
    tf = np.concatenate([np.frombuffer(r[2], "<i8") for r in rows])
    order = np.lexsort((tf, term))  # stable: places ascend within a run
    term, tf, doc = term[order], tf[order], doc[order]
    first = np.flatnonzero(np.concatenate([[True], (np.diff(term) != 0) | (np.diff(tf) != 0)]))
    columns = [
        np.bincount(term), np.bincount(term[first]), tf[first], np.diff(np.append(first, len(term))), doc,
    ]
    kinds = [pa.int32()] * 5
    lists = [pa.array([c.tolist() if len(c) < 64 else c], pa.list_(k)) for c, k in zip(columns, kinds, strict=True)]
    ids = pa.array([[r[0] for r in rows]], pa.list_(pa.int64()))
    return pa.record_batch([pa.array([m]), ids, pa.array([b" ".join(numbers)], pa.binary()), *lists], names=_BLOCK_NAMES)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of the documents of a task, which come ordered by m and part."""
    last, rows, size = None, [], 0
    for batch in batches:
        for m, part, doc_id, n, terms, tfs in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if rows and ((m, part) != last or size + n > 2 * BLOCK_TERMS):
                yield _block(last[0], rows)
                rows, size = [], 0
            last, size = (m, part), size + n
            rows.append((doc_id, terms, tfs))
    if rows:
        yield _block(last[0], rows)


@dataclass
class LengthIndex:
    """Blocks of all documents with terms, their number and the number of all their terms."""

    blocks: DataFrame
    documents: int
    terms: int


def build_index(docs: DataFrame) -> LengthIndex:
    """Index every row of ``docs`` by the terms of its whole text.

    A stratum is dealt by hash into as many parts as it has blocks, so one with many or long documents
    spreads over tasks.  Documents without terms are not in it.
    """
    plain = docs.select(F.col("doc_id").cast("bigint").alias("key"), F.col("text").cast("string").alias("text"))
    schema = "key bigint, n bigint, distinct bigint, terms binary, tfs binary"
    counted = materialize(plain.mapInArrow(_counted, schema).filter("n > 0").withColumn("row", F.monotonically_increasing_id()), "terms")
    sums = counted.agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    wide = lambda c: c.cast("decimal(19,0)")
    above = wide(F.col("n") * SLOPE) * wide(F.lit(sums["documents"]))
    m = (F.call_function("div", above, wide(F.lit(max(1, sums["terms"])))) + FLAT).cast("bigint")
    keyed = counted.withColumn("m", m)
    # One row per stratum: how many parts of about BLOCK_TERMS occurrences its documents make.
    parts = F.greatest(F.lit(1), F.ceil(F.sum("n") / BLOCK_TERMS)).alias("parts")
    strata = materialize(keyed.groupBy("m").agg(parts), "strata")
    part = F.pmod(F.xxhash64("row"), F.col("parts")).alias("part")
    placed = keyed.join(strata, "m").select("m", part, F.col("key").alias("doc_id"), "n", "terms", "tfs")
    dealt = placed.repartition(partitions(docs), "m", "part").sortWithinPartitions("m", "part")
    blocks = dealt.mapInArrow(_blocks, BLOCK_SCHEMA)
    return LengthIndex(materialize(blocks, "index"), sums["documents"], sums["terms"])


@dataclass
class _Queries:
    """The items of one pass: numbers of their terms, ascending by item, and the weights of these."""

    keys: np.ndarray
    edges: np.ndarray
    terms: np.ndarray
    weights: np.ndarray
    numbers: dict[bytes, int]
    exact: bool


def _document_counts(numbers: dict[bytes, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(numbers), np.int64)
        for batch in batches:
            dfs = batch.column(1)
            for i, terms in enumerate(batch.column(0).to_pylist()):
                places = [(numbers[t], k) for k, t in enumerate(terms.split(b" ")) if t in numbers]
                if places:
                    number, place = np.array(places).T
                    df[number] += dfs[i].values.to_numpy()[place]
        seen = np.flatnonzero(df)
        yield pa.record_batch([pa.array(seen), pa.array(df[seen])], names=["term", "df"])

    return run


class _HeldBlock:
    """The postings of query terms in a block, with the impact of each: worked out once per frequency."""

    def __init__(self, row: dict, numbers: dict[bytes, int]):
        terms = row["terms"].split(b" ")
        number = np.array([numbers.get(t, -1) for t in terms])
        runs, run_tf, run_size = row["runs"], row["run_tf"].astype(np.int64), row["run_size"]
        run_number = np.repeat(number, runs)
        wanted = run_number >= 0
        tfs, which = np.unique(run_tf, return_inverse=True)
        impacts = SCALE * tfs // (TF_PART * tfs + M_PART * row["m"])
        run_impact = impacts[which]
        self.docs = row["docs"][np.repeat(wanted, run_size)]
        self.impacts = np.repeat(run_impact[wanted], run_size[wanted])
        size = np.bincount(np.repeat(np.arange(len(terms)), runs), run_size).astype(np.int64)
        last_run = np.cumsum(runs) - 1  # runs ascend by tf, so the last has the largest impact
        present = np.flatnonzero(number >= 0)
        starts = np.cumsum(size[present]) - size[present]
        order = np.argsort(number[present])
        self.present, self.starts, self.sizes = number[present][order], starts[order], size[present][order]
        self.most = run_impact[last_run[present]][order]
        self.doc_ids = row["doc_ids"]

    def found(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.present, terms)
        at[at == len(self.present)] = 0
        return at, self.present[at] == terms

    def bounds(self, queries: _Queries) -> np.ndarray:
        """No document of the block can score more."""
        if not len(self.present):
            return np.zeros(len(queries.keys), np.int64)
        at, hit = self.found(queries.terms)
        return np.add.reduceat(np.where(hit, self.most[at] * queries.weights, 0), queries.edges[:-1])

    def scores(self, terms: np.ndarray, weights: np.ndarray, exact: bool) -> np.ndarray:
        at, hit = self.found(terms)
        at, weights = at[hit], weights[hit]
        sizes = self.sizes[at]
        place = np.arange(sizes.sum()) + np.repeat(self.starts[at] - (np.cumsum(sizes) - sizes), sizes)
        docs, parts = self.docs[place], self.impacts[place] * np.repeat(weights, sizes)
        if exact:  # whole numbers below 2^53 are summed without loss
            return np.bincount(docs, parts, minlength=len(self.doc_ids)).astype(np.int64)
        found = np.zeros(len(self.doc_ids), np.int64)
        np.add.at(found, docs, parts)
        return found


class _Best:
    """The first rows of one item so far: by score descending, then doc_id ascending, null last."""

    def __init__(self, top: int):
        self.top, self.least = top, 1
        self.rows: list[tuple[int, bool, int]] = []

    def add(self, scores: np.ndarray, doc_ids: list[int | None]) -> None:
        places = np.flatnonzero(scores >= self.least)
        if len(places) > 4 * self.top:  # all that tie with the last one stay for the order by doc_id
            edge = np.partition(scores[places], len(places) - self.top)[len(places) - self.top]
            places = places[scores[places] >= edge]
        if len(places):
            more = [(-int(scores[i]), doc_ids[i] is None, doc_ids[i] or 0) for i in places]
            self.rows = sorted(self.rows + more)[: self.top]
            if len(self.rows) == self.top:
                self.least = -self.rows[-1][0]


def _visits(shared, top: int):
    """(item, doc_id, score): the first rows of every item among the blocks of a task.

    The blocks that a task holds are visited by descending bound, item by item, and only while the
    bound reaches the score of the last row that would be returned.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries: _Queries = shared.value
        best = [_Best(top) for _ in queries.keys]
        held: list[_HeldBlock] = []

        def visit():
            bounds = np.stack([b.bounds(queries) for b in held])
            order = np.argsort(-bounds, axis=0, kind="stable")
            for i, mine in enumerate(best):
                terms, weights = (a[queries.edges[i] : queries.edges[i + 1]] for a in (queries.terms, queries.weights))
                for at in order[:, i]:
                    if bounds[at, i] < mine.least:
                        break
                    mine.add(held[at].scores(terms, weights, queries.exact), held[at].doc_ids)
            held.clear()

        postings = 0
        for batch in batches:
            lists = {n: batch.column(n) for n in _BLOCK_NAMES}
            for i in range(batch.num_rows):
                row = {n: lists[n][i].values.to_numpy() for n in ("runs", "run_tf", "run_size", "docs")}
                row |= {n: lists[n][i].as_py() for n in ("m", "terms", "doc_ids")}
                held.append(_HeldBlock(row, queries.numbers))
                postings += len(held[-1].docs) + len(held[-1].doc_ids)
                if postings > HELD_POSTINGS:
                    visit()
                    postings = 0
        if held:
            visit()
        rows = [(int(key), None if null else doc_id, -score) for key, b in zip(queries.keys, best, strict=True) for score, null, doc_id in b.rows]
        columns = list(zip(*rows, strict=True)) or [()] * 3
        yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=["item", "doc_id", "score"])

    return run


def _queries(rows: list, index: LengthIndex) -> _Queries:
    """The queries of one pass with the weights of their terms."""
    numbers: dict[bytes, int] = {}
    terms = [[numbers.setdefault(t, len(numbers)) for t in r["terms"].split(b" ")] for r in rows]
    counts = index.blocks.select("terms", "dfs").mapInArrow(_document_counts(numbers), "term bigint, df bigint")
    df = dict(counts.groupBy("term").agg(F.sum("df")).collect())  # as many rows as the pass has terms
    above = 2 * index.documents + 2
    weight = np.array([math.floor(1000 * math.log(above / (2 * df.get(j, 0) + 1))) for j in range(len(numbers))], np.int64)
    flat = np.array([t for ts in terms for t in ts])
    times = np.concatenate([np.frombuffer(r["tfs"], "<i8") for r in rows])
    edges = np.cumsum([0, *map(len, terms)])
    weights = weight[flat] * times
    exact = int(np.add.reduceat(weights, edges[:-1]).max()) * (SCALE // TF_PART) < 1 << 53
    return _Queries(np.array([r["item"] for r in rows]), edges, flat, weights, numbers, exact)


def search(index: LengthIndex, items: DataFrame, item_id: str = "item_id", text: str = "text", top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` best documents of every item, those with a score above 0.

    Queries go in passes of bounded size against the whole index.  Null and empty item texts find
    nothing.  Items with one id are queries of their own, each with its own ranks.  Equal scores are
    ordered by doc_id, null ids last; repeated rows of documents take a rank each.  An empty index or
    table of items gives no rows.
    """
    spark = items.sparkSession
    ids = items.select(F.col(f"`{item_id}`").alias("item_id"), F.col(f"`{text}`").cast("string").alias("text"))
    ids = materialize(ids.withColumn("item", F.monotonically_increasing_id()), "items")
    split = ids.select("item", "text").mapInArrow(_counted, "key bigint, n bigint, distinct bigint, terms binary, tfs binary")
    split = split.filter("n > 0").select(F.col("key").alias("item"), F.greatest("distinct", F.lit(ITEM_TERMS)).alias("weight"), "terms", "tfs")
    numbered = prefix_sums(split, [], ["item"], {"before": "weight"}, "queries")
    passes = materialize(numbered.withColumn("pass", F.floor(F.col("before") / PASS_TERMS)), "passes")
    count = -1 if not index.documents else passes.agg(F.max("pass")).first()[0]
    found = spark.createDataFrame([], "item bigint, doc_id bigint, score bigint")
    for number in range(-1 if count is None else count + 1):
        rows = passes.filter(F.col("pass") == number).select("item", "terms", "tfs").collect()  # PASS_TERMS and one item at most
        if not rows:
            continue  # one long item covered this pass too
        shared = spark.sparkContext.broadcast(_queries(rows, index))
        firsts = index.blocks.mapInArrow(_visits(shared, top), "item bigint, doc_id bigint, score bigint")
        found = found.unionByName(materialize(firsts, "firsts"))
        shared.destroy()
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.join(ids.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def op11_search(spark, folder):
    return search(build_index(table(spark, folder, "documents")), table(spark, folder, "benchmark"))


OP11_SQL = r"""
WITH t AS (
  SELECT r, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS r, doc_id, text FROM documents)
), c AS (SELECT r, doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
s AS (SELECT r, sum(tf)::BIGINT AS n FROM c GROUP BY r),
g AS (SELECT count(*) AS docs, sum(n)::BIGINT AS l FROM s),
m AS (SELECT r, 100 - 25 + (25 * n * docs) // l AS m FROM s, g),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM c, g GROUP BY term, docs),
q AS (
  SELECT i, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                               '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS i, item_id, text FROM benchmark)
), k AS (SELECT i, item_id, term, count(*) AS times FROM q GROUP BY ALL),
x AS (
  SELECT i, item_id, r, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
  FROM k JOIN c USING (term) JOIN m USING (r) JOIN w USING (term) GROUP BY ALL HAVING score > 0
), o AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS rank FROM x)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM o WHERE rank <= 20
"""
