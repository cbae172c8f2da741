"""How the sources of a language differ in their terms: kept terms by iceberg prefix refinement, exact sums."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import partitions, table

# Documents that a kept term (and so each of its prefixes) occurs in at least.
LEAST_DOCUMENTS = 3
# Bytes of the first prefix, and how many times longer they get with each level.
FIRST_PREFIX, GROWTH = 8, 4
# Prefixes that go on are told to the tasks by a table of so many bits (8 MB) at every size of the corpus:
# two prefixes may share a bit, then one too many goes on; a level never loses one that should.
FILTER_BITS = 26
TERM_RANKS = 200
# Terms of documents, repeats counted, in a block of one lang and in all open blocks of a task.
BLOCK_TERMS = 1 << 19
HELD_TERMS = 1 << 21
PROFILES_PER_BLOCK = 2048
END = b"\0"  # closes a whole term; no term holds it

# Bytes of terms stay, with A-Z in lower case; all others part terms.
_TERM_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256)
)


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TERM_BYTES).split()


class _Numbers(dict):
    """Terms to numbers from 0 on, in the order in which they are first asked for."""

    def __missing__(self, term: bytes) -> int:
        found = self[term] = len(self)
        return found


class _Gathered:
    """Documents of one lang that come together in a task, with one dictionary of their terms."""

    def __init__(self, lang: str):
        self.lang, self.numbers, self.held = lang, _Numbers(), 0
        self.sources, self.parts = [], []

    def add(self, source: str, terms: list[bytes]) -> int:
        """How much more is held."""
        self.sources.append(source)
        self.parts.append(np.fromiter(map(self.numbers.__getitem__, terms), np.int32, len(terms)))
        self.held += len(terms) + 1
        return len(terms) + 1

    def row(self) -> pa.RecordBatch:
        # Terms of all documents are counted by one sort of (document, term).
        width = max(1, len(self.numbers))
        key = np.repeat(np.arange(len(self.parts)) * width, [len(p) for p in self.parts]) + np.concatenate(self.parts)
        key.sort()
        first = _firsts(key)
        document, term = np.divmod(key[first], width)
        counts = np.diff(first, append=len(key))
        sizes = np.bincount(document, minlength=len(self.parts)).tolist()
        columns = [
            pa.array([self.lang], pa.string()), pa.array([self.sources], pa.list_(pa.string())),
            pa.array([sizes], pa.list_(pa.int32())), pa.array([b" ".join(self.numbers)], pa.binary()),
            pa.array([term.astype("<i4").tobytes()], pa.binary()), pa.array([counts.astype("<i4").tobytes()], pa.binary()),
        ]
        return pa.record_batch(columns, names=["lang", "sources", "sizes", "dictionary", "terms", "counts"])


def _firsts(values: np.ndarray) -> np.ndarray:
    """Where each run of equal values starts."""
    return np.flatnonzero(np.concatenate([np.ones(min(1, len(values)), bool), values[1:] != values[:-1]]))


BLOCK_SCHEMA = "lang string, sources array<string>, sizes array<int>, dictionary binary, terms binary, counts binary"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, text) to blocks of documents of one lang: their distinct terms by number, and how often each occurs."""
    open_blocks: dict[str, _Gathered] = {}
    held = 0
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            for lang, source, text in zip(*[c.to_pylist() for c in batch.slice(at, 512).columns], strict=True):
                block = open_blocks.get(lang)
                if block is None:
                    block = open_blocks[lang] = _Gathered(lang)
                held += block.add(source, terms_of(text))
                if block.held > BLOCK_TERMS:
                    held -= block.held
                    yield open_blocks.pop(lang).row()
            if held > HELD_TERMS:  # many langs with a few documents each
                yield from [b.row() for b in open_blocks.values()]
                open_blocks, held = {}, 0
    yield from [b.row() for b in open_blocks.values()]


def _open_prefixes(lang: str, terms: list[bytes], length: int, before: int, pages: dict[int, bytes] | None) -> list[bytes | None]:
    """The first ``length`` bytes of each term, None where the level before dropped it.

    ``pages`` are the bits of the prefixes of ``before`` bytes that went on; without them all do.
    """
    whole = [t + END for t in terms]
    if pages is None:
        return [w[:length] for w in whole]
    seed, mask, none, found = zlib.crc32(lang.encode() + END), (1 << FILTER_BITS) - 1, bytes(4096), []
    for w in whole:
        slot = zlib.crc32(w[:before], seed) & mask
        found.append(w[:length] if pages.get(slot >> 15, none)[(slot & 32767) >> 3] >> (slot & 7) & 1 else None)
    return found


def _prefix_counts(length: int, before: int, pages: dict[int, bytes] | None):
    """(lang, prefix, documents): every document counts once for each of its prefixes that are still open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, sizes, dictionary, terms in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                numbers: dict[bytes, int] = {}
                opened = _open_prefixes(lang, dictionary.split(), length, before, pages)
                number = np.array([-1 if p is None else numbers.setdefault(p, len(numbers)) for p in opened], np.int64)
                if not numbers:
                    continue
                prefix = number[np.frombuffer(terms, "<i4")]
                document = np.repeat(np.arange(len(sizes)), sizes)
                pairs = np.unique((document * len(numbers) + prefix)[prefix >= 0])
                counts = np.bincount(pairs % len(numbers), minlength=len(numbers))
                columns = [pa.array([lang] * len(numbers), pa.string()), pa.array(list(numbers), pa.binary()), pa.array(counts)]
                yield pa.record_batch(columns, names=["lang", "prefix", "documents"])

    return run


def _term_counts(before: int, pages: dict[int, bytes]):
    """(lang, term, held) of the terms whose prefixes went on to the end; held: (source, count) of each source of a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, sources, sizes, dictionary, terms, counts in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                split = dictionary.split()
                if not split:
                    continue
                live = np.array([p is not None for p in _open_prefixes(lang, split, 1, before, pages)])
                names, source = np.unique(np.array(sources, object), return_inverse=True)
                term = np.frombuffer(terms, "<i4")
                kept = live[term]
                key = (term.astype(np.int64) * len(names) + np.repeat(source, sizes))[kept]
                if not len(key):
                    continue
                order = np.argsort(key)
                key = key[order]
                first = _firsts(key)
                sums = np.add.reduceat(np.frombuffer(counts, "<i4")[kept][order].astype(np.int64), first)
                term, source = np.divmod(key[first], len(names))
                each = _firsts(term)
                held = pa.StructArray.from_arrays([pa.array(names, pa.string()).take(pa.array(source)), pa.array(sums)], ["source", "count"])
                columns = [
                    pa.array([lang] * len(each), pa.string()), pa.array(split, pa.binary()).take(pa.array(term[each])),
                    pa.ListArray.from_arrays(pa.array(np.append(each, len(term)), pa.int32()), held),
                ]
                yield pa.record_batch(columns, names=["lang", "term", "held"])

    return run


def _filter_pages(prefixes: DataFrame) -> dict[int, bytes]:
    """The bits of prefixes that go on: at most 2^FILTER_BITS / 8 bytes, whatever their number."""
    seeded = F.concat(F.col("lang").cast("binary"), F.lit(bytearray(END)), F.col("prefix"))
    slot = F.crc32(seeded).bitwiseAND((1 << FILTER_BITS) - 1)
    # Bit numbers of bitmaps count from one on.
    bits = prefixes.select((slot + 1).alias("slot")).groupBy(F.bitmap_bucket_number("slot").alias("page"))
    found = bits.agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits")).collect()
    return {r["page"] - 1: bytes(r["bits"]) for r in found}


def kept_terms(documents: DataFrame, least: int = LEAST_DOCUMENTS, first_prefix: int = FIRST_PREFIX) -> DataFrame:
    """(lang, term, held) of all terms in at least ``least`` documents of their lang; held: (source, count) of each source.

    ``documents`` has rows as ``_blocks`` makes them.  Level by level, prefixes of ``GROWTH`` times as many
    bytes are counted by distinct documents, and those below ``least`` are dropped with all that starts
    with them, until every prefix that is left is a whole term.
    """
    pages, before, length = None, 0, first_prefix
    while True:
        counted = documents.select("lang", "sizes", "dictionary", "terms").mapInArrow(
            _prefix_counts(length, before, pages), "lang string, prefix binary, documents bigint"
        )
        summed = counted.groupBy("lang", "prefix").agg(F.sum("documents").alias("documents"))
        prefixes = materialize(summed.filter(F.col("documents") >= least).select("lang", "prefix"), "prefixes")
        pages, before = _filter_pages(prefixes), length
        if prefixes.filter(F.substring("prefix", -1, 1) != F.lit(bytearray(END))).isEmpty():
            break
        length *= GROWTH
    # Only whole terms are left, each in enough documents; some more share their bits and go in the join.
    kept = prefixes.select("lang", F.expr("substring(prefix, 1, octet_length(prefix) - 1)").alias("term"))
    counted = documents.mapInArrow(_term_counts(before, pages), "lang string, term binary, held array<struct<source:string,count:bigint>>")
    # One shuffle, by term, serves both sums and the join; a row has what a block holds of a term.
    dealt = counted.repartition(partitions(documents), "lang", "term").select("lang", "term", F.inline("held"))
    summed = dealt.groupBy("lang", "term", "source").agg(F.sum("count").alias("count"))
    sure = summed.join(kept.hint("merge"), ["lang", "term"], "left_semi")
    held = F.array_sort(F.collect_list(F.struct("source", "count"))).alias("held")
    return materialize(sure.groupBy("lang", "term").agg(held), "kept-terms")


def _share(count: Column, total: Column, terms: Column) -> Column:
    """p = 1 + floor(10^9 (count + 1) / (total + terms)), by long division in base 1000 as in ``shares``."""
    over = total + terms
    found, rest = F.call_function("div", count + 1, over), (count + 1) % over
    for _ in range(3):
        found = found * 1000 + F.call_function("div", rest * 1000, over)
        rest = rest * 1000 % over
    return found + 1


def _gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q); p and q are at most 10^9 + 1, so the square fits."""
    return F.call_function("div", (p - q) * (p - q), q)


def shares(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """p by long division in base 1000, exact in 64 bits for ``totals`` below 9 * 10^15."""
    found, rest = np.divmod(counts + 1, totals)
    for _ in range(3):
        more, rest = np.divmod(rest * 1000, totals)
        found = found * 1000 + more
    return 1 + found


def _pair_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, item, value): sums over the terms of the blocks that a task reads, for all pairs of sources.

    Rows: lang, sources, totals (count sums plus kept terms), profiles; a profile has the sources that
    hold a term, its counts there, and how many terms look like that.
    """
    for batch in batches:
        for lang, sources, totals, profiles in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            size, totals = len(sources), np.array(totals, np.int64)
            place = {s: i for i, s in enumerate(sources)}
            sums = np.zeros((size, size), np.int64)
            step = max(1, (1 << 20) // (size * size))
            for at in range(0, len(profiles), step):
                part = profiles[at : at + step]
                counts, weights = np.zeros((len(part), size), np.int64), np.array([p["terms"] for p in part])
                for row, p in zip(counts, part, strict=True):
                    row[[place[s] for s in p["sources"]]] = p["counts"]
                p = shares(counts, totals)
                gap = p[:, :, None] - p[:, None, :]
                sums += (gap * gap // p[:, None, :] * weights[:, None, None]).sum(axis=0)
            a, b = np.nonzero(~np.eye(size, dtype=bool))
            columns = [[lang] * len(a), [sources[i] for i in a], [sources[i] for i in b]]
            arrays = [*(pa.array(c, pa.string()) for c in columns), pa.array(sums[a, b])]
            yield pa.record_batch(arrays, names=["lang", "source", "item", "value"])


def _pairs(kept: DataFrame, groups: DataFrame, sizes: DataFrame) -> DataFrame:
    """(lang, source, item, value) of all pairs of sources of a lang.

    Terms with equal counts in all sources are one profile.  Its arrays have at most as many places as
    the lang has sources, and the result has a row for each two of them.
    """
    spread = sizes.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", "total"))).alias("all")).select(
        "lang", F.col("all.source").alias("sources"), F.col("all.total").alias("totals")
    )
    spread = materialize(spread, "langs")
    profiles = materialize(kept.groupBy("lang", "held").agg(F.count(F.lit(1)).alias("terms")), "profiles")
    blocks = max(1, profiles.count() // PROFILES_PER_BLOCK)
    shape = F.struct(F.col("held.source").alias("sources"), F.col("held.count").alias("counts"), "terms")
    block = F.pmod(F.xxhash64("held"), F.lit(blocks))
    dealt = profiles.groupBy("lang", block.alias("block")).agg(F.collect_list(shape).alias("profiles"))
    summed = dealt.join(spread, "lang").select("lang", "sources", "totals", "profiles").mapInArrow(
        _pair_sums, "lang string, source string, item string, value bigint"
    )
    found = summed.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    other = groups.select("lang", F.col("source").alias("item"))  # langs without kept terms have pairs too
    every = groups.join(other, "lang").filter(F.col("source") != F.col("item"))
    joined = every.join(found, ["lang", "source", "item"], "left")
    return joined.select("lang", "source", "item", F.coalesce("value", F.lit(0)).cast("bigint").alias("value"))


def audit_sources(docs: DataFrame, least: int = LEAST_DOCUMENTS, ranks: int = TERM_RANKS, first_prefix: int = FIRST_PREFIX) -> DataFrame:
    """lang, source, part, item, value and rank: how far each source of a lang is from the others and which terms tell.

    Terms are runs of letters and of characters beyond ASCII; a lang keeps those in at least ``least``
    of its documents (rows).  Part ``pair`` has every other source of the lang, with the gap summed over
    all kept terms; part ``term`` the terms that a source uses more than its lang does, up to ``ranks``.

    Null texts, langs and sources count as empty; a group without terms has its pairs, and a lang
    without kept terms pairs of value 0.  Repeated rows are documents of their own.  Equal values are
    ordered by the bytes of the item.  An empty table gives no rows.  Other columns are not read.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    plain = docs.select(text("lang"), text("source"), text("text"))
    documents = materialize(plain.mapInArrow(_blocks, BLOCK_SCHEMA), "document-terms")
    groups = documents.select("lang", F.explode(F.array_distinct("sources")).alias("source"))
    groups = materialize(groups.distinct(), "groups")
    kept = kept_terms(documents, least, first_prefix)
    uses = kept.select("lang", "term", F.explode("held").alias("h"), F.aggregate("held.count", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("lang_count"))
    uses = uses.select("lang", "term", F.col("h.source").alias("source"), F.col("h.count").alias("count"), "lang_count")
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"))
    sums = uses.groupBy("lang", "source").agg(F.sum("count").alias("size"))
    sizes = groups.join(langs, "lang").join(sums, ["lang", "source"], "left").withColumn("size", F.coalesce("size", F.lit(0)))
    whole = F.sum("size").over(Window.partitionBy("lang"))
    sizes = materialize(sizes.select("lang", "source", "size", "kept", whole.alias("lang_size")), "sizes")

    pairs = _pairs(kept, groups, sizes.select("lang", "source", (F.col("size") + F.col("kept")).alias("total")))
    p = _share(F.col("count"), F.col("size"), F.col("kept"))
    q = _share(F.col("lang_count"), F.col("lang_size"), F.col("kept"))
    terms = uses.join(sizes, ["lang", "source"]).select("lang", "source", "term", p.alias("p"), q.alias("q"))
    terms = terms.filter(F.col("p") > F.col("q")).select(
        "lang", "source", F.col("term").cast("string").alias("item"), _gap(F.col("p"), F.col("q")).cast("bigint").alias("value")
    )
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    # Each task keeps its own first rows of a group before the shuffle.
    ranked = terms.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= ranks)
    paired = pairs.withColumn("rank", F.row_number().over(order))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    named = lambda df, part: df.withColumn("part", F.lit(part)).select(*columns)
    return named(paired, "pair").unionByName(named(ranked, "term"))


def op13_divergence(spark, folder):
    return audit_sources(table(spark, folder, "documents"))


OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
), g AS (SELECT DISTINCT lang, source FROM d),
x AS (SELECT id, lang, source, unnest(terms) AS term FROM d),
k AS (SELECT lang, term, count(*) AS lang_count FROM x GROUP BY ALL HAVING count(DISTINCT id) >= 3),
v AS (SELECT lang, count(*)::HUGEINT AS v, sum(lang_count)::HUGEINT AS lang_size FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM x SEMI JOIN k USING (lang, term) GROUP BY ALL),
s AS (
  SELECT lang, source, coalesce(sum(n), 0)::HUGEINT AS size FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL
), f AS (
  SELECT k.lang, s.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (s.size + v.v) AS p,
         1 + (1000000000::HUGEINT * (k.lang_count + 1)) // (v.lang_size + v.v) AS q
  FROM k JOIN v USING (lang) JOIN s USING (lang) LEFT JOIN c ON c.lang = k.lang AND c.source = s.source AND c.term = k.term
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM f a JOIN f b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), every AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pairs.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (((p - q) * (p - q)) // q)::BIGINT FROM f WHERE n > 0 AND p > q
), r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM every)
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM r WHERE part = 'pair' OR rank <= 200
"""
