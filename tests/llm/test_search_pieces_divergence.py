"""Ranked search, merge-type encoding and the source audit against brute force, with odd input."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import types as T

from moneytrail.llm import divergence, pieces, search

SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType())]
    + [T.StructField(c, T.StringType()) for c in ("text", "lang", "source", "item", "term", "count", "rank", "key", "n", "row", "ids", "m", "value")]
)


def frame(spark, rows):
    return spark.createDataFrame([(*r, *["x"] * 10) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(8)
    common = ["the", "of", "Straße", "naïve", "日本", "x9", "Zed", "zed", "tail"]
    rare = ["".join(r.choice("abcdefgh") for _ in range(r.randrange(1, 30))) for _ in range(60)]
    made = []
    for i in range(160):
        words = [r.choice(common if r.random() < 0.7 else rare) for _ in range(r.choice([1, 3, 3, 3, 8, 40, 200]))]
        made.append((i, r.choice([" ", "-", "\n", "\x00", " "]).join(words), r.choice(["en", "de", None]), r.choice(["a", "b", "ß", None])))
    made += [(200, None, "en", "a"), (201, "", None, "empty"), (202, "1 2 3 !", "fr", "only"), (203, "one two", "fr", "other"), (None, "the Zed", "en", None)]
    made += [(204, "the " * 70_000 + "tail", "en", "long"), (205, "y" * 5000, "de", "a"), (206, "y" * 5000, "de", "b"), (207, "y" * 5000 + " y", "de", "b")]
    return made + [made[3], made[3], made[7]]


# --- search ---------------------------------------------------------------------------------------


def found_terms(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def best_rows(docs, items, top):
    held = [(i, Counter(found_terms(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    total = sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    want = []
    for item, text in items:
        scored = []
        for doc_id, c in held:
            m = 75 + 25 * sum(c.values()) * len(held) // total
            score = 0
            for t in found_terms(text):
                if c[t]:
                    score += math.floor(1000 * math.log((2 * len(held) + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m))
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0))
        want += [(item, k + 1, None if null else i, -s) for k, (s, null, i) in enumerate(sorted(scored)[:top])]
    return sorted(want, key=repr)


@pytest.mark.parametrize("bounds", [{}, {"BLOCK_TERMS": 50, "HELD_POSTINGS": 30, "PASS_TERMS": 512}])
def test_search(spark, rows, monkeypatch, bounds):
    for name, value in bounds.items():
        monkeypatch.setattr(search, name, value)
    items = [(1, "the zed of THE naïve"), (2, None), (3, ""), (4, "nothing-here"), (5, "日本 x9"), (5, "tail"), (6, " ".join(r[1] or "" for r in rows[:30]))]
    index = search.build_index(frame(spark, [(*r[:2], *r[2:]) for r in rows]))
    table = spark.createDataFrame([(*i, 1, 2) for i in items], "item_id bigint, text string, item bigint, rank bigint")
    got = [tuple(r) for r in search.search(index, table, top=7).select("item_id", "rank", "doc_id", "score").collect()]
    assert sorted(got, key=repr) == best_rows([r[:2] for r in rows], items, 7)
    assert index.documents == sum(bool(found_terms(r[1])) for r in rows)


def test_search_keeps_sums_beyond_doubles(spark):
    docs = [(1, "a b"), (2, "a a a c"), (3, "c")]
    items = [(1, "a " * 500_000 + "b"), (2, "c a")]
    index = search.build_index(spark.createDataFrame(docs, "doc_id int, text string"))
    got = search.search(index, spark.createDataFrame(items, "item_id bigint, text string")).select("item_id", "rank", "doc_id", "score")
    assert sorted((tuple(r) for r in got.collect()), key=repr) == best_rows(docs, items, 20)
    exact = search._queries([_item("a " * 500_000_000)], index).exact
    assert not exact


def _item(text):
    counted = Counter(search.terms_of(text[:4]))
    times = np.full(len(counted), len(text) // 2, "<i8")
    return {"item": 0, "terms": b" ".join(counted), "tfs": times.tobytes()}


def test_search_of_nothing(spark):
    none = search.build_index(frame(spark, []))
    items = spark.createDataFrame([(1, "a")], "item_id bigint, text string")
    assert search.search(none, items).count() == 0
    some = search.build_index(frame(spark, [(1, "a", "x", "y")]))
    assert search.search(some, items.limit(0)).count() == 0


# --- pieces ---------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=pieces.model_bytes())


@pytest.fixture(scope="module")
def piece_tables():
    return pieces.piece_tables(pieces.model_bytes())


def texts(r):
    parts = ["a", "the", "ing", " ", "  ", " " * 17, "▁", "\n", "\t", "é", "é", "日本", "😀", "\x00", "n't", "00", "ａ", "ﬁ", "==", "-----", "aaaa", "<s>", "<0x0A>", "​", "."]
    return "".join(r.choice(parts) for _ in range(r.randrange(40)))


def test_pieces_equal_the_library(library, piece_tables, monkeypatch):
    encoder, decoder, r = pieces.PieceEncoder(piece_tables), pieces.PieceDecoder(piece_tables), random.Random(5)
    made = ["", " ", *[texts(r) for _ in range(3000)], "".join(r.choice("abcdefgetaoin") for _ in range(50_000)), "a" * 20_000 + " " * 20_001]
    monkeypatch.setattr(pieces, "REMEMBERED_PAIRS", 50)
    monkeypatch.setattr(pieces, "REMEMBERED_CHUNKS", 50)
    monkeypatch.setattr(pieces, "PART_CHARACTERS", 13)
    for text in made:
        want = library.encode(text, add_bos=True, add_eos=True)
        ids = encoder.encode(text)
        assert ids == np.array(want, "<u4").tobytes()
        assert decoder.decode(ids) == library.decode(want)
    for _ in range(3000):  # any ids, not only those that encoding gives
        ids = [r.choice([r.randrange(300), r.randrange(32_000), r.randrange(3, 259)]) for _ in range(r.randrange(8))]
        assert decoder.decode(np.array(ids, "<u4").tobytes()) == library.decode(ids)


def test_backtracking_equals_the_definition(piece_tables):
    encoder, r = pieces.PieceEncoder(piece_tables), random.Random(6)
    for _ in range(800):
        chunk = "".join(r.choice("▁abehinrst.,'0") for _ in range(r.randrange(1, 25)))
        assert [piece_tables.symbols[s] for s in encoder.backtrack(chunk)] == pieces.merged(chunk, piece_tables.ranks)


def test_piece_tables_of_documents(spark, rows, library):
    model = pieces.model_bytes()
    encoded = pieces.encode_documents(frame(spark, rows), model)
    got = sorted((repr(r["doc_id"]), bytes(r["ids"]), r["text"]) for r in pieces.decode_documents(encoded, model).collect())
    want = []
    for doc_id, text, *_ in rows:
        ids = library.encode(text or "", add_bos=True, add_eos=True)
        want.append((repr(doc_id), np.array(ids, "<u4").tobytes(), library.decode(ids)))
    assert got == sorted(want)
    assert pieces.encode_documents(frame(spark, []), model).count() == 0


def test_pieces_query(spark, library):
    folder = "/root/testdata/sf0.001"
    got = {r["doc_id"]: r for r in pieces.op12_pieces(spark, folder).collect()}
    for doc_id, text in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect():
        ids = library.encode(text or "", add_bos=True, add_eos=True)
        row = got[doc_id]
        assert row["n_tokens"] == len(ids) and row["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()


# --- source audit ---------------------------------------------------------------------------------


def audited(rows, least, ranks):
    docs = []
    for _, text, lang, source in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        docs.append((lang or "", source or "", Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low))))
    want = []
    for lang in {d[0] for d in docs}:
        df = Counter(t for g, _, c in docs if g == lang for t in c)
        kept = [t for t, n in df.items() if n >= least]
        groups = defaultdict(Counter)
        for g, source, c in docs:
            if g == lang:
                groups[source].update({t: c[t] for t in kept if c[t]})
        size = {s: sum(c.values()) for s, c in groups.items()}
        whole = sum(groups.values(), Counter())
        share = lambda c, n: 1 + 10**9 * (c + 1) // (n + len(kept))
        for s, c in groups.items():
            pairs, terms = [], []
            for o in groups:
                if o != s:
                    f = [(share(c[t], size[s]), share(groups[o][t], size[o])) for t in kept]
                    pairs.append((-sum((p - q) ** 2 // q for p, q in f), o.encode(), o))
            for t in kept:
                p, q = share(c[t], size[s]), share(whole[t], sum(size.values()))
                if c[t] and p > q:
                    terms.append((-((p - q) ** 2 // q), t.encode(), t))
            want += [(lang, s, "pair", o, -v, k + 1) for k, (v, _, o) in enumerate(sorted(pairs))]
            want += [(lang, s, "term", t, -v, k + 1) for k, (v, _, t) in enumerate(sorted(terms)[:ranks])]
    return sorted(want)


@pytest.mark.parametrize("settings", [{}, {"FILTER_BITS": 4, "BLOCK_TERMS": 40, "HELD_TERMS": 60, "PROFILES_PER_BLOCK": 3}])
def test_source_audit(spark, rows, monkeypatch, settings):
    for name, value in settings.items():
        monkeypatch.setattr(divergence, name, value)
    got = divergence.audit_sources(frame(spark, rows), ranks=9, first_prefix=1)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(tuple(r) for r in got.collect()) == audited(rows, 3, 9)


def test_a_block_sends_a_term_once():
    texts = ["b a a", None, "A c", "c, c b", "", "d"]
    columns = [pa.array(["en"] * 6), pa.array(["x", "x", "y", "y", "z", "x"]), pa.array(texts, pa.string())]
    blocks = list(divergence._blocks(iter([pa.record_batch(columns, names=["lang", "source", "text"])])))
    every = {page: b"\xff" * 4096 for page in range(1 << (divergence.FILTER_BITS - 15))}
    found = [r for b in divergence._term_counts(8, every)(iter(blocks)) for r in b.to_pylist()]
    held = {r["term"]: [(h["source"], h["count"]) for h in r["held"]] for r in found}
    assert len(found) == 4 and held == {b"a": [("x", 2), ("y", 1)], b"b": [("x", 1), ("y", 1)], b"c": [("y", 3)], b"d": [("x", 1)]}
    assert not list(divergence._term_counts(8, {})(iter(blocks)))  # no term goes on


def test_source_audit_of_nothing(spark):
    assert divergence.audit_sources(frame(spark, [])).count() == 0
    alone = divergence.audit_sources(frame(spark, [(1, "once only", "en", "a"), (2, "other words", "en", "b")]))
    assert sorted(tuple(r) for r in alone.collect()) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


def test_shares_are_exact():
    r = random.Random(2)
    for _ in range(2000):
        total = r.randrange(1, 9 * 10**15)
        count = r.randrange(total)
        assert divergence.shares(np.array([count]), np.array([total]))[0] == 1 + 10**9 * (count + 1) // total
