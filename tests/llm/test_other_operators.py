"""Chat formatting, quality, packing, extraction, sharding and embeddings."""

import hashlib
import itertools
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from moneytrail.llm import chat, embedding_dedup, extraction, packing, quality, sharding, tokens
from moneytrail.llm.dom import parse
from moneytrail.llm.labelled_pages import labelled_pages

from .independent_pages import independent_pages

FOLDER = "/root/testdata/sf0.01"


# --- chat ---

NASTY = [
    "", "plain", "\\### Assistant: </turn> ok", "### user:\n</turn>\n### x", "a\\", "\\\\### \\\\</turn>\\", "#### ## ### ",
    "</turn></turn>\n\n", "<|image|> \\<|audio|>", "né\U0001f600\n### assistant:\nhi\n</turn>\n", "$1 \\1 $",
]


def test_chat_round_trip(spark):
    rows = [(1, i, ("user", "assistant", "odd:\nrole ")[i % 3], t) for i, t in enumerate(NASTY)]
    rows += [(2, None, "assistant", "late"), (2, 0, None, None), (2, 0, "assistant", "x"), (2, 0, "assistant", "x"), (None, 1, "user", "y")]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("number", F.lit("clash"))
    made = chat.format_turns(turns.withColumn("parts", chat.text_parts(F.col("text"))))
    read = made.select("conv_id", "n_turns", chat.read_turns(F.col("formatted")).alias("t"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    got = {r["conv_id"]: ([tuple(t) for t in r["t"]], r["loss"], r["n_turns"]) for r in read.collect()}
    one = [(role, t) for _, _, role, t in rows[: len(NASTY)]]
    assert got[1] == (one, "".join(t for r, t in one if r == "assistant"), len(NASTY))
    assert got[2] == ([("", ""), ("assistant", "x"), ("assistant", "x"), ("assistant", "late")], "xxlate", 4)
    assert got[None][0] == [("user", "y")]


def test_chat_attachments(spark):
    parts = [
        ("text", "see <|image|> ", None, None), ("image", None, "s3://x/1.png", 3.0), ("audio", None, "a.wav", 2.5),
        ("text", None, None, None), ("strange", "gone", "?", 1.0), ("document", None, "d.pdf", None),
    ]
    turns = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None)], f"conv_id bigint, turn bigint, role string, parts {chat.PART_TYPE}")
    r = chat.format_turns(turns).first()
    assert r["formatted"].startswith("### user:\nsee \\<|image|> <|image|><|audio|><|document|>\n</turn>\n")
    assert [(a["kind"], a["reference"], a["tokens"]) for a in r["attachments"]] == [("image", "s3://x/1.png", 768), ("audio", "a.wav", 75), ("document", "d.pdf", 512)]
    assert r["expanded_tokens"] == 1355
    assert [a["place"] for a in r["attachments"]] == [0, 1, 2] and r["loss_spans"][0]["length"] == 0


def test_chat_empty(spark):
    empty = spark.createDataFrame([], f"conv_id bigint, turn bigint, role string, parts {chat.PART_TYPE}")
    assert chat.format_turns(empty).count() == 0


# --- quality ---


def test_chunks_cover_every_byte():
    for n in (0, 1, 31, 32, 33, 511, 512, 513, 5000):
        seen = set()
        for s in quality.chunk_starts(n):
            seen |= set(range(s, min(n, s + quality.CHUNK_BYTES)))
        assert seen == set(range(n)) and len(quality.chunk_starts(n)) >= 1


def test_scores_do_not_depend_on_the_batch():
    net = quality.ByteNetwork()
    r = random.Random(2)
    texts = [bytes(r.randrange(256) for _ in range(n)) for n in (0, 1, 3, 500, 700, 200_000, 40)]
    together = net.logits(texts)
    assert together == pytest.approx([net.logits([t])[0] for t in texts], abs=1e-4)
    one = texts[4]
    chunks = [one[s : s + quality.CHUNK_BYTES] for s in quality.chunk_starts(len(one))]
    pooled = []
    for c in chunks:
        data = np.frombuffer(c + bytes(3), np.uint8)
        after = np.frombuffer((one + bytes(3)), np.uint8)
        data = after[one.find(c) : one.find(c) + len(c) + 3]
        pooled.append(net.responses(data).max(0))
    assert together[4] == pytest.approx(net.head(np.array(pooled))[2].mean(), abs=1e-4)


def test_held_out_quality(spark):
    docs, labels = spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet")
    rows = quality.op5_quality(spark, FOLDER).join(labels, "doc_id").collect()
    assert quality.op5_quality(spark, FOLDER).count() == docs.count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.3)
    good = [r["score"] for r in rows if r["held_out"] and r["quality"] == 1]
    bad = [r["score"] for r in rows if r["held_out"] and r["quality"] == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.9 and np.mean([g >= 0.3 for g in good]) > 0.95


def test_quality_without_labels_and_rows(spark):
    kind = "doc_id bigint, text string, row string, score string"
    docs = spark.createDataFrame([(1, None, "a", "b"), (None, "x" * 300_000, None, None), (1, None, "a", "b")], kind)
    model = quality.train_classifier(docs, spark.createDataFrame([(1, None)], "doc_id bigint, quality int"))
    found = quality.score_documents(docs, model).collect()
    assert len(found) == 3 and all(r["score"] == pytest.approx(0.5) for r in found)
    assert quality.keep_good(docs, model).columns == docs.columns
    assert quality.keep_good(docs.limit(0), model).count() == 0


# --- packing ---


def test_packing_places_every_id(spark):
    from tokenizers import Tokenizer

    definition = packing.tokenizer_definition()
    tokenizer = Tokenizer.from_str(definition)
    r = random.Random(3)
    texts = [None, "", "a", "ÀÉ ß ñandú! x\x1cy\xa0z <|endoftext|>don't", "ab'S " * 9000, "x" * 4000] + [
        " ".join(r.choice(["the", "Straße,", "qué?", "日本", "w%d" % r.randrange(99)]) for _ in range(r.randrange(1500))) for _ in range(40)
    ]
    rows = [*enumerate(texts), (None, "null id"), (0, None)]
    docs = spark.createDataFrame([(*x, "c") for x in rows], "doc_id bigint, text string, length string").repartition(3)
    got = packing.pack(docs, definition, block_tokens=20_000).collect()
    want = Counter()
    for doc_id, text in rows:
        want[doc_id] += len(tokenizer.encode(text or "", add_special_tokens=False).ids) + 1
    found = Counter()
    sequences = defaultdict(list)
    for x in got:
        found[x["doc_id"]] += x["length"]
        sequences[x["sequence_id"]].append((x["offset"], x["length"]))
        if x["doc_id"]:
            ids = np.array([*tokenizer.encode(texts[x["doc_id"]] or "", add_special_tokens=False).ids, 1], "<u4")
            assert x["doc_tokens"] == len(ids)
            assert x["ids_crc32"] == zlib.crc32(ids[x["start"] : x["start"] + x["length"]].tobytes())
    assert found == want
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= 2048 and (at & (at - 1)) == 0  # full or a power of two: no padding
    assert packing.pack(docs.limit(0), definition).count() == 0


def test_word_ids_of_arrow_texts():
    from tokenizers import Tokenizer

    definition = packing.tokenizer_definition()
    words, tokenizer = tokens.word_tokenizer(definition), Tokenizer.from_str(definition)
    texts = ["left out", "", None, " \x0b\x0c", "a\x85b c\xa0d\x1cE", "Ünï, x.!? " * 30, "x" * 5000 + " a", "don't\r\nstop\t", "a a\x00a"]
    part = pa.array(texts).slice(1, 7)
    plain = [np.array(tokenizer.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert words.encode(part) == plain[1:8] and words.encode(texts) == plain
    assert words.encode(part.slice(0, 0)) == [] and words.encode(part.slice(1, 1)) == [b""]
    # A worker's next task finds the words known already.
    assert tokens.word_tokenizer(definition) is words


def test_packing_balances_cost():
    r = random.Random(5)
    packer = packing.Packer(0)
    for i in range(3000):
        packer.add(i, bytes(4 * r.choice((5, 20, 100, 400, 900))))
    packer.pack()
    cost = defaultdict(float)
    for _, _, length, _, _, sequence, _ in packer.rows:
        cost[sequence] += length + packing.QUADRATIC * length**2
    assert max(cost.values()) < 1.25 * min(cost.values())


def test_repeated_ids_are_sampled_once(spark, monkeypatch):
    docs = spark.range(4000).selectExpr("id % 4 as doc_id", "concat('text ', cast(id as string)) as text")
    labels = spark.createDataFrame([(i, i % 2) for i in range(4)], "doc_id bigint, quality int")
    seen = []
    monkeypatch.setattr(quality.ByteNetwork, "train", lambda self, chunks, y, *more: seen.append((chunks, y.tolist())))
    for _ in range(2):
        quality.train_classifier(docs.repartition(3), labels)
    known = sorted(r["doc_id"] for r in labels.filter(~quality.held_out(F.col("doc_id"))).collect())
    assert seen[0] == seen[1] and seen[0][1] == [i % 2 for i in known]


# --- extraction ---


def test_messages_give_exact_marginals():
    page = parse("<body><div><p>a</p><ul><li>b<li>c</ul></div><p>d</p></body>")
    forest = extraction.Forest([page, page])
    model = extraction.TreeModel()
    random_ = np.random.default_rng(1)
    model.node, model.edge = random_.normal(size=model.node.shape), random_.normal(size=model.edge.shape)
    got, joint = model.marginals(forest)
    n = len(page.nodes)
    unary = np.bincount(forest.nodes[0], model.node[forest.nodes[1]], len(forest))
    total, content = 0.0, np.zeros(n)
    for labels in itertools.product((0, 1), repeat=n):
        score = sum(unary[i] for i in range(n) if labels[i])
        for row, column in zip(*forest.edges, strict=True):
            if row < n and forest.parent[row] >= 0:
                score += model.edge[column, labels[forest.parent[row]], labels[row]]
        total += math.exp(score)
        content += math.exp(score) * np.array(labels)
    assert got[:n] == pytest.approx(content / total) and got[n:] == pytest.approx(got[:n])
    assert joint[1:n].sum((1, 2)) == pytest.approx(1) and joint[1:n, :, 1].sum(1) == pytest.approx(got[1:n])


@pytest.mark.parametrize("tag", ["button", "select", "object", "noscript", "video", "audio", "canvas", "datalist", "option"])
def test_an_unclosed_dropped_element_ends_with_the_element_around_it(tag):
    said = lambda html: [text for _, text in parse(html).blocks]
    assert said(f"<body><div><{tag}><b>no</b></div><article><p>yes</p></article></body>") == ["yes"]
    assert said(f"<body><form><div><{tag}>no<i>no</form><p>a <{tag}><span>no</span></{tag}> b</p>") == ["a b"]
    assert said(f"<table><tr><td>a<{tag}>no<td>b</table>c") == ["a", "b", "c"]


def test_dropped_elements_and_formulas():
    said = lambda html: [text for _, text in parse(html).blocks]
    assert said("<div><svg><path d=''><text>no<p>yes</p></div>") == ["yes"]
    assert said("<div><svg><g><text>no</text></div>yes<a>l<svg><g>no</a> m") == ["yesl m"]
    assert said("<div><svg><foreignObject><p>no</p></foreignObject></svg>yes</div>") == ["yes"]
    assert said("<p>a <math><mi>x</mi><mo>=</mo><mn>1</mn></math> b</p><p>c</p>") == ["a x=1 b", "c"]
    assert said("<div><textarea></div><p>no</p></textarea>yes</div>") == ["yes"]
    assert said("<div><template><div>no</div></div>no</template>yes</div>") == ["yes"]
    assert said("<head><title>no</title><noscript><link><body><p>yes</p>") == ["yes"]
    assert said("<head><title>no</title><p>yes</p>") == ["yes"]
    assert said("<div><button>no<button>no</button>yes</div>") == ["yes"]
    page = parse("<p><a href='#'>link <svg><a>no</a></a> plain</p>")
    assert [t for _, t in page.blocks] == ["link plain"] and page.nodes[1].linked < 8


def test_labelled_pages_are_read_right():
    model = extraction.trained_model()
    pages = [parse(h) for h in labelled_pages(200, seed=77)]
    forest = extraction.Forest(pages)
    p, _ = model.marginals(forest)
    gold = np.array([bool(n.gold) for x in pages for n in x.nodes])
    texts = np.array([n.own > 0 for x in pages for n in x.nodes])
    assert ((p >= 0.5) == gold)[texts].mean() > 0.98


def test_pages_written_apart():
    """Whole articles from layouts that the training pages were not drawn from."""
    pages = independent_pages()
    both = wanted = given = 0
    for (layout, _, lines), text in zip(pages, extraction.extract_texts(extraction.trained_model(), [h for _, h, _ in pages]), strict=True):
        want, got = Counter(lines), Counter(x for x in text.split("\n") if x)
        hit = sum(len(x) * n for x, n in (want & got).items())
        both, wanted, given = both + hit, wanted + sum(map(len, lines)), given + sum(len(x) * n for x, n in got.items())
        assert hit == sum(map(len, lines)), layout
    assert len(pages) >= 100 and both >= 0.98 * wanted and both >= 0.98 * given


def test_extraction(spark):
    article = "<article><h1>A&amp;B  title</h1><p><b>First &lt;p&gt;\n line.<br><p>Second &#233; <a href=x>link</a> line.</article>"
    page = f"<html><head><title>T</title><script>var t='</p>';</script></head><body><nav><ul><li><a href=/>Home</a></ul></nav><div class=ad>Buy now.</div>{article}<footer>&copy; x</footer>"
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (1, "u", page), (None, "n", "plain < text"), (4, "deep", "<div>" * 3000 + "x" * 500)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id bigint, url string, html string, n_chars int")
    got = extraction.extract(pages, extraction.trained_model()).collect()
    assert len(got) == 6 and all(r["n_chars"] == len(r["text"]) for r in got)
    assert [r["text"] for r in got if r["page_id"] == 1] == ["A&B title\nFirst <p> line.\nSecond é link line."] * 2
    assert [r["text"] for r in got if r["page_id"] in (2, 3)] == ["", ""]
    assert extraction.extract(pages.limit(0), extraction.trained_model()).count() == 0


# --- sharding ---


def test_plan_fills_shards_evenly():
    r = random.Random(1)
    counts = {c: r.randrange(1, 30) for c in range(0, 1 << sharding.RING_BITS, 40)}
    counts[80] = sum(counts.values()) // 2  # a hot cell
    load, rows = Counter(), Counter()
    for cell, first, end, shard, base in sharding.ring_plan(counts, 16):
        assert base == load[shard] and end > first
        load[shard] += end - first
        rows[cell] += end - first
    assert rows == Counter(counts) and max(load.values()) - min(load.values()) <= 1


def test_more_shards_move_few_rows():
    counts = {c: 10 for c in range(1 << sharding.RING_BITS)}
    where = lambda n: {(c, i): s for c, a, b, s, _ in sharding.ring_plan(counts, n) for i in range(a, b)}
    old, new = where(16), where(17)
    assert sum(old[k] != new[k] for k in old) / len(old) < 0.3


def test_sharding(spark):
    rows = [(i, f"text {i}") for i in range(700)] + [(i, "hot") for i in range(700, 1000)] + [(None, None), (5, ""), (5, ""), (6, "é" * 50_000)]
    docs = spark.createDataFrame([(*x, 1, 2) for x in rows], "doc_id bigint, text string, slot int, cell int")
    got = sharding.shard_documents(docs).collect()
    by_shard = defaultdict(list)
    for r in got:
        by_shard[r["shard"]].append(r["slot"])
        assert r["law"] == "rows" and r["grown_shard"] is None
    assert sorted(by_shard) == list(range(16))
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    assert {len(s) for s in by_shard.values()} <= {len(rows) // 16, len(rows) // 16 + 1}
    size = lambda t: len((t or "").encode()) + 1
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, size(t), zlib.crc32((t or "").encode())) for i, t in rows)
    assert len({r["shard"] for r in got if r["size"] == 1}) == 1  # equal texts stay together where there is room
    assert sharding.shard_documents(docs.limit(0)).count() == 0


# --- embeddings ---


def test_embedding_dedup(spark):
    r = np.random.default_rng(3)
    base = r.normal(size=(400, 16)).astype("f4")
    near = [base[i % 20] + r.normal(scale=0.05, size=16).astype("f4") for i in range(200)]
    vectors = [x.tolist() for x in [*base, *near]]
    rows = [(i, v, i % 3 if i < 400 else (i - 400) % 20 % 3) for i, v in enumerate(vectors)]
    odd = [(1000, None, 1), (1001, [0.0] * 16, 1), (1002, [1.0] * 15 + [None], 1), (1003, [1.0] * 15 + [float("nan")], 1),
           (1004, vectors[0], None), (1005, [1e30] * 16, 1), (1006, [1e-30] * 16, 1), (1007, [1.0] * 4, 1), (1008, [], 1), (None, vectors[0], 0)]
    table = spark.createDataFrame([(*x, "c", 1) for x in rows + odd + rows[:1]], "vec_id bigint, embedding array<float>, label int, key string, src int")
    got = {x["vec_id"]: x for x in embedding_dedup.dedup_embeddings(table).collect()}
    unit = np.array(vectors, "f4").astype("f8")
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    labels = np.array([x[2] for x in rows])
    links = (unit @ unit.T >= 0.98) & (labels[:, None] == labels[None])
    np.fill_diagonal(links, False)
    found, true = np.array([got[i]["n_links"] for i in range(600)]), links.sum(1)
    assert (found <= true).all() and found.sum() >= 0.99 * true.sum() > 500
    for i, v, _ in odd:
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == ((1, 1005, i == 1005) if i in (1005, 1006) else (0, i, True)), v
    assert embedding_dedup.dedup_embeddings(table.limit(0)).count() == 0


def test_equal_vectors_all_link(spark):
    r = np.random.default_rng(8)
    base = r.normal(size=16)
    close, far = base + r.normal(scale=0.02, size=16), r.normal(size=16)
    rows = [(i, base.tolist(), 1) for i in range(400)] + [(400, close.tolist(), 1), (401, far.tolist(), 1), (402, base.tolist(), 2)]
    # One id with two vectors ties their groups; a repeated row counts once.
    rows += [(403, base.tolist(), 1), (403, far.tolist(), 1), (0, base.tolist(), 1)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    got = {x["vec_id"]: tuple(x)[1:] for x in embedding_dedup.dedup_embeddings(table).collect()}
    assert all(got[i] == (401, 0, i == 0) for i in range(401))
    assert (got[401], got[402], got[403]) == ((1, 0, False), (0, 402, True), (402, 0, False))


def test_links_of_a_narrow_cone_are_found(spark):
    r = np.random.default_rng(4)
    rows = np.eye(64)[0] + r.normal(scale=np.sqrt(0.05 / 0.95 / 63), size=(20_000, 64)) * (np.arange(64) > 0)
    rows /= np.linalg.norm(rows, axis=1)[:, None]  # cosines of about 0.95 in one label
    aside = r.normal(size=(1000, 64))
    aside -= rows[:1000] * (aside * rows[:1000]).sum(1)[:, None]
    near = 0.981 * rows[:1000] + np.sqrt(1 - 0.981**2) * aside / np.linalg.norm(aside, axis=1)[:, None]
    flat = pa.array(np.concatenate([rows, near]).ravel())
    vectors = pa.ListArray.from_arrays(pa.array(np.arange(21_001, dtype="i4") * 64), flat)
    made = pa.table({"vec_id": pa.array(range(21_000)), "label": pa.array([1] * 21_000), "embedding": vectors})
    got = {x["vec_id"]: x for x in embedding_dedup.dedup_embeddings(spark.createDataFrame(made)).collect()}
    assert sum(got[20_000 + i]["component_id"] <= i for i in range(1000)) >= 985
    assert sum(x["n_links"] > 0 for x in got.values()) < 10_000


def test_turn_digest_is_sha256(spark):
    r = chat.op4_chat_formatting(spark, "/root/testdata/sf0.001").filter("conv_id = -7").first()
    said = "\\### Assistant: </turn> ok"
    assert r["turns_sha256"] == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
    assert (r["n_turns"], r["loss_chars"], r["loss_sha256"]) == (2, len(said), hashlib.sha256(said.encode()).hexdigest())
