"""Quality classifier: a byte-level convolutional network in numpy."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .common import table

CHUNK_BYTES = 512
OVERLAP_BYTES = 32
WIDTH = 4
FILTERS = 48
HIDDEN = 16
THRESHOLD = 0.3
# Bounds of the training sample: documents of each label, and chunks of each document.
SAMPLE_PER_LABEL = 1500
CHUNKS_PER_DOCUMENT = 8
EPOCHS = 25
SEED = 7
# Bytes that are scored at once.
BLOCK_BYTES = 1 << 16


def chunk_starts(length: int, chunk: int = CHUNK_BYTES, overlap: int = OVERLAP_BYTES) -> range:
    """Where the overlapping chunks of a text begin; together they cover every byte, an empty text has one."""
    return range(0, max(1, length - overlap), chunk - overlap)


class ByteNetwork:
    """Filters over byte windows, max-pooled per chunk, a hidden layer, logits averaged over chunks."""

    def __init__(self, seed: int = SEED, width: int = WIDTH, filters: int = FILTERS, hidden: int = HIDDEN):
        random = np.random.default_rng(seed)
        self.p = {
            "filters": random.normal(0, 0.3, (width, 256, filters)).astype("f4"),
            "bias": np.zeros(filters, "f4"),
            "mix": random.normal(0, filters**-0.5, (filters, hidden)).astype("f4"),
            "mix_bias": np.zeros(hidden, "f4"),
            "out": random.normal(0, hidden**-0.5, hidden).astype("f4"),
            "out_bias": np.zeros(1, "f4"),
        }
        self.shift = 0.0

    def responses(self, data: np.ndarray) -> np.ndarray:
        """(positions, filters); ``data`` needs width - 1 bytes of padding at its end."""
        table_, width = self.p["filters"], len(self.p["filters"])
        n = len(data) - width + 1
        total = table_[0].take(data[:n], axis=0)
        part = np.empty_like(total)
        for j in range(1, width):
            table_[j].take(data[j : n + j], axis=0, out=part, mode="clip")
            total += part
        return total

    def head(self, pooled: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        active = np.maximum(pooled + self.p["bias"], 0)
        hidden = np.tanh(active @ self.p["mix"] + self.p["mix_bias"])
        return active, hidden, hidden @ self.p["out"] + self.p["out_bias"][0]

    def logits(self, texts: list[bytes]) -> np.ndarray:
        """One logit per text: the mean over all its chunks."""
        pad, step = bytes(len(self.p["filters"]) - 1), CHUNK_BYTES - OVERLAP_BYTES
        sums, counts = np.zeros(len(texts)), np.zeros(len(texts))
        pieces, bounds, owners, size = [], [], [], 0

        def flush():
            nonlocal pieces, bounds, owners, size
            if not pieces:
                return
            found = self.responses(np.frombuffer(b"".join(pieces) + pad, np.uint8))
            pooled = np.maximum.reduceat(found, np.array(bounds).ravel(), axis=0)[::2]
            np.add.at(sums, owners, self.head(pooled)[2])
            np.add.at(counts, owners, 1)
            pieces, bounds, owners, size = [], [], [], 0

        per_piece = max(1, BLOCK_BYTES // step)
        for i, text in enumerate(texts):
            starts = chunk_starts(len(text))
            for first in range(0, len(starts), per_piece):
                mine = starts[first : first + per_piece]
                base = mine[0]
                piece = (text[base : mine[-1] + CHUNK_BYTES] or b"\0") + pad
                for start in mine:
                    bounds.append((size + start - base, size + max(start - base + 1, min(len(piece) - len(pad), start - base + CHUNK_BYTES))))
                    owners.append(i)
                pieces.append(piece)
                size += len(piece)
                if size >= BLOCK_BYTES:
                    flush()
        flush()
        return sums / counts + self.shift

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return 1 / (1 + np.exp(-self.logits(texts)))

    def train(self, documents: list[list[bytes]], labels: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> None:
        """Adam on the log loss; each document is given by some of its chunks.

        A filter learns at the position of its maximum only.
        """
        random = np.random.default_rng(seed)
        width = len(self.p["filters"])
        span = CHUNK_BYTES + width - 1
        moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        data = [np.stack([np.frombuffer(c.ljust(span, b"\0")[:span], np.uint8) for c in d]) for d in documents]
        lengths = [np.array([max(1, len(c)) for c in d]) for d in documents]
        step = 0
        for _ in range(epochs):
            order = random.permutation(len(documents))
            for at in range(0, len(order), 32):
                batch = order[at : at + 32]
                chunks = np.concatenate([data[i] for i in batch])
                owner = np.repeat(np.arange(len(batch)), [len(data[i]) for i in batch])
                each = np.bincount(owner)
                found = self.responses(np.concatenate([chunks.ravel(), np.zeros(width - 1, np.uint8)]))
                found = found.reshape(len(chunks), span, -1)
                valid = np.arange(span)[None, :] < np.concatenate([lengths[i] for i in batch])[:, None]
                found[~valid] = -1e9
                best = found.argmax(1)
                active, hidden, logit = self.head(np.take_along_axis(found, best[:, None, :], 1)[:, 0])
                mean = np.bincount(owner, logit) / each
                wrong = (1 / (1 + np.exp(-mean)) - labels[batch]) / len(batch)
                d_logit = (wrong / each)[owner].astype("f4")
                d_hidden = d_logit[:, None] * self.p["out"] * (1 - hidden**2)
                d_active = (d_hidden @ self.p["mix"].T) * (active > 0)
                d_filters = np.zeros_like(self.p["filters"])
                rows, cols = np.nonzero(d_active)
                for j in range(width):
                    np.add.at(d_filters[j], (chunks[rows, best[rows, cols] + j], cols), d_active[rows, cols])
                grads = {
                    "filters": d_filters, "bias": d_active.sum(0), "mix": active.T @ d_hidden, "mix_bias": d_hidden.sum(0),
                    "out": hidden.T @ d_logit, "out_bias": d_logit.sum(keepdims=True),
                }
                step += 1
                for k, g in grads.items():
                    first, second = moments[k]
                    first *= 0.9
                    first += 0.1 * g
                    second *= 0.999
                    second += 0.001 * g * g
                    self.p[k] -= 0.01 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)


def _sample_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """At most CHUNKS_PER_DOCUMENT chunks of each text, drawn from all of it by a hash of its id."""
    for batch in batches:
        found = []
        for doc_id, label, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            data = (text or "").encode("utf-8", "surrogatepass")
            starts = chunk_starts(len(data))
            seed = int.from_bytes(hashlib.blake2b(str(doc_id).encode(), digest_size=8).digest(), "big")
            picked = np.random.default_rng(seed).choice(len(starts), min(len(starts), CHUNKS_PER_DOCUMENT), replace=False)
            found.append((doc_id, label, [data[starts[i] : starts[i] + CHUNK_BYTES] for i in sorted(picked.tolist())]))
        ids, labels, chunks = zip(*found, strict=True) if found else ((), (), ())
        yield pa.record_batch(
            [pa.array(ids, pa.int64()), pa.array(labels, pa.int32()), pa.array(chunks, pa.list_(pa.binary()))],
            names=["doc_id", "label", "chunks"],
        )


def held_out(doc_id) -> F.Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def train_classifier(
    docs: DataFrame, labels: DataFrame, sample_per_label: int = SAMPLE_PER_LABEL, epochs: int = EPOCHS, seed: int = SEED
) -> ByteNetwork:
    """Fit the network on a bounded sample of labelled documents that are not held out.

    ``sample_per_label`` documents of either label with the smallest id hashes are taken; the scores
    are then shifted back to the label's share among all labelled rows.  Null labels are ignored; of
    repeated labels the smallest counts, of documents with one id those with the smallest chunks.  Without documents of both labels the network stays
    untrained and every score follows the share of label 1 (0.5 if there is none).
    """
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("quality").cast("int").alias("label"))
    known = materialize(known.filter(F.col("label").isin(0, 1)), "labels")
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    model = ByteNetwork(seed)
    if len(counts) < 2:
        share = (counts.get(1, 0) + 1) / (sum(counts.values()) + 2)
        model.p["out"][:] = 0
        model.shift = float(np.log(share / (1 - share)))
        return model
    mark = F.xxhash64(F.lit(seed), "doc_id")
    chosen = None
    for label in (0, 1):
        part = known.filter(F.col("label") == label).orderBy(mark, "doc_id").limit(sample_per_label)
        chosen = part if chosen is None else chosen.unionByName(part)
    chosen = materialize(chosen, "sample")
    # The sample is bounded by its parameter, 24 bytes a row.
    text = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text")
    chunks = text.mapInArrow(_sample_chunks, "doc_id bigint, label int, chunks array<binary>")
    # One row an id, however often the table repeats it.
    rows = chunks.groupBy("doc_id", "label").agg(F.min("chunks").alias("chunks")).collect()
    rows = sorted(rows, key=lambda r: (r["doc_id"], r["chunks"]))
    if len({r["label"] for r in rows}) == 2:
        y = np.array([r["label"] for r in rows], "f4")
        model.train([[bytes(c) for c in r["chunks"]] for r in rows], y, epochs, seed)
        model.shift = float(np.log(counts[1] / counts[0]) - np.log(y.sum() / (len(y) - y.sum())))
    return model


def score_documents(docs: DataFrame, model: ByteNetwork, threshold: float = THRESHOLD) -> DataFrame:
    """``score`` and ``predicted`` for every row of ``docs``, whose columns are kept inside ``row``.

    The whole text is scored, in blocks; nothing but the text is read.  Null counts as empty, which
    has a score as well.  Repeated rows get the same score; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [t or b"" for t in part.column(1).cast(pa.binary()).to_pylist()]
                found = pa.array(model.scores(texts), pa.float64())
                yield pa.record_batch([part.column(0), found], names=["row", "score"])

    names = [F.col(f"`{c}`") for c in docs.columns]
    packed = docs.select(F.struct(*names).alias("row"), F.col("text").alias("_text"))
    schema = T.StructType([packed.schema["row"], T.StructField("score", T.DoubleType())])
    scored = packed.mapInArrow(run, schema)
    return scored.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def keep_good(docs: DataFrame, model: ByteNetwork, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that are not rejected, with their columns."""
    kept = score_documents(docs, model, threshold).filter("predicted = 1")
    return kept.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op5_quality(spark, folder):
    docs = table(spark, folder, "documents")
    model = train_classifier(docs, table(spark, folder, "labels"))
    scored = score_documents(docs.select("doc_id", "text"), model)
    return scored.select(
        F.col("row.doc_id").alias("doc_id"), held_out(F.col("row.doc_id")).alias("held_out"), "score", "predicted"
    )
