"""Cost-balanced packing of documents into fixed-length training sequences."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import table
from .tokens import END_ID, word_tokenizer

SEQUENCE_TOKENS = 2048
# Documents are collected until they hold this many tokens, then packed together.
BLOCK_TOKENS = 1 << 20
# About so many bytes of text are tokenized together.
BYTES_AT_ONCE = 4 << 20
# After so many documents a task looks whether a block is full.
CHECKED = 256
# A document of n tokens costs n + QUADRATIC * n * n: feed-forward work and attention.
QUADRATIC = 1 / 2048
END = END_ID.to_bytes(4, "little")
SCHEMA = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
)
ARROW_SCHEMA = pa.schema([(part.split()[0], pa.int64()) for part in SCHEMA.split(", ")])


class Packer:
    """Packs the documents of one task; what does not fill a sequence waits for the next block."""

    def __init__(self, first_sequence: int, capacity: int = SEQUENCE_TOKENS, quadratic: float = QUADRATIC):
        self.capacity, self.quadratic = capacity, quadratic
        self.next_sequence = first_sequence
        self.waiting: list[tuple] = []  # (doc id, start, ids of the rest, tokens of the document)
        self.tokens = 0
        self.rows: list[tuple] = []

    def add(self, doc_id, ids: bytes) -> None:
        n, c = len(ids) // 4, self.capacity
        whole = n // c * c
        for start in range(0, whole, c):  # full sequences need no partner
            self._put(doc_id, start, ids[4 * start : 4 * (start + c)], n, self.next_sequence, 0)
            self.next_sequence += 1
        if n > whole:
            self.waiting.append((doc_id, whole, ids[4 * whole :], n))
            self.tokens += n - whole

    def _put(self, doc_id, start, ids, doc_tokens, sequence, offset) -> None:
        self.rows.append((doc_id, start, len(ids) // 4, zlib.crc32(ids), doc_tokens, sequence, offset))

    def pack(self) -> None:
        """Fill whole sequences: descending documents, each to the cheapest sequence that can hold it.

        A document that fits nowhere is cut to fill the cheapest sequence with room.
        """
        count = self.tokens // self.capacity
        room = np.full(count, self.capacity)
        cost = np.zeros(count)
        left = []
        for doc_id, start, ids, total in sorted(self.waiting, key=lambda x: -len(x[2])):
            while ids:
                n = len(ids) // 4
                open_ = np.flatnonzero(room >= n)
                if not len(open_):
                    open_ = np.flatnonzero(room)
                    if not len(open_):
                        left.append((doc_id, start, ids, total))
                        break
                at = open_[np.argmin(cost[open_])]
                take = min(n, int(room[at]))
                self._put(doc_id, start, ids[: 4 * take], total, self.next_sequence + int(at), self.capacity - int(room[at]))
                room[at] -= take
                cost[at] += take + self.quadratic * take * take
                ids, start = ids[4 * take :], start + take
        self.next_sequence += count
        self.waiting, self.tokens = left, sum(len(x[2]) // 4 for x in left)

    def finish(self) -> None:
        """The last tokens, fewer than a sequence, go to sequences of power-of-two lengths: no padding."""
        self.pack()
        rest, size = self.waiting, self.capacity // 2
        while rest:
            if self.tokens < size:
                size //= 2
                continue
            room = size
            while room:
                doc_id, start, ids, total = rest.pop(0)
                take = min(room, len(ids) // 4)
                self._put(doc_id, start, ids[: 4 * take], total, self.next_sequence, size - room)
                room -= take
                if 4 * take < len(ids):
                    rest.insert(0, (doc_id, start + take, ids[4 * take :], total))
            self.next_sequence += 1
            self.tokens -= size
        self.waiting = []

    def drain(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) or [[]] * len(ARROW_SCHEMA)
        self.rows = []
        return pa.record_batch([pa.array(c, pa.int64()) for c in columns], schema=ARROW_SCHEMA)


def pack(docs: DataFrame, tokenizer: str, sequence_tokens: int = SEQUENCE_TOKENS, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Pieces of documents and their places in training sequences; ``tokenizer`` is its file's text.

    Each task tokenizes and packs the documents it reads, block by block, so nothing is shuffled and
    a task holds one block.  All sequences are full but the last few of a task, which have
    power-of-two lengths.  Sequence ids are unique: the task's number and a count.

    Null and empty texts hold the end id alone.  Null ids stay null.  Repeated rows are packed one by
    one.  Very long documents are cut into full sequences.  An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_tokenizer(tokenizer)
        packer = Packer(TaskContext.get().partitionId() << 40, sequence_tokens)
        for batch in batches:
            rows = CHECKED * max(1, batch.num_rows * BYTES_AT_ONCE // max(batch.nbytes, 1) // CHECKED)
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                ids = words.encode(part.column(1))
                for i, (doc_id, found) in enumerate(zip(part.column(0).to_pylist(), ids, strict=True), 1):
                    packer.add(doc_id, found + END)
                    if i % CHECKED and i < len(ids):
                        continue
                    if packer.tokens >= block_tokens:
                        packer.pack()
                    if len(packer.rows) >= 5000:
                        yield packer.drain()
        packer.finish()
        if packer.rows:
            yield packer.drain()

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def tokenizer_definition(path: str | None = None) -> str:
    """The text of a tokenizer file, read once on the driver; tasks get it with the job (1.7 MB)."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    return Path(path).read_text(encoding="utf-8")


def op6_packing(spark, folder):
    return pack(table(spark, folder, "documents"), tokenizer_definition())
