"""Encoding and decoding by a merge-type SentencePiece model: exact, by backtracking over longest matches."""

from __future__ import annotations

import re
import struct
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

SPACE_MARK = "▁"
# At most this many chunks and pairs are kept in a worker; an emptied memory only costs time.
REMEMBERED_CHUNKS = 300_000
REMEMBERED_PAIRS = 400_000
LONGEST_REMEMBERED = 48
# Texts are read in parts of about so many characters, which end where no piece reaches across.
PART_CHARACTERS = 1 << 20
_PROBES = ("", " ", " a  b ", "a\n\tb", "ﬁＡ 　", "éé", "▁x", "a\x00\r\n", "각")


@dataclass
class PieceTables:
    """What a task needs of a model: small (a few times the model file), built once on the driver.

    A symbol is a piece, or a character that occurs only inside longer pieces.  ``emitted`` are its ids
    as bytes, ``shorter`` the next shorter symbol it starts with, ``ranks`` the order of merges.
    """

    symbols: list[str]
    emitted: list[bytes]
    shorter: list[int]
    ranks: dict[str, int]
    decoded: list[bytes | None]
    byte_ids: list[int]
    begin: int
    end: int
    unknown: int
    normalized_by: bytes | None


def plain_normal(text: str) -> str:
    return SPACE_MARK + text.replace(" ", SPACE_MARK) if text else ""


def merged(text: str, ranks: dict[str, int]) -> list[str]:
    """The definition: merge the neighbours whose union ranks first, the leftmost of equal ones, until none is left."""
    parts, none = list(text), 1 << 60
    order = [ranks.get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
    while order and (rank := min(order)) < none:
        at = order.index(rank)
        parts[at] += parts.pop(at + 1)
        del order[at]
        if at:
            order[at - 1] = ranks.get(parts[at - 1] + parts[at], none)
        if at < len(order):
            order[at] = ranks.get(parts[at] + parts[at + 1], none)
    return parts


def piece_tables(model: bytes) -> PieceTables:
    """Tables of a SentencePiece model of type BPE with byte fallback and without user-defined pieces."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    count = sp.vocab_size()
    byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    special = {i for i in range(count) if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)}
    if any(not sp.is_byte(i) for i in byte_ids) or any(sp.is_unused(i) for i in range(count)):
        raise ValueError("the model needs byte fallback and no unused pieces")
    ids = {sp.id_to_piece(i): i for i in range(count) if i not in special}
    scores = sorted({sp.get_score(i) for i in ids.values()}, reverse=True)
    order = {score: rank for rank, score in enumerate(scores)}
    ranks = {piece: order[sp.get_score(i)] for piece, i in ids.items() if len(piece) > 1}
    # A piece that its own merges do not arrive at never comes out and takes no part in the search.
    longer = [p for p in ranks if merged(p, ranks) == [p]]
    symbols = sorted({c for p in ids for c in p}) + sorted(longer)
    number = {s: i for i, s in enumerate(symbols)}
    shorter = [next((number[s[:n]] for n in range(len(s) - 1, 0, -1) if s[:n] in number), -1) for s in symbols]
    emitted = [_packed([ids[s]] if s in ids else [byte_ids[b] for b in s.encode()]) for s in symbols]
    decoded: list[bytes | None] = [None] * count  # None: nothing is said
    for piece, i in ids.items():
        decoded[i] = piece.replace(SPACE_MARK, " ").encode()
    for byte, i in enumerate(byte_ids):
        decoded[i] = bytes([byte])
    decoded[sp.unk_id()] = " ⁇ ".encode()
    same = all(sp.normalize(p) == plain_normal(p) for p in _PROBES)
    return PieceTables(symbols, emitted, shorter, ranks, decoded, byte_ids, sp.bos_id(), sp.eos_id(), sp.unk_id(), None if same else model)


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class PieceEncoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes, equal to merging the whole text.

    A text falls into chunks between which no piece reaches (``_cuts``).  A chunk is encoded by backtracking:
    at each position the longest piece first (Aho-Corasick), then shorter ones, if it is compatible with
    the piece before, that is, if merging both again gives the same two.  A sequence of compatible
    neighbours is the one that merging the whole chunk gives, so the first one found is right, and a
    position from which none was found is marked and not tried again.
    """

    def __init__(self, tables: PieceTables):
        import ahocorasick

        self.tables = tables
        self._automaton = ahocorasick.Automaton()
        for i, symbol in enumerate(tables.symbols):
            self._automaton.add_word(symbol, i)
        self._automaton.make_automaton()
        self._lengths = [len(s) for s in tables.symbols]
        self._pairs: dict[int, bool] = {}
        self._known: dict[str, bytes] = {}
        self._chunks, self._word_end = _cuts(tables.symbols)
        self._normal = plain_normal
        if tables.normalized_by:
            import sentencepiece

            self._normal = sentencepiece.SentencePieceProcessor(model_proto=tables.normalized_by).normalize

    def encode(self, text: str | None) -> bytes:
        """All ids of a text with the begin and end ids; null counts as empty."""
        text, found, at = self._normal(text or ""), [_packed([self.tables.begin])], 0
        while at < len(text):
            cut = self._word_end.search(text, at + PART_CHARACTERS)
            end = cut.end() if cut else len(text)
            known = self._known.get
            found.append(b"".join([known(c) or self._chunk(c) for c in self._chunks.findall(text, at, end)]))
            at = end
        found.append(_packed([self.tables.end]))
        return b"".join(found)

    def _chunk(self, chunk: str) -> bytes:
        ids = self._encoded(chunk)
        if len(chunk) <= LONGEST_REMEMBERED:
            if len(self._known) >= REMEMBERED_CHUNKS:
                self._known.clear()
            self._known[chunk] = ids
        return ids

    def _encoded(self, chunk: str) -> bytes:
        emitted = self.tables.emitted
        if len(chunk) == 1 and not self._automaton.exists(chunk):
            return _packed([self.tables.byte_ids[b] for b in chunk.encode("utf-8", "surrogatepass")])
        return b"".join([emitted[s] for s in self.backtrack(chunk)])

    def _fit(self, left: int, right: int) -> bool:
        a, b = self.tables.symbols[left], self.tables.symbols[right]
        if len(self._pairs) >= REMEMBERED_PAIRS:
            self._pairs.clear()
        fits = self._pairs[left << 32 | right] = merged(a + b, self.tables.ranks) == [a, b]
        return fits

    def backtrack(self, chunk: str) -> list[int]:
        """Symbols of a chunk of known characters."""
        lengths, shorter, known, size = self._lengths, self.tables.shorter, self._pairs.get, len(chunk)
        longest = [0] * size if size <= LONGEST_REMEMBERED else array("i", bytes(4 * size))
        for last, symbol in self._automaton.iter(chunk):
            longest[last + 1 - lengths[symbol]] = symbol  # matches of one start come by growing length
        failed = bytearray((size >> 3) + 1)
        path: list[int] = []
        at, symbol, before = 0, longest[0], -1
        while at < size:
            while symbol >= 0:
                end = at + lengths[symbol]
                if not failed[end >> 3] >> (end & 7) & 1:
                    fits = before < 0 or known(before << 32 | symbol)
                    if fits or fits is None and self._fit(before, symbol):
                        break
                symbol = shorter[symbol]
            if symbol >= 0:
                path.append(symbol)
                at, before = end, symbol
                symbol = longest[at] if at < size else -1
            else:
                failed[at >> 3] |= 1 << (at & 7)
                symbol = path.pop()
                before = path[-1] if path else -1
                at -= lengths[symbol]
        return path


def _cuts(symbols: list[str]) -> tuple[re.Pattern, re.Pattern]:
    """The pattern of chunks, and that of a character after which a text may be cut.

    Inside pieces a mark follows only marks, and a character of ``own`` (punctuation, mostly) only
    characters of ``own`` or marks; so no piece reaches over the start of either after another kind of
    character.  Neither does one over a character that is in no longer piece.
    """
    before: dict[str, set[str]] = {}
    joined = set()
    for symbol in symbols:
        for a, b in zip(symbol, symbol[1:], strict=False):
            before.setdefault(b, set()).add(a)
            joined |= {a, b}
    own = {c for c in joined if not c.isalpha()}
    while odd := {c for c in own if not before.get(c, set()) <= own}:
        own -= odd
    mark = SPACE_MARK if before.get(SPACE_MARK, set()) <= {SPACE_MARK} else ""
    own -= {SPACE_MARK}

    def of(characters):
        return "[" + "".join(map(re.escape, sorted(characters))) + "]" if characters else "(?!)"

    rest = of(joined - own - {mark})
    start = f"{mark}*" if mark else ""
    chunk = re.compile(f"{start}(?:{of(own)}+{rest}*|{rest}+)|{mark or '(?!)'}+|.", re.DOTALL)
    return chunk, re.compile(f"[^{mark}](?={mark})", re.DOTALL) if mark else re.compile("(?!)")


class PieceDecoder:
    """Texts of ids: pieces with spaces for marks, bytes put together, one leading space taken off."""

    def __init__(self, tables: PieceTables):
        self._said = [b"" if d is None else d for d in tables.decoded]
        self._silent = np.array([i for i, d in enumerate(tables.decoded) if d is None], np.uint32)
        other = {tables.unknown, *tables.byte_ids}
        self._spaced = {i for i, d in enumerate(self._said) if d[:1] == b" " and i not in other}

    def decode(self, ids: bytes) -> str:
        numbers = np.frombuffer(ids, "<u4")
        spoken = np.flatnonzero(~np.isin(numbers, self._silent))
        if not len(spoken):
            return ""
        listed = numbers[spoken].tolist()
        first = self._said[listed[0]]
        parts = [first[1:] if listed[0] in self._spaced else first, *map(self._said.__getitem__, listed[1:])]
        breaks = np.flatnonzero(np.diff(spoken) > 1) + 1  # bytes of one character never lie around a control id
        edges = [0, *breaks.tolist(), len(parts)]
        return "".join([_read(b"".join(parts[a:b])) for a, b in zip(edges, edges[1:], strict=False)])


def _read(data: bytes) -> str:
    try:
        return data.decode()
    except UnicodeDecodeError:
        return _repaired(data)


def _repaired(data: bytes) -> str:
    """Every byte that is not part of a character becomes U+FFFD."""
    found, at = [], 0
    while at < len(data):
        try:
            found.append(data[at:].decode())
            break
        except UnicodeDecodeError as error:
            found.append(data[at : at + error.start].decode() + "�")
            at += error.start + 1
    return "".join(found)


def model_bytes(path: str | None = None) -> bytes:
    """A model file, read once on the driver (half a MB)."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    return Path(path).read_bytes()


def encode_documents(docs: DataFrame, model: bytes) -> DataFrame:
    """doc_id and ids (little-endian unsigned 32-bit) of every whole text, with begin and end ids.

    Null and empty texts are the begin and end id alone.  Ids of documents pass through as they are,
    null and repeated ones too; repeated rows are encoded one by one.  Very long texts go through in
    parts.  An empty table gives no rows.  Nothing is shuffled.
    """
    tables = piece_tables(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PieceEncoder(tables)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids = [encoder.encode(t) for t in part.column(1).to_pylist()]
                yield pa.record_batch([part.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    plain = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(run, f"doc_id {plain.schema['doc_id'].dataType.simpleString()}, ids binary")


def decode_documents(encoded: DataFrame, model: bytes) -> DataFrame:
    """doc_id, ids and text of rows as ``encode_documents`` returns them; null ids give a null text."""
    tables = piece_tables(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = PieceDecoder(tables)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [None if i is None else decoder.decode(i) for i in part.column(1).to_pylist()]
                yield pa.record_batch([*part.columns, pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])

    plain = encoded.select("doc_id", "ids")
    return plain.mapInArrow(run, f"doc_id {plain.schema['doc_id'].dataType.simpleString()}, ids binary, text string")


def op12_pieces(spark, folder):
    model = model_bytes()
    decoded = decode_documents(encode_documents(table(spark, folder, "documents"), model), model)
    return decoded.select(
        "doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )
