"""Token ids of whole texts by a given tokenizer file, word by word."""

from __future__ import annotations

import re
import string
import struct
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# At most this many words are kept with their ids in a worker; an emptied memory only costs time.
REMEMBERED_WORDS = 400_000
LONGEST_REMEMBERED = 48
END_ID = 1
# Latin letters up to U+00FF: composed already, and each lower-cased to one letter of this range.
_LETTERS = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*")


def _visible_bytes() -> dict[int, int]:
    """Byte-level vocabularies write bytes that are not printable in Latin-1 as code points from 256 on."""
    hidden = [b for b in range(256) if not chr(b).isprintable() or b == 32]
    return {b: 256 + i for i, b in enumerate(hidden)}


class WordTokenizer:
    """Ids as little-endian unsigned 32-bit bytes, equal to encoding the whole text at once.

    Only for tokenizers like ``word_bpe_49k`` that lower the case, drop white space and start a new
    word at it and between letters and punctuation.  The words between ASCII white space are encoded
    once each and put together again.  A word of Latin letters, with or without ASCII punctuation after
    it, goes to the merge table directly; all others take the tokenizer's full way.
    """

    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_str(definition)
        self._merge = self._tokenizer.model.tokenize
        self._visible = _visible_bytes()
        self._known: dict[str, bytes] = {"": b""}
        self._parts: dict[str, bytes] = {"": b""}

    def encode(self, texts: pa.Array | list[str | None]) -> list[bytes]:
        """The ids of every text; null counts as empty.

        Arrow cuts the texts and numbers their words, so each different word is looked up once for all texts.
        """
        if not isinstance(texts, pa.Array):
            texts = pa.array(texts, pa.string())
        words = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        if len(self._known) > REMEMBERED_WORDS:
            self._known = {"": b""}
        if len(self._parts) > REMEMBERED_WORDS:
            self._parts = {"": b""}
        numbered = words.flatten().dictionary_encode()
        different, known = numbered.dictionary.to_numpy(zero_copy_only=False).tolist(), self._known
        once = self._learn([w for w in different if w not in known])
        found = [known[w] if w in known else once[w] for w in different] if once else [known[w] for w in different]
        ids, sizes = np.frombuffer(b"".join(found), "<u4"), np.fromiter(map(len, found), np.int64, len(found)) // 4
        word = numbered.indices.to_numpy(zero_copy_only=False)
        size = sizes[word]
        ends = np.cumsum(size)
        place = np.repeat((np.cumsum(sizes) - sizes)[word] - (ends - size), size)
        place += np.arange(len(place))
        joined = ids[place].tobytes()
        offsets = words.offsets.to_numpy()
        cuts = (4 * np.concatenate([[0], ends])[offsets - offsets[0]]).tolist() if len(offsets) else []
        return [joined[i:j] for i, j in pairwise(cuts)]

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        known, once, odd = self._known, {}, []
        for word in words:
            core = word.rstrip(string.punctuation)
            if len(word) <= LONGEST_REMEMBERED and _LETTERS.fullmatch(core):
                known[word] = self._part(core.lower()) + self._part(word[len(core) :])
            else:
                odd.append(word)
        for at in range(0, len(odd), 4096):
            part = odd[at : at + 4096]
            for word, found in zip(part, self._tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                (known if len(word) <= LONGEST_REMEMBERED else once)[word] = _bytes(found.ids)
        return once

    def _part(self, part: str) -> bytes:
        ids = self._parts.get(part)
        if ids is None:
            shown = part if part.isascii() else part.encode().decode("latin-1").translate(self._visible)
            ids = self._parts[part] = _bytes([token.id for token in self._merge(shown)])
        return ids


@lru_cache(maxsize=1)
def word_tokenizer(definition: str) -> WordTokenizer:
    """The tokenizer of this process: tasks that a worker runs one after the other share the words it knows."""
    return WordTokenizer(definition)


def _bytes(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)
