"""Token ids of whole texts, many texts to a call.

The pre-tokeniser of a byte-level BPE never joins a character that is not white space
to white space behind it, nor an ASCII letter, digit or mark to one of another kind. So a
text is cut there into chunks, equal chunks of a batch are encoded once by the
``tokenizers`` library, and ids are put together by position.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import pyarrow as pa

from .words import text_bytes

_ASCII_SPACE = np.zeros(256, bool)
_ASCII_SPACE[[*range(0x09, 0x0E), *range(0x1C, 0x21)]] = True
# Where a byte before a separator may end a wider white space character: (second last, last).
_WIDE = np.zeros((256, 256), bool)
for _a, _b in [(0xC2, 0x85), (0xC2, 0xA0), (0x9A, 0x80), (0x81, 0x9F), *((0x80, b) for b in range(0x80, 0xC0))]:
    _WIDE[_a, _b] = True
# Kinds of ASCII bytes; others, the apostrophe and what special strings are made of are of none.
SPACE, LETTER, DIGIT, MARK = 1, 2, 3, 4
KIND = np.zeros(256, np.uint8)
KIND[[0x20, *range(0x09, 0x0E)]] = SPACE
KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = LETTER
KIND[0x30:0x3A] = DIGIT
KIND[[b for b in range(0x21, 0x7F) if not KIND[b] and chr(b) not in "'<|>"]] = MARK
# From one of these kinds to another no piece of the pre-tokeniser reaches.
APART = np.zeros((5, 5), bool)
APART[LETTER:, LETTER:] = ~np.eye(3, dtype=bool)
MEMO = 400_000  # words remembered by one worker; beyond it the memory starts anew
# Characters on which all regular expression libraries agree; other chunks take the library's own way.
_PLAIN = re.compile("[\\t\\n\\x20-\\x7e\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]*")
_WORD = re.compile("\x20?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_alphabet() -> dict[int, str]:
    """The letter that byte-level models write for each byte: printable ones stand for themselves."""
    same = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in same]
    return {**{b: chr(b) for b in same}, **{b: chr(256 + i) for i, b in enumerate(rest)}}


class Encoder:
    """Ids by ``Tokenizer.encode_batch(..., add_special_tokens=False)``.

    The words of plain chunks go to the tokenizer's BPE model one by one and are
    remembered, as most texts are made of words seen before.
    """

    def __init__(self, path: str, special_as_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        self.words = regex.compile(public_tokenizers.PATTERN).findall
        self.special = [s.content for s in self.tokenizer.get_added_tokens_decoder().values()]
        self.alphabet = _byte_alphabet()
        self.memo: dict[bytes, bytes] = {}

    def _word(self, word: str) -> bytes:
        key = word.encode("utf-8")
        ids = self.memo.get(key)
        if ids is None:
            written = key.decode("latin-1").translate(self.alphabet)
            ids = self.memo[key] = array("I", [t.id for t in self.tokenizer.model.tokenize(written)]).tobytes()
        return ids

    def _chunk(self, key: bytes) -> bytes:
        chunk = key.decode("utf-8")
        if _WORD.fullmatch(chunk):
            return self._word(chunk)
        if _PLAIN.fullmatch(chunk) and not any(s in chunk for s in self.special):
            ids = b"".join([self._word(w) for w in self.words(chunk)])
        else:
            ids = array("I", self.tokenizer.encode(chunk, add_special_tokens=False).ids).tobytes()
        if len(key) < 40:
            self.memo[key] = ids
        return ids

    def _ids(self, chunks: list[bytes]) -> list[bytes]:
        if len(self.memo) > MEMO:
            self.memo.clear()
        known, new = self.memo.get, self._chunk
        return [known(c) or new(c) for c in chunks]

    def encode(self, column: pa.Array, end_id: int | None = 0) -> tuple[np.ndarray, np.ndarray]:
        """All ids (each text's followed by ``end_id``) and the first of each text; null is empty."""
        data, offsets = text_bytes(column)
        n, texts = len(data), len(offsets) - 1
        cut = np.zeros(n + 1, bool)
        if n:
            space = _ASCII_SPACE[data]
            cut[1:n] = space[1:] & ~space[:-1]
            cut[2:n] &= ~_WIDE[data[:-2], data[1:-1]]
            cut[1:2] &= data[0] < 0x80
            kind = KIND[data]
            cut[1:n] |= APART[kind[:-1], kind[1:]]
        cut[offsets] = True
        bounds = np.flatnonzero(cut)
        flat, codes = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        begins, lengths = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if n:
            chunks = pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds.astype(np.int64)),
                                                      pa.py_buffer(data))
            dictionary = chunks.dictionary_encode()
            codes = dictionary.indices.to_numpy()
            _, at, distinct = dictionary.dictionary.buffers()
            at, distinct = np.frombuffer(at, np.int64)[:len(dictionary.dictionary) + 1].tolist(), distinct.to_pybytes()
            pieces = self._ids([distinct[a:b] for a, b in zip(at, at[1:])])
            lengths = np.array([len(p) // 4 for p in pieces], np.int64)
            flat = np.frombuffer(b"".join(pieces), np.uint32)
            begins = np.cumsum(lengths) - lengths
        # A text's end is one more chunk, so that ids are gathered in one go.
        at_end = np.searchsorted(bounds[:-1], offsets[1:]) if n else np.zeros(texts, np.int64)
        if end_id is not None:
            codes = np.insert(codes, at_end, len(lengths))
            begins = np.append(begins, len(flat))
            lengths = np.append(lengths, 1)
            flat = np.append(flat, np.uint32(end_id))
            at_end = at_end + np.arange(1, texts + 1)
        sizes = lengths[codes]
        ends = np.cumsum(sizes)
        source = np.repeat(begins[codes] - (ends - sizes), sizes)
        source += np.arange(len(source))
        first = np.zeros(texts + 1, np.int64)
        first[1:] = np.concatenate([[0], ends])[at_end]
        return flat[source], first


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, special_as_text: bool = False) -> Encoder:
    """One encoder per worker process and file."""
    key = (path, special_as_text)
    if key not in _encoders:
        _encoders[key] = Encoder(path, special_as_text)
    return _encoders[key]
