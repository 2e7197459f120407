"""Byte-level BPE through the tokenizers library, with whole words remembered.

A byte-level BPE of the regex-split kind never merges across its pre-token
boundaries, and a single space always starts a new pre-token.  So the ids of a
text are those of its space-separated pieces, joined; frequent pieces are
encoded once per worker.  Runs of spaces and a space at the end are where a
boundary depends on what follows: such texts are cut by the general rule.
Texts that hold an added token of the file (such as an end mark) go through the
library whole, which finds those tokens before anything else.
"""

from __future__ import annotations

import gc
import json
import re
import sys
from array import array
from collections.abc import Iterator

import numpy as np

#: Unicode White_Space, which the splitting rule calls \s (fixed values).
_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SPACE_CHAR = re.compile(f"[{_SPACE}]")
#: Text between two places where a pre-token boundary is certain.
_GENERAL = re.compile(f"[{_SPACE}]+(?![^{_SPACE}])| ?[^{_SPACE}]+|[{_SPACE}]")
#: Letters, digits and marks for which every regex engine agrees: ASCII and Latin-1.
_L = "A-Za-zÀ-ÖØ-öø-ÿ"
_P = "!-/:-@\\[-`{-~"
_PLAIN = re.compile(f" ?[{_L}0-9{_P}]+")
_PRE = re.compile(f"'(?:s|t|re|ve|m|ll|d)| ?[{_L}]+| ?[0-9]+| ?[{_P}]+")
_CLOSING = frozenset(",.;:!?")
_LINE = re.compile(f"([^{_SPACE}]+)\n([^{_SPACE}]+)")


class _Pieces(dict):
    """piece -> ids as little-endian uint32 bytes, for pieces that were asked for twice.

    Most distinct pieces of a corpus come once; a table of hash marks keeps those
    out, so that the frequent ones stay.  Both are emptied when they are full.
    """

    MARKS = 1 << 22

    def __init__(self, encode, limit: int):
        super().__init__()
        self.encode, self.limit = encode, limit
        self.marks, self.marked = bytearray(self.MARKS), 0

    def __missing__(self, piece: str) -> bytes:
        got = self.encode(piece)
        at = hash(piece) & (self.MARKS - 1)
        if self.marks[at]:
            if len(piece) <= 64:
                if len(self) >= self.limit:
                    self.clear()
                self[piece] = got
        else:
            self.marks[at] = 1
            self.marked += 1
            if self.marked > self.MARKS // 2:
                self.marks, self.marked = bytearray(self.MARKS), 0
        return got


def worker_encoder(path: str) -> Encoder:
    """The encoder of this Python worker, kept from task to task with the pieces it remembers."""
    kept = sys.__dict__.setdefault("_loomstone_encoders", {})
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]


class _Units(dict):
    """character -> its UTF-8 bytes in the byte alphabet; there are at most as many as characters."""

    def __init__(self, alphabet: dict[int, str]):
        super().__init__()
        self.alphabet = alphabet

    def __missing__(self, c: str) -> str:
        self[c] = got = "".join(self.alphabet[b] for b in c.encode())
        return got


class Encoder:
    """``ids(text)`` equals the library's encoding of the text.

    path: a tokenizers JSON file.  limit: how many pieces to remember, which
    bounds memory (about 200 bytes each).
    """

    def __init__(self, path: str, limit: int = 250_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = [re.escape(t["content"]) for t in spec.get("added_tokens") or [] if t["content"]]
        self._added = re.compile("|".join(added)).search if added else lambda text: None
        pre = spec.get("pre_tokenizer") or {}
        self.by_piece = (
            not spec.get("normalizer")
            and pre.get("type") == "ByteLevel"
            and pre.get("use_regex", True)
            and not pre.get("add_prefix_space", True)
        )
        self.vocab_size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
        hidden = [b for b in range(256) if b not in set(shown)]
        self._units = _Units({b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)})
        self._model = self.tokenizer.model
        self._words = _Pieces(self._word, limit)
        self._bare = _Pieces(self._piece, limit)
        self._spaced = _Pieces(self._spaced_piece, limit)

    def _word(self, word: str) -> bytes:
        """One pre-token, shown in the byte alphabet."""
        units = "".join(map(self._units.__getitem__, word))
        return array("I", [t.id for t in self._model.tokenize(units)]).tobytes()

    def _piece(self, piece: str) -> bytes:
        if not _PLAIN.fullmatch(piece):
            return np.asarray(self._encode(piece), dtype="<u4").tobytes()
        parts = _PRE.findall(piece)
        if len(parts) == 1:
            return self._word(piece)
        return b"".join(map(self._words.__getitem__, parts))

    def _spaced_piece(self, piece: str) -> bytes:
        if piece.isalpha():  # letters only: one pre-token
            return self._word(" " + piece)
        if piece[-1:] in _CLOSING and piece[:-1].isalpha():
            return self._words[" " + piece[:-1]] + self._bare[piece[-1]]
        if "\n" in piece and (m := _LINE.fullmatch(piece)):
            return self._spaced[m[1]] + self._bare["\n"] + self._bare[m[2]]
        return self._piece(" " + piece)

    def _encode(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def packed(self, text: str | None) -> bytes:
        """The ids as little-endian uint32 bytes; null is empty."""
        if not text:
            return b""
        if not self.by_piece or self._added(text):
            return np.asarray(self._encode(text), dtype="<u4").tobytes()
        if "  " in text or _SPACE_CHAR.match(text[-1]):
            return b"".join(map(self._bare.__getitem__, _GENERAL.findall(text)))
        pieces = text.split(" ")
        first = self._bare[pieces[0]] if pieces[0] else b""
        return first + b"".join(map(self._spaced.__getitem__, pieces[1:]))

    def __call__(self, texts) -> Iterator[bytes]:
        """The packed ids of each text; the collector of cycles rests meanwhile, since nothing here makes cycles."""
        was = gc.isenabled()
        gc.disable()
        try:
            yield from map(self.packed, texts)
        finally:
            if was:
                gc.enable()

    def ids(self, text: str | None) -> np.ndarray:
        return np.frombuffer(self.packed(text), dtype="<u4")
