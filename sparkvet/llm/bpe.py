"""Exact token ids of the public tokenizers by whole-text pieces that repeat.

A text is cut at single spaces between two characters that are not white space. No pre-token crosses such a cut, so
the pieces can be encoded on their own and kept in a bounded cache of the worker. Pieces outside the plain character
range, pieces that may hold a special string and texts with runs of white space go to the library itself.
"""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache

PLAIN = re.compile("[\t\n\r\x20-\x7e¡-įı-ɏ]+")
GAP = re.compile(r"(?<=\S) (?=\S)")
CACHE_ENTRIES = 600_000
LONGEST_KEPT = 40
MARKS = frozenset(b"%c" % c for c in b".,;:!?)")


class Irregular(Exception):
    """The text holds white space that makes cutting at each single space unsafe."""


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def load(path: str):
    """A library tokenizer with its defaults."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class _Kept(dict):
    """A bounded map that fills itself; when full, it starts anew from what was given first."""

    def __init__(self, make, start: dict | None = None):
        super().__init__(start or {})
        self.make, self.start = make, start or {}

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= LONGEST_KEPT:
            if len(self) >= CACHE_ENTRIES + len(self.start):
                self.clear()
                self.update(self.start)
            self[key] = value
        return value


class PieceEncoder:
    """Encodes UTF-8 texts into little-endian uint32 ids (`ids`) or their number (`count`).

    frequent: number of tokens of pieces that occur often, each piece as it follows a space; see token_counts.
    """

    def __init__(self, path: str, frequent: dict[bytes, int] | None = None):
        import regex

        self.library = load(path)
        self.model = self.library.model
        self.letters = _byte_letters()
        self.words = "word_bpe" in path.rpartition("/")[2]
        if self.words:
            self.pattern = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
        else:
            self.pattern = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
        self.pre = _Kept(self._pre_token)
        self.spaced = _Kept(self._spaced)
        self.counts = _Kept(lambda piece: len(self._spaced(piece)) // 4, frequent)

    def _pack(self, ids: list[int]) -> bytes:
        import numpy as np

        return np.array(ids, dtype="<u4").tobytes()

    def _pre_token(self, text: str) -> bytes:
        mapped = text.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(mapped)]).tobytes()

    def _whole(self, text: str) -> bytes:
        return self._pack(self.library.encode(text, add_special_tokens=False).ids)

    def _word(self, letters: bytes) -> bytes:
        """Ids of a word of ASCII letters that follows a single space; such letters stand for themselves in the byte alphabet."""
        text = letters.lower().decode() if self.words else "\u0120" + letters.decode()
        return array("I", [t.id for t in self.model.tokenize(text)]).tobytes()

    def _spaced(self, piece: bytes) -> bytes:
        """Ids of a piece that follows a single space."""
        if piece.isalpha():
            return self._word(piece)
        if piece[-1:] in MARKS and piece[:-1].isalpha():  # a mark behind a word is a pre-token of its own
            return self.spaced[piece[:-1]] + self.pre[piece[-1:].decode()]
        text = piece.decode()
        if text.isalpha() and PLAIN.fullmatch(text):  # one pre-token
            return self._pre_token(text.lower() if self.words else " " + text)
        if self.words:
            return self._plain(text) if text else b""
        if not text or text[0].isspace() or text[-1].isspace():
            raise Irregular
        return self._plain(" " + text)

    def _plain(self, text: str) -> bytes:
        if "<|" in text or not PLAIN.fullmatch(text):
            return self._whole(text)
        return b"".join([self.pre[p] for p in self.pattern.findall(text.lower() if self.words else text)])

    def _first(self, piece: bytes) -> bytes:
        """Ids of the piece at the start of a text."""
        if not piece:
            return b""
        text = piece.decode()
        if not self.words and text[-1].isspace():
            raise Irregular
        return self._plain(text)

    def ids(self, text: bytes) -> bytes:
        pieces = text.split(b" ")
        try:
            first = self._first(pieces[0])
            del pieces[0]
            return first + b"".join(map(self.spaced.__getitem__, pieces))
        except Irregular:
            pieces = GAP.split(text.decode())
            return b"".join([self._plain(pieces[0]), *(self._plain(" " + p) for p in pieces[1:])])

    def count(self, text: bytes) -> int:
        pieces = text.split(b" ")
        try:
            first = len(self._first(pieces[0])) // 4
            del pieces[0]
            return first + sum(map(self.counts.__getitem__, pieces))
        except Irregular:
            return len(self.ids(text)) // 4


@lru_cache(maxsize=4)
def encoder(path: str) -> PieceEncoder:
    """One encoder for each tokenizer file and worker."""
    return PieceEncoder(path)


def forget() -> None:
    """Drops the encoders of this worker and what they keep."""
    encoder.cache_clear()
