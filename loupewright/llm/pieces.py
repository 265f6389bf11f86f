"""Splitting texts into the pieces that byte-level tokenizers encode one by one.

Both libraries scan a text from the left with the same public pattern; what follows a match depends
on nothing before its end. Texts of common Latin characters go through an equal pattern of the
faster standard ``re``; all others through the exact one.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable

import public_tokenizers
import regex

_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
#: Characters about whose class both patterns agree without question.
_OTHER = re.compile(rf"[^\t\n\r\x20-\x7e{_LETTERS}¡-©«-±´¶-¸»¿×÷‐-‧€]")
_FAST = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{_LETTERS}]+| ?[0-9]+| ?[^\s{_LETTERS}0-9]+|\s+(?!\S)|\s+")
_EXACT = regex.compile(public_tokenizers.PATTERN)

#: Pieces a worker remembers before it starts over.
REMEMBERED = 800_000


def is_plain(text: str) -> bool:
    return text.isascii() and text.isprintable() or _OTHER.search(text) is None


def split(text: str) -> list[str]:
    return (_FAST if is_plain(text) else _EXACT).findall(text)


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte that they don't write as itself.

    Bytes that print in Latin-1 stand for themselves, the others for the characters from 256 on.
    """
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    return dict(zip((b for b in range(256) if b not in own), map(chr, range(256, 512))))


_LETTER_OF = _byte_letters()


def lettered(piece: str) -> str:
    """A piece as byte-level vocabularies write it."""
    if piece.isascii() and piece.isprintable():
        return piece.replace(" ", _LETTER_OF[0x20])
    return piece.encode().decode("latin-1").translate(_LETTER_OF)


class Remembered:
    """Ids of pieces, as packed unsigned 32-bit integers, by piece; bounded in size."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], most: int = REMEMBERED):
        self.encode, self.most = encode, most
        self.known: dict[str, bytes] = {}

    def learn(self, pieces: list[str]) -> None:
        missing = list(set(pieces).difference(self.known))
        if missing:
            if len(self.known) + len(missing) > self.most:
                self.known.clear()
                missing = list(set(pieces))
            for piece, ids in zip(missing, self.encode(missing)):
                self.known[piece] = array("I", ids).tobytes()

    def packed(self, pieces: list[str]) -> list[bytes]:
        self.learn(pieces)
        return list(map(self.known.__getitem__, pieces))


class LibraryCoder:
    """The ids that the tokenizers library gives, with each piece encoded by the library's model once.

    Its special strings are cut out first, as the library does by default.
    """

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = {t.content: array("I", [i]).tobytes() for i, t in self.library.get_added_tokens_decoder().items()}
        self._cut = re.compile("|".join(f"({re.escape(s)})" for s in self.special)) if self.special else None
        self.memory = Remembered(lambda new: [[t.id for t in self.library.model.tokenize(lettered(p))] for p in new])
        self.odd = Remembered(lambda new: [[t.id for t in self.library.model.tokenize(p)] for p in new])

    def encode(self, text: str) -> tuple[list[str], list[bytes]]:
        """The pieces of a text and the packed ids of each."""
        parts = [text]
        if self._cut is not None and any(s in text for s in self.special):
            parts = [p for p in self._cut.split(text) if p]
        pieces: list[str] = []
        packed: list[bytes] = []
        for part in parts:
            if part in self.special:
                pieces.append(part)
                packed.append(self.special[part])
            elif is_plain(part):
                found = _FAST.findall(part)
                pieces += found
                packed += self.memory.packed(found)
            else:
                found = self.library.pre_tokenizer.pre_tokenize_str(part)
                pieces += [part[a:b] for _, (a, b) in found]
                packed += self.odd.packed([p for p, _ in found])
        return pieces, packed


_CODERS: dict[str, LibraryCoder] = {}


def library_coder(path: str) -> LibraryCoder:
    """One coder per worker process and file."""
    if path not in _CODERS:
        _CODERS[path] = LibraryCoder(path)
    return _CODERS[path]
