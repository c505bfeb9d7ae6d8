"""Token ids of whole texts from a ``tokenizers`` file, at the cost of one model call per distinct piece.

White space separates words that the file's normalizer and pre-tokenizer never join, so the ids of a text are the
ids of its words in order. Each worker keeps a bounded table of words seen and one of pieces seen.
"""

from __future__ import annotations

import re

import numpy as np
from tokenizers import Tokenizer

#: Words, and pieces, that a worker remembers at most, and their greatest length: tables are bounded in bytes too. A full
#: one is emptied, which costs time but no result.
REMEMBERED, SHORT = 500_000, 64
_OPEN: dict[tuple[str, bool], WordTokens] = {}


def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: printable Latin-1 stands for itself."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class WordTokens(dict):
    """Word -> its number of ids or (``ids=True``) its ids as little-endian uint32. ``words`` splits a text.

    A word is what stands between two spaces, tabs or line ends of the raw text. One of Latin-1 letters, perhaps with a final mark,
    is lowered and goes to the model as it is; any other goes through the library whole.
    """

    def __init__(self, path: str, ids: bool):
        super().__init__()
        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        self.added = {t.content: i for i, t in self.whole.get_added_tokens_decoder().items()}
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.ids, self.pieces, self.model, self.letters = ids, {}, self.whole.model, byte_letters()
        self.empty = b"" if ids else 0
        probe = "Aé,b."  # the short way only where it gives what the library gives
        self.short = self.value(self.whole.encode(probe, add_special_tokens=False).ids) == self.join([self.piece(x) for x in ("aé", ",", "b", ".")])

    @classmethod
    def open(cls, path: str, ids: bool) -> WordTokens:
        if (path, ids) not in _OPEN:
            _OPEN[path, ids] = cls(path, ids)
        return _OPEN[path, ids]

    def value(self, ids: list[int]) -> bytes | int:
        return np.array(ids, dtype="<u4").tobytes() if self.ids else len(ids)

    def join(self, values: list) -> bytes | int:
        return b"".join(values) if self.ids else sum(values)

    def piece(self, text: str) -> bytes | int:
        if (found := self.pieces.get(text)) is None:
            if len(self.pieces) >= REMEMBERED:
                self.pieces.clear()
            found = self.value([x.id for x in self.model.tokenize(self.spelt(text))])
            if len(text) <= SHORT:
                self.pieces[text] = found
        return found

    def spelt(self, text: str) -> str:
        """Text in the letters that the vocabulary writes for its bytes."""
        return text.encode().decode("latin-1").translate(self.letters)

    def plain(self, word: str) -> list[str] | None:
        """The pieces of a word of Latin-1 letters, perhaps with a final mark; None for any other."""
        body, mark = (word, "") if word.isalpha() else (word[:-1], word[-1:])
        if self.short and mark in ("", ".", ",", ";", ":", "!", "?") and body.isalpha() and body.isascii() | (max(body) < "\u0100"):
            return [body.lower(), mark] if mark else [body.lower()]
        return None

    def pretokens(self, word: str) -> list[str]:
        """What the model takes one by one, in the vocabulary's letters."""
        if not word:
            return []
        if found := self.plain(word):
            return [*map(self.spelt, found)]
        return [x for x, _ in self.whole.pre_tokenizer.pre_tokenize_str(self.whole.normalizer.normalize_str(word))]

    def __missing__(self, word: str | tuple) -> bytes | int:
        if isinstance(word, tuple):
            return self.value(list(word))
        if len(self) >= REMEMBERED:
            self.clear()
        if not word:
            out = self.empty
        elif found := self.plain(word):
            out = self.join([*map(self.piece, found)])
        else:
            out = self.value(self.whole.encode(word, add_special_tokens=False).ids)
        if len(word) <= SHORT:
            self[word] = out
        return out

    def words(self, text: str | None) -> list:
        """Words of a text in order, empty ones too; an added token of the raw text stands as a tuple of its id."""
        if not text:
            return []
        if not self.special or len(parts := self.special.split(text)) == 1:
            return text.replace("\n", " ").replace("\t", " ").split(" ")
        return [w for i, p in enumerate(parts) for w in ([(self.added[p],)] if i % 2 else p.replace("\n", " ").replace("\t", " ").split(" "))]
