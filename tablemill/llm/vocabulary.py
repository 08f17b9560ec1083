"""Ids of a public tokenizer's file, by its library; the file's path is a parameter."""

from __future__ import annotations

import os
import re
from functools import lru_cache

#: Characters of text, and as many again for each entry, that a worker remembers the ids of; then it starts anew.
REMEMBERED = 36_000_000
ENTRY = 30

#: Letters that normalisation leaves alone but for their case; the capital dotted I becomes two characters.
LETTERS = r"A-Za-zÀ-ÖØ-öø-įı-ɏ"
_PLAIN = re.compile(rf"([{LETTERS}]+)([.,!?;:]?)")


def default_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies: itself if
    printable, else the next one free from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    free = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(free)) for b in range(256)]


class Encoder:
    """Texts to ids as little-endian unsigned 32-bit numbers.

    The vocabulary served here, word_bpe_49k, drops white space and never joins across it, so a
    text's ids are those of its parts between blanks, and each distinct part is
    encoded once. Only blank, line feed and tab part a text; the library
    alone decides about any other space. A part of letters, with a mark behind
    it at most, goes straight to the library's model; any other takes its whole path.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self._library = Tokenizer.from_file(path)
        self._model = self._library.model
        self._letters = {b: c for b, c in enumerate(byte_letters())}
        self._forget()

    def _forget(self) -> None:
        self._parts, self._held, self._words = {"": b""}, 0, {}

    def _ids(self, part: str) -> bytes:
        import numpy as np
        plain = _PLAIN.fullmatch(part)
        if not plain:
            got = self._library.encode(part, add_special_tokens=False).ids
            return np.asarray(got, dtype="<u4").tobytes()
        word, mark = plain[1].lower(), plain[2]
        ids = self._words.get(word)
        if ids is None:
            units = word if word.isascii() else (
                word.encode().decode("latin-1").translate(self._letters))
            ids = np.asarray([t.id for t in self._model.tokenize(units)], dtype="<u4").tobytes()
            self._words[word] = ids
            self._held += len(word) + ENTRY
        return ids + self._parts[mark] if mark in self._parts else ids + self._mark(mark)

    def _mark(self, mark: str) -> bytes:
        import numpy as np
        got = self._library.encode(mark, add_special_tokens=False).ids
        self._parts[mark] = np.asarray(got, dtype="<u4").tobytes()
        return self._parts[mark]

    def __call__(self, text: str) -> bytes:
        if self._held > REMEMBERED:
            self._forget()
        known, parts = self._parts, text.replace("\n", " ").replace("\t", " ").split(" ")
        for part in parts:
            if part not in known:
                known[part] = self._ids(part)
                self._held += len(part) + ENTRY
        return b"".join([known[p] for p in parts])


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)
