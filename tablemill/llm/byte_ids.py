"""Ids of a public byte-level vocabulary, and where its tokens can end a sentence."""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache

import numpy as np

from .vocabulary import byte_letters

#: Characters that a worker remembers the ids of, and as many again for each entry; then it starts anew.
REMEMBERED, ENTRY = 100_000_000, 60

#: Characters on whose class every version of Unicode agrees: printable ASCII, line feed and tab, letters of
#: Latin, and marks of prose.
_PLAIN = re.compile("[\n\t\x20-\x7E\xA1\xAB\xBB\xBFÀ-ÖØ-öø-ɏ‐-‧]*")
#: Before a blank that follows a visible ASCII character no token and no rule of the vocabulary reaches over.
_APART = re.compile(r"(?<=[!-~])(?=[ \n])")


def default_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder(dict):
    """Texts to ids as little-endian unsigned 32-bit numbers, as the library gives them.

    No token and no rule of the vocabulary reaches over a blank that follows
    something visible, so the ids of what stands between two blanks, with the
    blank before it, are asked for once and remembered. They come from the
    ranked form of the same vocabulary, which is several times faster on short
    texts. Where three blanks meet, or two at the end, they may form one token,
    and the whole text is asked for. Parts with characters outside ``_PLAIN`` or
    with a special token go to the library.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        super().__init__()
        self._library = Tokenizer.from_file(path)
        letters = {c: b for b, c in enumerate(byte_letters())}
        tokens = {bytes(letters[c] for c in token): i
                  for token, i in self._library.get_vocab(with_added_tokens=False).items()
                  if i not in self._library.get_added_tokens_decoder()}
        self._ranked = tiktoken.Encoding("ranked", pat_str=public_tokenizers.PATTERN, mergeable_ranks=tokens,
                                         special_tokens={}).encode_ordinary
        self._held = 0
        self._set_marks(tokens)

    def __missing__(self, unit: str) -> bytes:
        ids = self[unit] = self._plain(unit)
        self._held += len(unit) + ENTRY
        return ids

    def _plain(self, text: str) -> bytes:
        return array("I", self._ranked(text)).tobytes()

    def _set_marks(self, tokens: dict[bytes, int]) -> None:
        """For each id: it ends in a mark that ends a sentence; it begins with a blank, with a line feed; it ends in one."""
        self.closes, self.blank, self.line, self.after_line = np.zeros((4, self._library.get_vocab_size()), bool)
        for value, i in tokens.items():
            self.closes[i] = value.rstrip(b"\"')]")[-1:] in (b".", b"!", b"?")
            self.blank[i] = value[:1] in (b" ", b"\n", b"\t")
            self.line[i], self.after_line[i] = value[:1] == b"\n", value[-1:] == b"\n"

    def _part(self, text: str) -> bytes:
        if "<|" in text or not _PLAIN.fullmatch(text):
            got = self._library.encode(text, add_special_tokens=False).ids
            return np.asarray(got, dtype="<u4").tobytes()
        level = text.replace("\n", " ")
        if "\t" in text or "   " in level or level[-2:] == "  ":
            return self._plain(text)
        units = text.replace("\n", "\0\n").replace(" ", "\0 ").split("\0")
        return b"".join(map(self.__getitem__, units))

    def __call__(self, text: str) -> bytes:
        if self._held > REMEMBERED:
            self.clear()
            self._held = 0
        if "<|" in text or not _PLAIN.fullmatch(text):
            return b"".join(map(self._part, _APART.split(text)))
        return self._part(text)

    def sentence_ends(self, ids: np.ndarray) -> np.ndarray:
        """Places p after which a new sentence or line begins: between ids[p - 1] and ids[p]."""
        a, b = ids[:-1], ids[1:]
        return np.flatnonzero((self.closes[a] & self.blank[b]) | (self.line[b] & ~self.after_line[a])) + 1


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)
