"""Greedy longest-match word-piece counts by an automaton that never goes back in a word."""

from __future__ import annotations

import json
import re
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vocabulary import byte_letters, default_path

WORD_END = "</w>"
#: Characters of words that a worker remembers the counts of; then it starts anew.
REMEMBERED = 12_000_000
ENTRY = 30


class LongestMatch:
    """Counts the pieces that greedy longest match cuts a word into, in time linear in the word.

    States are the nodes of the vocabulary's trie over units; the last unit is
    the word's end. Each state has the state it falls back to once the longest
    piece in it is cut off, and the number of pieces that this cuts off. So a word is
    read once, and no piece is ever built.
    """

    def __init__(self, pieces: list[tuple]):
        self.go: list[dict] = [{}]
        whole = [False]
        for piece in pieces:
            at = 0
            for unit in piece:
                after = self.go[at].get(unit)
                if after is None:
                    after = self.go[at][unit] = len(self.go)
                    self.go.append({})
                    whole.append(False)
                at = after
            whole[at] = True
        self.back: list[int | None] = [None] * len(self.go)
        self.popped = [0] * len(self.go)
        queue = deque([0])
        while queue:                                # shorter prefixes first
            node = queue.popleft()
            for unit, after in self.go[node].items():
                queue.append(after)
                if whole[after]:                    # a piece itself: cut it off, start afresh
                    self.back[after], self.popped[after] = 0, 1
                    continue
                place, cut = self.back[node], self.popped[node]
                while place is not None and unit not in self.go[place]:
                    cut += self.popped[place]
                    place = self.back[place]
                if place is not None:
                    self.back[after], self.popped[after] = self.go[place][unit], cut

    def count(self, units) -> int | None:
        """The number of pieces; None if some unit begins no piece."""
        go, back, popped = self.go, self.back, self.popped
        at = n = 0
        for unit in units:
            while unit not in go[at]:
                n += popped[at]
                at = back[at]
                if at is None:
                    return None
            at = go[at][unit]
        while at:
            n += popped[at]
            at = back[at]
            if at is None:
                return None
        return n


class Counter:
    """Pieces of a text: lower-cased, cut into runs of letters, digits alone, and runs of the
    rest, each as the letters of its bytes and an end mark."""

    RUNS = re.compile(r"[^\W\d_]+|\d|(?:[^\w\s]|_)+")

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            vocabulary = json.load(file)["model"]["vocab"]
        self.automaton = LongestMatch([self.units(p) for p in vocabulary])
        self._letters = dict(enumerate(byte_letters()))
        self._known, self._held = {"": 0}, 0

    @staticmethod
    def units(piece: str) -> tuple:
        ended = piece.endswith(WORD_END) and piece != WORD_END
        return (*piece.removesuffix(WORD_END), WORD_END) if ended else tuple(piece)

    def _count(self, part: str) -> int:
        total = 0
        for run in self.RUNS.findall(part.lower()):
            letters = run if run.isascii() else run.encode("utf-8", "replace").decode("latin-1")
            n = self.automaton.count((*letters.translate(self._letters), WORD_END))
            total += 1 if n is None else n          # a run outside the vocabulary is one unknown
        return total

    def __call__(self, text: str) -> tuple[int, int]:
        """(words between blanks, pieces)"""
        if self._held > REMEMBERED:
            self._known, self._held = {"": 0}, 0
        known, total, words = self._known, 0, text.split()
        for word in words:
            n = known.get(word)
            if n is None:
                n = known[word] = self._count(word)
                self._held += len(word) + ENTRY
            total += n
        return len(words), total


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def count_pieces(docs: DataFrame, path: str | None = None, text: str = "text") -> DataFrame:
    """``docs`` without texts, with n_blank_words and n_pieces (long) over whole texts.

    A null or empty text has none of either. Other columns stay, rows as they
    are, repeated ones too; columns named like the new ones are replaced.
    """
    path = path or default_path()

    @F.pandas_udf("n_blank_words long, n_pieces long")
    def counts(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        count = counter(path)
        for batch in texts:
            yield pd.DataFrame([count(t) for t in batch], columns=["n_blank_words", "n_pieces"])

    new = {"n_blank_words", "n_pieces", text}
    return (docs.withColumn("__counts", counts(F.coalesce(text, F.lit(""))))
            .select(*[docs[f"`{c}`"] for c in docs.columns if c not in new], "__counts.*"))
