"""Packing in the order of the documents: cuts chosen by dynamic programming over a monotone queue."""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

from .byte_ids import default_path, encoder

LENGTH = 2048
#: The id that ends each document.
END = 1
#: Tokens of consecutive documents whose cuts are chosen together; a longer document is taken whole.
TOGETHER = 1 << 18


class Price(NamedTuple):
    """What a cut costs in padding tokens, by where it falls, and each sequence besides."""
    sentence: int = 2
    inside: int = 12
    sequence: int = 8
    #: Where no sentence ends for so many tokens, cuts inside it are offered that far apart.
    apart: int = 32


def best_cuts(places: list[int], costs: list[int], room: int, each: int) -> tuple[list[int], list[int]]:
    """(cost, before): the least cost of a sequence of windows that ends at each place, and where its last begins.

    ``places`` rise from 0 by at most ``room``; a window between two of them is
    at most ``room`` long and costs what it lacks to ``room``, nothing if its
    length is a power of two, ``costs`` of its end, and ``each``. For a fixed
    end the first part only depends on cost[i] + places[i] of the beginning,
    whose least value over the last ``room`` tokens stands first in a queue
    that is kept rising; beginnings a power of two away are found beforehand. Longer windows win ties.
    """
    n, at = len(places), np.asarray(places)
    index = np.full(at[-1] + 1, -1)
    index[at] = np.arange(n)
    ends, begins = [], []
    for power in (1 << k for k in range(room.bit_length() - 1, -1, -1)):
        j = np.flatnonzero(at >= power)
        i = index[at[j] - power]
        ends.append(j[i >= 0])
        begins.append(i[i >= 0])
    order = np.argsort(np.concatenate(ends), kind="stable")
    begin = np.concatenate(begins)[order].tolist()
    first = np.searchsorted(np.concatenate(ends)[order], np.arange(n + 1)).tolist()

    cost, before, key = [0] * n, [0] * n, [0] * n
    queue: deque[int] = deque([0])
    for j in range(1, n):
        here = places[j]
        low = here - room
        while places[queue[0]] < low:
            queue.popleft()
        i = queue[0]
        least = key[i] + room - here
        for k in begin[first[j]:first[j + 1]]:
            if cost[k] < least:
                i, least = k, cost[k]
        least += costs[j] + each
        cost[j], before[j], key[j] = least, i, least + here
        while queue and key[queue[-1]] > key[j]:
            queue.pop()
        queue.append(j)
    return cost, before


def offered(ends: np.ndarray, sentences: np.ndarray, price: Price) -> tuple[np.ndarray, np.ndarray]:
    """(places, costs) of possible cuts: ends of documents, of sentences, and more where these are far apart."""
    total = int(ends[-1])
    cut = np.zeros(total + 1, bool)
    cut[0] = cut[sentences] = cut[ends] = True
    places = np.flatnonzero(cut)
    more = (np.diff(places) - 1) // price.apart                # further cuts in each gap
    gap = np.repeat(np.arange(len(more)), more)
    step = np.arange(len(gap)) - np.repeat(np.cumsum(more) - more, more) + 1
    cut[places[gap] + step * price.apart] = True
    places = np.flatnonzero(cut)
    costs = np.full(total + 1, price.inside)
    costs[sentences] = price.sentence
    costs[ends] = 0
    return places, costs[places]


class _Stream:
    """Documents whose tokens are not yet all in sequences."""

    def __init__(self, encode, length: int, price: Price):
        self.encode, self.length, self.price = encode, length, price
        self.held: list[tuple] = []          # (doc_id, ids left, ids before them, ids in all)
        self.tokens = self.sequence = 0
        self.rows: list[tuple] = []

    def add(self, doc, ids: bytes) -> None:
        n = len(ids) // 4
        self.held.append((doc, ids, 0, n))
        self.tokens += n
        if self.tokens >= max(TOGETHER, 2 * self.length):
            self.cut(last=False)

    def cut(self, last: bool) -> None:
        """Close sequences; unless it is the last time, up to the place among the last ``length`` tokens where the
        cost so far lies lowest against the mean cost of a token, and what follows waits for more."""
        if not self.held:
            return
        stream = memoryview(b"".join(d[1] for d in self.held))
        ends = np.cumsum([len(d[1]) // 4 for d in self.held])
        places, costs = offered(ends, self.encode.sentence_ends(np.frombuffer(stream, "<u4")), self.price)
        at = places.tolist()
        cost, before = best_cuts(at, costs.tolist(), self.length, self.price.sequence)
        j = len(at) - 1
        if not last:
            first = int(np.searchsorted(places, places[-1] - self.length, "right"))
            j = first + int(np.argmin(np.asarray(cost[first:]) * at[-1] - places[first:] * cost[-1]))
        cuts = [j]
        while cuts[-1]:
            cuts.append(before[cuts[-1]])
        self._close(stream, ends, [at[k] for k in reversed(cuts)])

    def _close(self, stream: memoryview, ends: np.ndarray, cuts: list[int]) -> None:
        done = cuts[-1]
        borders = np.unique(np.concatenate([cuts, ends[ends < done]]))
        docs = np.searchsorted(ends, borders[:-1], "right")
        windows = np.searchsorted(cuts, borders[:-1], "right") - 1
        begins = np.concatenate([[0], ends])
        for a, b, d, w in zip(borders[:-1].tolist(), borders[1:].tolist(), docs.tolist(), windows.tolist()):
            doc, _, skipped, total = self.held[d]
            self.rows.append((doc, skipped + a - int(begins[d]), b - a, zlib.crc32(stream[4 * a:4 * b]), total,
                              self.sequence + w, a - cuts[w]))
        self.sequence += len(cuts) - 1
        left = int(np.searchsorted(ends, done, "right"))
        kept = self.held[left:]
        if kept:
            doc, ids, skipped, total = kept[0]
            gone = done - int(begins[left])
            kept[0] = (doc, ids[4 * gone:], skipped + gone, total)
        self.held, self.tokens = kept, int(ends[-1]) - done


def pack_in_order(docs: DataFrame, length: int = LENGTH, path: str | None = None, end: int = END,
                  price: Price = Price(), text: str = "text") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of every piece of every document.

    The documents of a partition stand one after another, in the order read, as
    ids and ``end``, and are cut into sequences of at most ``length``. A sequence
    is padded to ``length`` unless its own length is a power of two. The cuts
    have the least padding and ``price``; they fall on ends of documents and
    sentences, and inside a sentence only if that is long and it pays. Nothing
    is shuffled and a task holds ``TOGETHER`` tokens, or one document if that is
    longer, whose text its row holds anyway. Pass a table as read or stored, whose
    partitions are the same when a task runs again.

    A null or empty text is ``end`` alone. Repeated rows and rows without doc_id
    are documents like others. Other columns are not looked at. An empty table
    has no pieces.
    """
    path = path or default_path()
    kind = docs.schema["doc_id"].dataType
    schema = StructType([StructField("doc_id", kind), *[StructField(c, LongType()) for c in (
        "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, last = encoder(path), np.asarray([end], dtype="<u4").tobytes()
        stream = _Stream(encode, length, price)
        stream.sequence = TaskContext.get().partitionId() << 32
        as_arrow = to_arrow_schema(schema)

        def made() -> Iterator[pa.RecordBatch]:
            if stream.rows:
                columns = list(zip(*stream.rows))
                stream.rows = []
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, as_arrow)],
                                                 schema=as_arrow)
        for batch in batches:
            for doc, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                stream.add(doc, encode(words) + last)
            yield from made()
        stream.cut(last=True)
        yield from made()

    return docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("text")).mapInArrow(cut, schema)
