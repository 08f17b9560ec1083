"""Sum-of-squares packing of tokenized documents into sequences of a fixed length."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import stored
from .vocabulary import default_path, encoder

LENGTH = 2048
#: The id that ends each document.
END = 0
#: Pieces that are packed by one task.
GROUP = 8192

PIECES = "piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, length: int = LENGTH, path: str | None = None,
           end: int = END, text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document, by the library's ids.

    A document is its ids and ``end``; only one longer than ``length`` is cut,
    into pieces of that length and a rest. A null or empty text is ``end``
    alone. Repeated rows and rows without doc_id are documents like others.
    """
    path = path or default_path()
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids_of, last = encoder(path), np.asarray([end], dtype="<u4").tobytes()
        for batch in batches:
            out = []
            for doc, words in zip(batch["doc_id"], batch["text"]):
                ids = ids_of(words) + last
                for k, at in enumerate(range(0, len(ids), 4 * length)):
                    part = ids[at:at + 4 * length]
                    out.append((None if pd.isna(doc) else doc, k, k * length, len(part) // 4,
                                zlib.crc32(part)))
            yield pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"]
                               ).astype({"doc_id": "Int64"} if kind == "bigint" else {})

    return (docs.select("doc_id", F.coalesce(text, F.lit("")).alias("text"))
            .mapInPandas(cut, f"doc_id {kind}, {PIECES}"))


def sum_of_squares(lengths: list[int], room: int) -> list[list[int]]:
    """Places lengths in the order given; returns the positions in each sequence.

    Each goes where the sum, over all gaps, of the squared number of open
    sequences with that gap grows least; a full sequence counts no more, and of
    equal places the one with the smallest gap is taken.
    """
    count = np.zeros(room + 1, dtype=np.int64)
    open_: list[list[int]] = [[] for _ in range(room + 1)]
    made: list[list[int]] = []
    never = np.int64(1) << 60
    for at, size in enumerate(lengths):
        if size < room:
            grows = np.where(count[size:room] > 0,
                             2 * (count[:room - size] - count[size:room] + 1), never)
            if count[size] > 0:
                grows[0] = 1 - 2 * count[size]
            gap = int(grows.argmin())
            old = grows[gap] <= 2 * count[room - size] + 1
        else:
            gap, old = 0, False
        if old:
            count[gap + size] -= 1
            here = open_[gap + size].pop()
        else:
            gap, here = room - size, len(made)
            made.append([])
        made[here].append(at)
        if gap:
            count[gap] += 1
            open_[gap].append(here)
    return made


def packed(lengths: list[int], room: int) -> list[list[int]]:
    """Sum of squares from the longest down; the sequences left open are emptied and placed
    again, for as long as that makes fewer."""
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    done: list[list[int]] = []
    before = None
    while True:
        made = [[order[i] for i in one] for one in sum_of_squares([lengths[i] for i in order], room)]
        if before is not None and len(made) >= len(before):
            return done + before
        full = [sum(lengths[i] for i in one) == room for one in made]
        done += [one for one, f in zip(made, full) if f]
        before = [one for one, f in zip(made, full) if not f]
        order = sorted((i for one in before for i in one), key=lambda i: -lengths[i])


def pack(parts: DataFrame, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """``parts``, a stored table as of ``pieces``, with sequence_id and offset.

    Pieces are dealt evenly, by a digest, to groups of about ``group``, and each
    group is packed by one task; groups share no sequence. Columns besides those
    of ``pieces`` stay; earlier ones named sequence_id and offset are replaced.
    """
    parts = parts.drop("sequence_id", "offset")
    groups = max(1, math.ceil(parts.count() / group))
    names = parts.columns
    schema = StructType([*parts.schema.fields, StructField("sequence_id", LongType()),
                         StructField("offset", LongType())])

    def place(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "piece", "ids_crc32"], kind="stable").reset_index(drop=True)
        sizes = rows["length"].tolist()
        sequence, offset = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        for number, members in enumerate(packed(sizes, length)):
            at = 0
            for i in members:
                sequence[i], offset[i] = number, at
                at += sizes[i]
        return rows[names].assign(sequence_id=int(key[0]) * (1 << 32) + sequence, offset=offset)

    dealt = parts.withColumn("__group", F.pmod(
        F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)))
    return dealt.groupBy("__group").applyInPandas(place, schema)


def pack_documents(docs: DataFrame, length: int = LENGTH, path: str | None = None) -> DataFrame:
    return pack(stored(pieces(docs, length, path), "pieces"), length)
