"""Which sources of a language differ most, and in which terms: exact sums over joint level tables."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: A term counts in a language from so many of its documents on.
LEAST = 30
#: Added to each count, and the number that shares are stated in parts of.
ADDED, PARTS = 5, 1_000_000_000
#: Ranks that are listed of the terms of a group.
LISTED = 50
#: Terms and sources on a side of one block of the product.
TERMS, SOURCES = 4096, 64
#: Distinct terms that a task holds before it passes their counts on, and bytes of text split at once.
HELD, PIECE = 400_000, 1 << 23

#: ASCII letters in lower case, other ASCII to blanks, all bytes of other characters as they are.
_LETTERS = bytes(ord(chr(b).lower()) if chr(b).isalpha() and b < 128 else b if b > 127 else 32
                 for b in range(256))

_COUNTS = "lang string, source string, term binary, count long, docs long"
_BLOCK = ["source", "side", "term", "count", "p", "p0"]


def _terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, a bounded piece of it at a time; a cut never falls into a term."""
    at = 0
    while at < len(text):
        end = at + PIECE
        part = text[at:end].translate(_LETTERS)
        if end < len(text):
            kept = part.rfind(b" ")
            while kept < 0:                                   # one term longer than a piece
                end += PIECE
                part = text[at:end].translate(_LETTERS)
                kept = part.rfind(b" ") if end < len(text) else len(part)
            part, end = part[:kept], at + kept
        yield part.split()
        at = end + (end == at)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts and documents of each term by group; each group seen also gives a row without a term."""
    groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    seen: set[tuple[str, str]] = set()

    def emptied() -> Iterator[pa.RecordBatch]:
        for (lang, source), (times, docs) in groups.items():
            marks = [] if (lang, source) in seen else [None]
            seen.add((lang, source))
            n = len(marks) + len(times)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()),
                 pa.array([*marks, *times], pa.binary()),
                 pa.array([*([0] * len(marks)), *times.values()], pa.int64()),
                 pa.array([*([0] * len(marks)), *map(docs.__getitem__, times)], pa.int64())],
                names=["lang", "source", "term", "count", "docs"])
        groups.clear()

    held = 0
    for batch in batches:
        for lang, source, text in zip(*(c.to_pylist() for c in batch.columns)):
            times, docs = groups.setdefault((lang, source), (Counter(), Counter()))
            held -= len(times)
            once: set[bytes] = set()
            for words in _terms(text):
                times.update(words)
                once.update(words)
            docs.update(once)
            held += len(times)
            if held > HELD:
                yield from emptied()
                held = 0
    yield from emptied()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, count, docs): occurrences of each term in each group, and documents that hold it.

    Null text, lang and source are empty texts. A group also has one row with a
    null term. Tasks add up what they read before anything is shuffled.
    """
    plain = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")],
                        F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    return (plain.mapInArrow(_counted, _COUNTS)
            .withColumn("term", F.col("term").cast("string"))
            .groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs")))


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(PARTS (count + ADDED) / (total + ADDED terms)), in exact decimals; null without terms."""
    wide = "decimal(20,0)"
    top = F.lit(PARTS).cast("decimal(10,0)") * (count + ADDED).cast(wide)
    return F.when(terms > 0, F.call_function("div", top, (total + ADDED * terms).cast(wide)) + 1)


def priced(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(entries, groups), both stored.

    entries: (lang, source, term, count, p, q) of the kept terms that a group holds;
    groups: (lang, source, n, v, lang_n, p0), every group with its count over kept
    terms, the number of kept terms, the count in its language, its share at count 0.
    """
    counts = stored(term_counts(docs), "term_counts")
    kept = (counts.where("term IS NOT NULL").groupBy("lang", "term")
            .agg(F.sum("docs").alias("docs"), F.sum("count").alias("total"))
            .where(F.col("docs") >= least).drop("docs"))
    kept = stored(kept, "kept_terms")
    held = stored(counts.drop("docs").join(kept, ["lang", "term"]), "held_terms")
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("lang_n"))
    sums = held.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    groups = (counts.where("term IS NULL").select("lang", "source")
              .join(sums, ["lang", "source"], "left").join(langs, "lang", "left")
              .na.fill(0, ["n", "v", "lang_n"])
              .withColumn("p0", share(F.lit(0).cast("long"), F.col("n"), F.col("v"))))
    groups = stored(groups, "groups")
    entries = held.join(groups.drop("p0"), ["lang", "source"]).select(
        "lang", "source", "term", "count", share(F.col("count"), F.col("n"), F.col("v")).alias("p"),
        share(F.col("total"), F.col("lang_n"), F.col("v")).alias("q"))
    return stored(entries, "priced_terms"), groups


def _blocks(entries: DataFrame, groups: DataFrame, terms: int, sources: int) -> DataFrame:
    """Rows of the indicator matrix dealt to blocks (lang, block, low, high): a block of terms by two of sources.

    Each group also goes to every block of terms once without a term, as some of its terms may be absent there.
    """
    sides = groups.groupBy("lang").agg(
        F.ceil(F.count("*") / sources).cast("int").alias("sides"),
        F.greatest(F.ceil(F.max("v") / terms), F.lit(1)).cast("int").alias("blocks"))
    of = F.pmod(F.xxhash64("source"), F.col("sides")).cast("int")
    marks = (groups.join(sides, "lang")
             .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("lang", "source", F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("count"),
                     F.col("p0").alias("p"), "p0", "sides", "block"))
    held = entries.join(sides, "lang").select(
        "lang", "source", "term", "count", "p", F.lit(None).cast("long").alias("p0"), "sides",
        F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int").alias("block"))
    return (held.unionByName(marks).withColumn("side", of)
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("sides") - 1)))
            .select("lang", "block", F.least("side", "other").alias("low"),
                    F.greatest("side", "other").alias("high"), *_BLOCK))


class _Product:
    """One block of the indicator matrix and of its product with its transpose.

    A column stands for (source, count), count 0 included; ``grid`` holds for each
    term and source the one column that has a 1. ``tables`` yields the product a
    row of blocks at a time: for a source, the pairs of columns that meet in some
    term, and in how many.
    """

    def __init__(self, rows: pd.DataFrame, low: int, high: int):
        self.names, source = np.unique(rows["source"].to_numpy(dtype=object), return_inverse=True)
        marks = rows["term"].isna().to_numpy()
        level = rows["count"].to_numpy(np.int64)
        _, first, column = np.unique(np.stack([source, level]), axis=1, return_index=True, return_inverse=True)
        column = column.reshape(-1)
        self.source, self.level = source[first], level[first]
        self.price = rows["p"].fillna(0).to_numpy(np.int64)[first]
        self.zero = np.zeros(len(self.names), np.int64)
        self.zero[source[marks]] = column[marks]
        self.side = np.zeros(len(self.names), np.int64)
        self.side[source] = rows["side"].to_numpy()
        term = pd.factorize(rows["term"])[0]
        self.grid = np.tile(self.zero, (term.max(initial=-1) + 1, 1))
        self.grid[term[~marks], source[~marks]] = column[~marks]
        self.one_side, self.low = low == high, low

    def tables(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        every = np.arange(len(self.names))
        for s in every:
            if self.side[s] == self.low:
                right = every[every > s] if self.one_side else every[self.side != self.low]
                codes = self.grid[:, s, None] * len(self.price) + self.grid[:, right]
                met, n = np.unique(codes, return_counts=True)
                yield s, right, met // len(self.price), met % len(self.price), n


def joint_tables(entries: DataFrame, groups: DataFrame, terms: int = TERMS, sources: int = SOURCES) -> DataFrame:
    """(lang, a, a_count, b, b_count, terms): for every two sources of a language, how many kept terms
    have these two counts; terms that neither holds are not listed.

    Each pair of sources is listed in one direction. Pass what ``priced`` returns.
    """
    def tables(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        block, out = _Product(rows, *key[2:]), []
        for _, _, a, b, n in block.tables():
            shown = (block.level[a] > 0) | (block.level[b] > 0)
            a, b = a[shown], b[shown]
            out.append(pd.DataFrame({"a": block.names[block.source[a]], "a_count": block.level[a],
                                     "b": block.names[block.source[b]], "b_count": block.level[b], "terms": n[shown]}))
        out = pd.concat(out) if out else pd.DataFrame(columns=["a", "a_count", "b", "b_count", "terms"])
        return out.assign(lang=key[0])[["lang", "a", "a_count", "b", "b_count", "terms"]]

    schema = "lang string, a string, a_count long, b string, b_count long, terms long"
    return (_blocks(entries, groups, terms, sources).groupBy("lang", "block", "low", "high")
            .applyInPandas(tables, schema)
            .groupBy("lang", "a", "a_count", "b", "b_count").agg(F.sum("terms").alias("terms")))


def pair_distances(entries: DataFrame, groups: DataFrame, terms: int = TERMS, sources: int = SOURCES) -> DataFrame:
    """(lang, source, item, value) of every two sources of a language, in both directions: the sum of
    abs(p - q) over all kept terms.

    The joint tables are priced block by block, so that one number for each block
    and pair is shuffled. A block adds what its terms have beyond two counts of 0;
    the rest is the number of terms times the price of (0, 0).
    """
    def prices(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        block, out = _Product(rows, *key[2:]), []
        none = block.price[block.zero]
        for s, right, a, b, n in block.tables():
            beyond = np.zeros(len(block.names), np.int64)
            of = block.source[b]
            np.add.at(beyond, of, n * (np.abs(block.price[a] - block.price[b]) - np.abs(none[s] - none[of])))
            out.append(pd.DataFrame({"a": block.names[s], "b": block.names[right], "beyond": beyond[right],
                                     "apart": np.abs(none[s] - none[right])}))
        out = pd.concat(out) if out else pd.DataFrame(columns=["a", "b", "beyond", "apart"])
        return out.assign(lang=key[0])[["lang", "a", "b", "beyond", "apart"]]

    summed = (_blocks(entries, groups, terms, sources).groupBy("lang", "block", "low", "high")
              .applyInPandas(prices, "lang string, a string, b string, beyond long, apart long")
              .groupBy("lang", "a", "b").agg(F.sum("beyond").alias("beyond"), F.max("apart").alias("apart")))
    kept = groups.groupBy("lang").agg(F.max("v").alias("v"))
    value = F.col("beyond") + F.col("v") * F.col("apart")
    ways = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")),
                             F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    return (summed.join(kept, "lang").select("lang", value.alias("value"), ways.alias("way"))
            .select("lang", "way.source", "way.item", "value"))


def audit(docs: DataFrame, least: int = LEAST, listed: int = LISTED,
          terms: int = TERMS, sources: int = SOURCES) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source is from the others of its language, and its
    own most overused terms.

    ``pair``: every other source of the language by the sum of differences of
    shares over all kept terms, 0 if there are none. ``term``: up to ``listed``
    terms whose share is above that in the language. Ranks start at 1 for each
    group and part, by value from the largest, then by item as UTF-8.

    Null text, lang and source are empty texts, so a null and an empty source are
    one group. Repeated rows count as often as they stand there. A group
    without terms has pairs. A text of any length is read in pieces. Other columns
    are not looked at. An empty table gives no rows. Counts are exact up to
    nine quintillion.
    """
    entries, groups = priced(docs, least)
    pair = pair_distances(entries, groups, terms, sources)
    term = entries.where("count > 0 AND p > q").select(
        "lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")

    def ranked(rows: DataFrame, part: str) -> DataFrame:
        return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value",
                           F.row_number().over(order).alias("rank"))
    return ranked(pair, "pair").unionByName(ranked(term, "term").where(F.col("rank") <= listed))
