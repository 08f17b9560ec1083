"""Site-relative line frequency: lines that too many pages of their host repeat are dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns_of, stored

#: A line is boilerplate from this share of its host's pages on ...
RATIO = 0.1
#: ... if so many pages hold it at least; below that a share says nothing.
MIN_PAGES = 5

BLANK = " \t\r\x0b\x0c"


def _lines(text: str) -> Column:
    return F.split(F.col(text), "\n", -1)


def _digest(line: Column) -> Column:
    """128 bits of a line without outer blanks; null for a blank line."""
    bare = F.btrim(line, F.lit(BLANK))
    return F.when(bare != "", F.struct(F.xxhash64(bare).alias("a"),
                                       F.xxhash64(F.lit(1), bare).alias("b")))


def boilerplate(pages: DataFrame, host: str = "source", text: str = "text",
                ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, lines): the digests of each host's boilerplate.

    A page counts once for a line it repeats; copies of a page count each. A
    host has fewer such lines than its pages have on average divided by
    ``ratio``, so a row is bounded by a few pages, not by the host.
    """
    here = pages.select(F.col(host).alias("host"), _lines(text).alias("lines"))
    held = (here.select("host", F.explode(F.array_distinct(F.filter(
                F.transform("lines", _digest), lambda d: d.isNotNull()))).alias("line"))
            .groupBy("host", "line").agg(F.count("*").alias("n"))
            .where(F.col("n") >= min_pages))
    totals = (pages.groupBy(F.col(host).alias("of")).agg(F.count("*").alias("pages")))
    return (held.join(totals, held["host"].eqNullSafe(totals["of"]))
            .where(F.col("n") >= F.lit(ratio) * F.col("pages"))
            .groupBy("host").agg(F.collect_list("line").alias("lines")))


def drop_lines(pages: DataFrame, host: str = "source", text: str = "text",
               ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``pages`` with boilerplate lines cut from their texts, and n_lines, n_dropped (long).

    Lines end at ``\\n`` and compare without outer blanks; blank lines stay. A
    null text stays null with no lines, an empty one has one blank line; a null
    host is a host like others; columns that are named like the two new ones
    are replaced. What remains of a page stays in order, and a page may become
    empty, never vanish. The lists of boilerplate are written first, so that the
    planner knows their size and broadcasts them only if they are small.
    """
    lists = stored(boilerplate(pages, host, text, ratio, min_pages)
                   .select(F.col("host").alias("__of"), F.col("lines").alias("__lines")), "lines")
    joined = pages.join(lists, pages[f"`{host}`"].eqNullSafe(lists["__of"]), "left")
    kept = joined.withColumn("__kept", F.when(
        F.col("__lines").isNull(), _lines(text)).otherwise(F.filter(
            _lines(text), lambda x: ~F.coalesce(
                F.array_contains(F.col("__lines"), _digest(x)), F.lit(False)))))
    total = F.coalesce(F.size(_lines(text)), F.lit(0))
    return kept.select(
        *[F.array_join("__kept", "\n").alias(text) if c == text else kept[f"`{c}`"]
          for c in pages.columns if c not in ("n_lines", "n_dropped")],
        F.when(F.col(text).isNull(), 0).otherwise(total).cast("long").alias("n_lines"),
        F.when(F.col(text).isNull(), 0).otherwise(total - F.size("__kept"))
        .cast("long").alias("n_dropped"))


def refreshed(docs: DataFrame, text: str = "text") -> DataFrame:
    """``n_chars`` again in step with the text; null for a null text."""
    return docs.withColumn("n_chars", F.length(text).cast("long"))
