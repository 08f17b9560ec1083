"""What several corpus operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.store import stored
from ..session import prepare

__all__ = ["bind", "columns_of", "documents", "read", "source_rank", "stored", "text_of", "words"]

SPACE = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents")


def columns_of(rows: DataFrame, without: set[str]) -> list[Column]:
    """The columns of ``rows`` but those named; any name is taken as it is, dots included."""
    return [rows[f"`{c}`"] for c in rows.columns if c not in without]


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def words(text: Column) -> Column:
    """Words are runs of anything but space and the controls 9 to 13."""
    return F.filter(F.split(text, SPACE, -1), lambda w: w != "")


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def source_rank(sources: DataFrame, name: str, rank: str) -> DataFrame:
    """Number distinct names 0, 1, .. by code point, null last, with no task that sorts them all.

    Names are dealt to ranges, numbered within their range, and start after the
    counts of the ranges before it; there are as many counts as ranges.
    """
    ranged = stored(
        sources.select(name).distinct()
        .repartitionByRange(F.col(name).isNull(), F.col(name))
        .withColumn("__part", F.spark_partition_id()), "ranges")
    from pyspark.sql import Window
    inside = Window.partitionBy("__part").orderBy(F.col(name).asc_nulls_last())
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (ranged.groupBy("__part").agg(F.count("*").alias("__n"))
              .select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start")))
    return (ranged.withColumn("__place", F.row_number().over(inside) - 1)
            .join(F.broadcast(starts), "__part")
            .select(name, (F.col("__start") + F.col("__place")).alias(rank)))
