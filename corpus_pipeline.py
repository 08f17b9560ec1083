"""A corpus made ready for training: each stage reads all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tablemill.llm import line_dedup, mixing, near_dup, packing, toxicity
from tablemill.llm.common import documents, read, stored

#: SQL cannot state a fitted chain, a sketch or greedy packing.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain rejects go."""
    return toxicity.accepted(docs, read(spark, sf_dir, "labels"))


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that too many documents of their source repeat go; the documents stay, n_chars in step."""
    kept = line_dedup.drop_lines(docs)
    return line_dedup.refreshed(kept.select(*docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return near_dup.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of the sources takes it."""
    return mixing.repeated(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and place there."""
    return packing.pack_documents(docs)


STAGES = [("toxicity", drop_toxic), ("line dedup", drop_boilerplate),
          ("near duplicates", drop_near_duplicates), ("source mixing", mix_sources),
          ("packing", pack_sequences)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
