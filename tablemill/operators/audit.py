"""Comparing with labels, and one run with another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..sources.tables import TABLE_KEY, record_id
from .store import unsent


def record_verdicts(records: DataFrame, judged: DataFrame) -> DataFrame:
    """Label join: each record with the verdict on its first table.

    ``judged`` comes from the same records (``labelled_pages``); a record without
    any table is a layout error.
    """
    first = judged.where(F.col("table_idx") == 0).select("page_id", "verdict", "message")
    return (records.select(record_id(records).alias("page_id"), "key", "name", "verification")
            .join(unsent(first), "page_id", "left")
            .withColumn("message", F.when(F.col("verdict").isNull(), F.lit(
                "LayoutError: " + fixed.NO_TABLE_IN_RECORD)).otherwise(F.col("message")))
            .withColumn("verdict", F.coalesce("verdict", F.lit("LayoutError"))))


def confusion(rows: DataFrame, predicted: str, label: str = "verification") -> DataFrame:
    """tp, tn, fp, fn with respect to the label ``genuine``."""
    p, h = F.col(predicted) == fixed.GENUINE_LABEL, F.col(label) == fixed.GENUINE_LABEL
    return rows.where(F.col(label) != fixed.UNLABELLED).agg(
        F.count_if(p & h).alias("tp"), F.count_if(~p & ~h).alias("tn"),
        F.count_if(p & ~h).alias("fp"), F.count_if(~p & h).alias("fn"))


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))


def scores(counts: DataFrame) -> DataFrame:
    """Precision, recall and F1 of the counts, zero-safe, six digits."""
    tp = F.col("tp")
    p, r = _ratio(tp, tp + F.col("fp")), _ratio(tp, tp + F.col("fn"))
    return (counts.withColumn("p", p).withColumn("r", r)
            .withColumn("f", _ratio(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")))
            .select("tp", "tn", "fp", "fn", F.round("p", 6).alias("precision"),
                    F.round("r", 6).alias("recall"), F.round("f", 6).alias("f1")))


def class_balance(records: DataFrame, label: str = "verification") -> DataFrame:
    """Counts per label, share of the largest, ratio of largest to smallest."""
    counts = records.groupBy(label).count()
    return counts.agg(F.max("count").alias("largest"), F.min("count").alias("smallest"),
                      F.sum("count").alias("n")).select(
        "n", "largest", "smallest", (F.col("largest") / F.col("smallest")).alias("ratio"),
        (F.col("largest") / F.col("n")).alias("majority_accuracy"))


def mismatches(joined: DataFrame) -> DataFrame:
    """Records on which rule and label differ, and why the rule said so."""
    rule, human = F.col("verdict") == fixed.GENUINE_LABEL, F.col("verification") == fixed.GENUINE_LABEL
    kind = F.when(rule & ~human, "FP").when(~rule & human, "FN")
    return (joined.where(F.col("verification") != fixed.UNLABELLED)
            .withColumn("mismatch", kind).where(F.col("mismatch").isNotNull())
            .select("key", "name", "mismatch",
                    F.when(F.col("mismatch") == "FN", F.concat("verdict", F.lit(": "), "message"))
                    .alias("reason")))


def page_summary(pages: DataFrame, verdict_rows: DataFrame) -> DataFrame:
    """Tables and genuine tables per page; pages without tables count 0."""
    counts = verdict_rows.groupBy("page_id").agg(
        F.count("*").alias("tables"),
        F.count_if(F.col("verdict") == fixed.GENUINE_LABEL).alias("genuine"))
    return (pages.select("page_id").join(unsent(counts), "page_id", "left")
            .na.fill(0, ["tables", "genuine"]))


def verdict_breakdown(verdict_rows: DataFrame) -> DataFrame:
    return verdict_rows.groupBy("verdict").agg(F.count("*").alias("n"))


def snapshot_diff(before: DataFrame, after: DataFrame, key: list[str], value: str,
                  missing: str = fixed.MISSING_RECORD) -> DataFrame:
    """Keys of either run whose value changed; a key of one run only shows a marker."""
    joined = (before.select(*key, F.col(value).alias("was"), F.lit(True).alias("_b"))
              .join(after.select(*key, F.col(value).alias("now"), F.lit(True).alias("_a")),
                    key, "full_outer"))
    return (joined.withColumn("was", F.when(F.col("_b"), F.col("was").cast("string"))
                              .otherwise(missing))
            .withColumn("now", F.when(F.col("_a"), F.col("now").cast("string"))
                        .otherwise(missing))
            .where(~F.col("was").eqNullSafe(F.col("now"))).select(*key, "was", "now"))


def first_differences(diff: DataFrame, key: list[str], n: int = 25) -> DataFrame:
    """The report lists the first ``n`` differences by key."""
    return diff.orderBy(*key).limit(n)


def feature_vector() -> Column:
    """Features as one text, rounded to 12 digits, to compare runs by."""
    values = [F.round(f, 12) for f in fixed.FEATURES] + [F.col("consistency").cast("double")]
    return F.to_json(F.array(*values))


def tall(scores_: DataFrame, key: str = "stage") -> DataFrame:
    """Scores as (stage, metric, value)."""
    pairs = [F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value"))
             for c in scores_.columns if c != key]
    return scores_.select(key, F.explode(F.array(*pairs)).alias("x")).select(key, "x.*")


def compare_metrics(before: DataFrame, after: DataFrame) -> DataFrame:
    """(stage, metric, was, now, delta) of two score tables."""
    was, now = tall(before).withColumnRenamed("value", "was"), tall(after).withColumnRenamed("value", "now")
    return was.join(now, ["stage", "metric"]).withColumn("delta", F.round(F.col("now") - F.col("was"), 6))


def all_labels(*columns: DataFrame) -> DataFrame:
    """Distinct values of one-column tables."""
    out = columns[0]
    for more in columns[1:]:
        out = out.union(more)
    return out.distinct()
