"""Exact ranks in groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 4096


def exact_rank(rows: DataFrame, groups: list[str], digest: Column, name: str) -> DataFrame:
    """Number the rows of each group 1, 2, .. in the order of a hexadecimal digest.

    A window over a whole group would sort it in one task. Here rows are numbered
    inside the 4096 buckets that the first three digits of the digest spread a
    group over, and each bucket starts after the count of the buckets before it.
    The counts are at most 4096 per group. ``rows`` is read twice: pass a stored
    table.
    """
    cut = (rows.withColumn("_digest", digest)
           .withColumn("_bucket", F.conv(F.substring("_digest", 1, 3), 16, 10).cast("int")))
    before = (Window.partitionBy(*groups).orderBy("_bucket")
              .rowsBetween(Window.unboundedPreceding, -1))
    starts = (cut.groupBy(*groups, "_bucket").agg(F.count("*").alias("_n"))
              .withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
              .drop("_n"))
    inside = Window.partitionBy(*groups, "_bucket").orderBy("_digest")
    return (cut.withColumn("_place", F.row_number().over(inside))
            .join(starts, [*groups, "_bucket"])
            .withColumn(name, F.col("_start") + F.col("_place"))
            .drop("_digest", "_bucket", "_place", "_start"))


def stratified_folds(rows: DataFrame, label: str, key: str, seed: int = 42,
                     folds: int = 5) -> DataFrame:
    """Spread the rows of each label evenly and reproducibly over ``folds``."""
    digest = F.md5(F.concat(F.col(key).cast("string"), F.lit(f"/{seed}")))
    return (exact_rank(rows, [label], digest, "_rank")
            .withColumn("fold", ((F.col("_rank") - 1) % folds).cast("int")).drop("_rank"))
