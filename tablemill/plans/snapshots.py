"""Frozen runs, and what changed between two of them, found through digests of buckets."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import fixed
from ..operators import audit, features, learn, verdict
from ..operators.store import stored, unsent
from ..sources.tables import TABLE_KEY, labelled_pages, record_id

#: Records that a bucket holds on average.
BUCKET_RECORDS = 100_000


class Part(NamedTuple):
    """A part of a snapshot that is stored in buckets: its key, and what a comparison looks at."""
    key: list[str]
    value: str
    missing: str


BUCKETED = {
    "verdicts": Part(["page_id"], "verdict", fixed.MISSING_RECORD),
    "features": Part(TABLE_KEY, "vector", fixed.MISSING_RECORD),
    "failures": Part(TABLE_KEY, "failure", fixed.MISSING_RECORD),
    "predictions": Part(TABLE_KEY, "prediction", fixed.MISSING_PREDICTION),
}
PARTS = [*BUCKETED, "metrics", "digest", "tree", "schemas"]


def _hash(*columns) -> Column:
    return F.xxhash64(*columns)


def _tree(rows: DataFrame, name: str, part: Part) -> DataFrame:
    """(part, bucket, n, a, b): count and digest of each bucket, and of all of them as bucket -1.

    A digest is a sum of 128 bits a row, so that of several buckets, or of all,
    is the sum of theirs, and the order of rows does not matter.
    """
    wide = "decimal(38,0)"
    parts = [F.sum(_hash(F.lit(salt), *part.key, part.value).cast(wide)).cast(wide).alias(x) for salt, x in ((1, "a"), (2, "b"))]
    leaves = rows.groupBy("bucket").agg(F.count("*").alias("n"), *parts)
    top = leaves.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), *[F.sum(x).cast(wide).alias(x) for x in "ab"])
    return (leaves.select(F.lit(name).alias("part"), "bucket", "n", "a", "b")
            .unionByName(top.select(F.lit(name).alias("part"), F.lit(-1).alias("bucket"), "n", "a", "b")))


def bucket_count(records: int) -> int:
    """A power of two, so that the buckets of a smaller run are unions of those of a larger."""
    return 1 << max(4, (max(records, 1) // BUCKET_RECORDS).bit_length())


def write_snapshot(records: DataFrame, model: learn.GatedModel, path: str, buckets: int | None = None) -> None:
    """Freeze a run as Parquet: verdicts, features, failures, predictions, scores, and one
    row with the number of records and the digest of all features.

    The first four are dealt to ``buckets`` (a power of two) by a digest of
    the record, one folder each, verdicts also by verdict; ``tree`` holds the
    digests of buckets and parts. Records without a label have features and
    predictions, but no verdict and no part in the scores.
    """
    spark = records.sparkSession
    n = records.count()
    buckets = buckets or bucket_count(n)
    if buckets & (buckets - 1):
        raise ValueError(f"the number of buckets must be a power of two: {buckets}")
    judged = stored(features.summaries(verdict.judge(labelled_pages(records)).where("table_idx = 0")), "judged")
    labels = records.select(record_id(records).alias("page_id"), "verification")
    known = records.where(F.col("verification") != fixed.UNLABELLED)
    schemas, trees = [], []

    def put(rows: DataFrame, name: str, folders: tuple[str, ...] = ()) -> DataFrame:
        if name in BUCKETED:
            rows = rows.withColumn("bucket", F.pmod(_hash("page_id"), F.lit(buckets)).cast("int"))
            # rows of a bucket meet in one task and fill one file for each folder
            rows = rows.repartition("bucket")
            folders = (*folders, "bucket")
        rows.write.mode("overwrite").partitionBy(*folders).parquet(f"{path}/{name}")
        schemas.append((name, rows.schema.json()))
        back = spark.read.schema(rows.schema).parquet(f"{path}/{name}")
        if name in BUCKETED:
            trees.append(_tree(back, name, BUCKETED[name]))
        return back

    verdicts = put(audit.record_verdicts(known, judged), "verdicts", ("verdict",))
    rows = put(features.features(judged).withColumn("vector", audit.feature_vector()), "features")
    put(features.feature_failures(judged), "failures")
    predictions = put(model.predict(rows).select(*TABLE_KEY, "prediction"), "predictions")
    rule = audit.scores(audit.confusion(verdicts, "verdict")).withColumn("stage", F.lit("rule"))
    both = audit.scores(audit.confusion(predictions.join(unsent(labels), "page_id"), "prediction")) \
        .withColumn("stage", F.lit("rule and model"))
    put(rule.unionByName(both), "metrics")
    put(features.matrix_digest(rows).select("*", F.lit(n).cast("long").alias("records"), F.lit(buckets).alias("buckets")), "digest")
    tree = trees[0]
    for more in trees[1:]:
        tree = tree.unionByName(more)
    put(tree, "tree")
    spark.createDataFrame(schemas, "part string, schema string").coalesce(1).write.mode("overwrite").parquet(f"{path}/schemas")


def read_snapshot(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The parts by name; a part without rows has its columns all the same."""
    import json
    schemas = spark.read.schema("part string, schema string").parquet(f"{path}/schemas").collect()      # a row per part
    return {r.part: spark.read.schema(T.StructType.fromJson(json.loads(r.schema))).parquet(f"{path}/{r.part}") for r in schemas}


def changed_buckets(before: dict[str, DataFrame], after: dict[str, DataFrame]) -> tuple[int, dict[str, list[int]]]:
    """The coarser of the two numbers of buckets, and for each part the buckets, out of so many, that differ.

    First the parts' own digests are compared, a row each, then only the buckets
    of those that differ. Of a finer tree several buckets add up to one of the coarser.
    """
    few = min(r.first().buckets for r in (before["digest"], after["digest"]))

    def at(snapshot: dict[str, DataFrame], rows: Column) -> DataFrame:
        return (snapshot["tree"].where(rows).withColumn("bucket", F.when(F.col("bucket") < 0, -1).otherwise(F.col("bucket") % few))
                .groupBy("part", "bucket").agg(*[F.sum(c).alias(c) for c in ("n", "a", "b")]))

    def differing(rows: Column) -> list:
        was, now = at(before, rows), at(after, rows)
        both = was.join(now, ["part", "bucket"], "full_outer")
        same = F.lit(True)
        for c in ("n", "a", "b"):
            same = same & was[c].eqNullSafe(now[c])
        return both.where(~same).select("part", "bucket").orderBy("part", "bucket").collect()
    parts = [r.part for r in differing(F.col("bucket") < 0)]
    found: dict[str, list[int]] = {name: [] for name in BUCKETED}
    if parts:
        for r in differing((F.col("bucket") >= 0) & F.col("part").isin(parts)):
            found[r.part].append(r.bucket)
    return few, found


def only_buckets(rows: DataFrame, few: int, buckets: list[int]) -> DataFrame:
    """``rows`` of a part in some buckets out of ``few``; folders of other buckets are not opened."""
    return rows.where((F.col("bucket") % few).isin(buckets))


def compare_snapshots(before: dict[str, DataFrame], after: dict[str, DataFrame]) -> DataFrame:
    """Everything that changed between two runs: (part, key, was, now).

    Of the bucketed parts only buckets whose digests differ are read; scores are a few rows.
    """
    few, changed = changed_buckets(before, after)

    def diff(name: str, part: Part, was: DataFrame, now: DataFrame) -> DataFrame:
        return audit.snapshot_diff(was, now, part.key, part.value, part.missing).select(
            F.lit(name).alias("part"), F.concat_ws("/", *part.key).alias("key"), "was", "now")

    def rounded(rows: DataFrame) -> DataFrame:
        return audit.tall(rows).withColumn("value", F.round("value", 6))
    out = diff("metrics", Part(["stage", "metric"], "value", fixed.MISSING_RECORD), rounded(before["metrics"]), rounded(after["metrics"]))
    for name, part in BUCKETED.items():
        if changed[name]:
            out = out.unionByName(diff(name, part, *[only_buckets(s[name], few, changed[name]) for s in (before, after)]))
    return out
