"""Share of each type of cell, one row per table, computed inside the row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..sources.tables import TABLE_KEY
from .verdict import is_genuine


def type_fractions(typed: DataFrame) -> DataFrame:
    """Shares of the seven types over all cells, repeated ones counted; -1 without cells."""
    n = F.size("_types")

    def share(name):
        return F.size(F.filter("_types", lambda t: t == name)) / n
    shares = [F.when(n == 0, F.lit(-1.0)).otherwise(share(name)).alias(feature)
              for name, feature in fixed.FEATURE_OF_TYPE.items()]
    types = F.transform(F.flatten("rows"), lambda c: c["type"])
    rest = [c for c in typed.columns if c not in ("rows", "placed")]
    return typed.withColumn("_types", types).select(*rest, *shares)


def summaries(judged: DataFrame) -> DataFrame:
    """(key, verdict, message, status, shares, ``consistency``): a small row for each table, from which verdicts,
    ``features`` and ``feature_failures`` can be read without its cells."""
    key = [c for c in judged.columns if c in TABLE_KEY + ["kind"]]
    return type_fractions(judged).select(*key, "verdict", "message", "status", *fixed.FEATURES, _consistency())


def _consistency() -> Column:
    return F.when(is_genuine(), 1).otherwise(-1).alias("consistency")


def features(judged: DataFrame) -> DataFrame:
    """What the model gets: seven shares and ``consistency`` (1 genuine by rule, else -1).

    Tables that could not be read have no features; see ``feature_failures``.
    ``judged`` may also hold ``summaries``.
    """
    key = [c for c in judged.columns if c in TABLE_KEY + ["kind"]]
    readable = judged.where(F.col("status") == "ok")
    if "consistency" in judged.columns:
        return readable.select(*key, *fixed.FEATURES, "consistency")
    return type_fractions(readable).select(*key, *fixed.FEATURES, _consistency())


def feature_failures(judged: DataFrame) -> DataFrame:
    key = [c for c in judged.columns if c in TABLE_KEY + ["kind"]]
    return judged.where(F.col("status") != "ok").select(*key, F.col("message").alias("failure"))


def matrix_digest(feature_rows: DataFrame) -> DataFrame:
    """One fingerprint of all features, rounded to 12 digits, whatever their order."""
    row = F.to_json(F.struct(*TABLE_KEY, *[F.round(f, 12).alias(f) for f in fixed.FEATURES],
                             "consistency"))
    return (feature_rows.select(F.sha2(row, 256).alias("digest"))
            .agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("digest")).alias("digest_xor"),
                 F.sum(F.xxhash64("digest").cast("decimal(38,0)")).alias("digest_sum")))


def correlations(feature_rows: DataFrame) -> DataFrame:
    """Pearson correlation of every two features over consistent tables, in one pass;
    null for a feature that never varies."""
    names = fixed.FEATURES
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1:]]
    sums = (feature_rows.where("consistency = 1")
            .agg(*[F.var_pop(f).alias(f"v_{f}") for f in names],
                 *[F.covar_pop(a, b).alias(f"c_{a}_{b}") for a, b in pairs]))

    def r(a, b):
        both = F.col(f"v_{a}") * F.col(f"v_{b}")
        varies = (F.col(f"v_{a}") > 1e-12) & (F.col(f"v_{b}") > 1e-12)
        return F.when(varies, F.col(f"c_{a}_{b}") / F.sqrt(both))
    rows = [F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"),
                     r(a, b).alias("r")) for a, b in pairs]
    return sums.select(F.explode(F.array(*rows)).alias("x")).select("x.*")
