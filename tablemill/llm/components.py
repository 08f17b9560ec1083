"""Connected components of a table of links, by rounds of joins that spread over all tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

ROUNDS = 60


def components(links: DataFrame, first: str = "a", second: str = "b") -> DataFrame:
    """(node, root): every node of ``links`` with the smallest node it reaches.

    Alternates two steps until nothing moves: each node ties its larger
    neighbours to its smallest, then its smaller ones. A node with very many
    links only gives a minimum to a join; its links are never gathered. Each
    round is written, so a lost executor costs one round. An empty table has no nodes.
    """
    edges = stored(links.select(F.greatest(first, second).alias("u"), F.least(first, second).alias("v"))
                   .where("u <> v").distinct(), "links")
    def mark(rows: DataFrame) -> tuple:
        return tuple(rows.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())

    state = mark(edges)
    for _ in range(ROUNDS):
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u <> v").distinct())
        large = stored(large, "large_star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        edges = stored(small.select(F.col("v").alias("u"), F.col("m").alias("v"))
                       .union(least.select("u", F.col("m").alias("v")))
                       .where("u <> v").distinct(), "small_star")
        before, state = state, mark(edges)
        if state == before:
            break
    else:
        raise RuntimeError(f"components still change after {ROUNDS} rounds")
    return (edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
            .union(edges.select("v", "v").distinct()))
