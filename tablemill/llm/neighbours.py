"""Approximate nearest neighbours by inner product: an inverted multi-index over two vector halves."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

NEAREST = 20
#: Vectors that the two codebooks are fitted to, chosen by digest; every vector is indexed.
SAMPLE = 20_000
#: Entries of each codebook: eight times the fourth root of the number of distinct vectors, up to
#: this; the counts of at most CODES * CODES cells are broadcast.
CODES = 96
#: How much of the index a query opens is fitted to the sample: so much that TRIED of its vectors find
#: this share of their neighbours there, and FEWEST distinct vectors at least.
RECALL, TRIED, FEWEST = 0.95, 200, 2000
#: Vectors, and queries, that one task compares in one go.
BLOCK, QUERIES = 4096, 4096


def usable(vector: Column) -> Column:
    """Neither null, empty, zero, nor with a null or non-finite component."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(math.inf))
    return F.coalesce(F.exists(vector, lambda x: x != 0) & ~F.exists(vector, bad), F.lit(False))


def distinct_vectors(rows: DataFrame, key: str, vector: str, most: int) -> tuple[DataFrame, DataFrame]:
    """(members: vec_id, class_id) and (classes: class_id, vector, ids), both stored.

    Equal vectors are one class, known by its smallest key, and its ``ids`` are the ``most``
    smallest keys: no result can hold more of them. However many copies a vector has, the
    index holds it once.
    """
    good = rows.where(usable(F.col(vector)) & F.col(key).isNotNull()).select(
        F.col(key).alias("vec_id"), F.col(vector).alias("vector"))
    zero = F.lit(0.0).cast(good.schema["vector"].dataType.elementType)      # -0.0 becomes 0.0
    good = stored(good.withColumn("vector", F.transform("vector", lambda x: x + zero))
                  .withColumn("digest", F.sha2(F.to_binary(F.concat_ws(
                      ",", F.transform("vector", lambda x: x.cast("string"))), F.lit("utf-8")), 256)),
                  "vectors")
    classes = stored(good.groupBy("digest").agg(F.min("vec_id").alias("class_id"),
                                                F.first("vector").alias("vector")), "classes")
    place = F.row_number().over(Window.partitionBy("digest").orderBy("vec_id"))
    first = (good.select("digest", "vec_id").withColumn("place", place).where(F.col("place") <= most)
             .groupBy("digest").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))
    members = stored(good.select("vec_id", "digest")
                     .join(classes.select("digest", "class_id"), "digest")
                     .select("vec_id", "class_id"), "members")
    return members, stored(classes.join(first, "digest").drop("digest"), "index")


def kmeans(points: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Centroids of a bounded sample, from a fixed start; an empty one takes the farthest point."""
    rng = np.random.default_rng(7)
    k = min(k, len(points))
    centres = points[rng.choice(len(points), k, replace=False)].copy()
    for _ in range(rounds):
        far = (centres ** 2).sum(1)[None, :] - 2 * points @ centres.T
        own = far.argmin(1)
        count = np.bincount(own, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, points)
        centres[count > 0] = sums[count > 0] / count[count > 0][:, None]
        empty = np.flatnonzero(count == 0)
        if len(empty):
            worst = np.argsort(-(far[np.arange(len(points)), own] + (points ** 2).sum(1)), kind="stable")
            centres[empty] = points[worst[:len(empty)]]
    return centres


def codebooks(classes: DataFrame, sample: int, codes: int, nearest: int) -> tuple[np.ndarray, np.ndarray, float]:
    """One codebook for each half, of a sample of at most ``sample`` distinct vectors, and the share to open."""
    taken = (classes.orderBy(F.xxhash64("class_id"), "class_id").limit(sample)
             .select("vector").toPandas()["vector"])
    points = _matrix(taken)
    half = max(1, points.shape[1] // 2)
    one, two = kmeans(points[:, :half], codes), kmeans(points[:, half:], codes)
    return one, two, share_to_open(points, one, two, nearest)


def share_to_open(points: np.ndarray, one: np.ndarray, two: np.ndarray, nearest: int) -> float:
    """The share of the sample that comes first in the order of its cells and holds ``RECALL`` of the
    neighbours of ``TRIED`` of its vectors. In a larger table neighbours are nearer and come earlier."""
    half = one.shape[1]
    asked = points[:TRIED]
    if len(points) <= nearest + 1:
        return 1.0
    near, far = codes_of(points[:, :half], one), codes_of(points[:, half:], two)
    by_cell = (asked[:, :half] @ one.T)[:, near] + (asked[:, half:] @ two.T)[:, far]
    score = asked @ points.T
    own = np.arange(len(asked))
    score[own, own] = by_cell[own, own] = -np.inf
    best = np.argpartition(-score, nearest, axis=1)[:, :nearest]
    ahead = (by_cell[:, None, :] >= np.take_along_axis(by_cell, best, 1)[:, :, None]).sum(axis=2)
    return float(np.quantile(ahead / len(points), RECALL))


def cells_in_order(first: np.ndarray, second: np.ndarray, counts: dict[int, int], codes: int,
                   enough: int) -> tuple[list[int], float]:
    """The cells to open, best first, until they hold ``enough``, and the last one's sum.

    ``first`` and ``second`` are the inner products of a query's halves with
    the codebooks. Pairs come off a heap by their sum: a pair enters when the pair
    before it in its row or column has left, so only the corner that is looked at is built.
    """
    a, b = np.argsort(-first, kind="stable").tolist(), np.argsort(-second, kind="stable").tolist()
    x, y = first[a].tolist(), second[b].tolist()
    heap = [(-(x[0] + y[0]), 0, 0)]
    open_, held, bar = [], 0, np.inf
    while heap and held < enough:
        minus, i, j = heapq.heappop(heap)
        cell = a[i] * codes + b[j]
        n = counts.get(cell, 0)
        if n:
            open_.append(cell)
            held, bar = held + n, -minus
        if j + 1 < len(b):
            heapq.heappush(heap, (-(x[i] + y[j + 1]), i, j + 1))
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (-(x[i + 1] + y[0]), i + 1, 0))
    return open_, bar


def codes_of(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest entry of a codebook for each half vector."""
    if not centres.shape[1]:
        return np.zeros(len(points), np.int64)
    return ((centres ** 2).sum(1)[None, :] - 2 * points @ centres.T).argmin(1)


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_list()).astype(np.float64)


def _best(queries: np.ndarray, vectors: np.ndarray, keys: np.ndarray, open_: np.ndarray, most: int):
    """(query place, key, score) of each query's ``most`` best among what it opened: a fast product
    chooses a few more than needed, one summed in a fixed order ranks them."""
    rough = np.where(open_, queries @ vectors.T, -np.inf)
    if rough.shape[1] > most:
        bar = np.partition(rough, rough.shape[1] - most, axis=1)[:, rough.shape[1] - most]
        slack = 1e-9 * (1 + np.abs(np.where(open_, rough, 0)).max(axis=1))
        q, v = np.nonzero(open_ & (rough >= (bar - slack)[:, None]))
    else:
        q, v = np.nonzero(open_)
    score = (queries[q] * vectors[v]).sum(axis=1)
    order = np.lexsort((keys[v], -score, q))
    q, v, score = q[order], v[order], score[order]
    keep = np.arange(len(q)) - np.searchsorted(q, q) < most
    return q[keep], keys[v[keep]], score[keep]


def search(rows: DataFrame, asks: Column, nearest: int = NEAREST, key: str = "vec_id",
           vector: str = "embedding", sample: int = SAMPLE, codes: int | None = None,
           look: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the ``nearest`` found for each row that ``asks``, itself excepted.

    Nearness is the inner product in double precision; ties go to the smaller
    key. Vectors null, empty, zero or with a null or non-finite component, and rows
    without a key, take no part. All vectors must have one length. A repeated
    key counts once for each row, and never as its own neighbour. With fewer candidates than
    ``nearest``, cells are opened until none is left, so all come back. An
    empty table gives an empty result. Other columns are not looked at.
    """
    spark = rows.sparkSession
    out = "query_id long, rank int, vec_id long, score double"
    members, classes = distinct_vectors(rows, key, vector, nearest + 1)
    total = classes.count()
    if not total:
        return spark.createDataFrame([], out)
    codes = codes or max(2, min(CODES, round(8 * total ** 0.25)))
    one, two, share = codebooks(classes, sample, codes, nearest)
    enough = look or max(FEWEST, math.ceil(share * total))
    kind = classes.schema["vector"].dataType.simpleString()
    half, width = one.shape[1], len(two)

    @F.pandas_udf("int")
    def cell_of(vectors: pd.Series) -> pd.Series:
        if not len(vectors):
            return pd.Series([], dtype="int32")
        v = _matrix(vectors)
        return pd.Series(codes_of(v[:, :half], one) * width + codes_of(v[:, half:], two), dtype="int32")

    indexed = stored(classes.withColumn("cell", cell_of("vector")), "cells")
    sizes = {r["cell"]: r["count"] for r in indexed.groupBy("cell").count().collect()}
    # neighbouring entries of the first codebook share a group; a large group is cut into blocks
    groups = min(len(one), math.ceil(2 * total / BLOCK))
    group_of = np.arange(len(one)) * groups // len(one)
    held = np.zeros(groups, np.int64)
    for cell, n in sizes.items():
        held[group_of[cell // width]] += n
    cuts = np.ceil(held / BLOCK).astype(int).tolist()
    # one search for all queries with the same vector
    asking = stored(members.where(asks).select("class_id").distinct()
                    .join(classes.select("class_id", "vector"), "class_id"), "asking")
    parts = max(1, math.ceil(asking.count() / QUERIES))
    first = F.floor(F.col("cell") / width)
    group = F.floor(first * groups / len(one)).cast("int")
    block = F.pmod(F.xxhash64("class_id"), F.greatest(F.get(F.array(*[F.lit(c) for c in cuts]), group), F.lit(1)))
    entries = indexed.select(group.alias("group"), block.cast("int").alias("block"),
                             F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"),
                             "cell", "class_id", "vector")

    def opened(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            v = _matrix(batch["vector"])
            a, b = v[:, :half] @ one.T, v[:, half:] @ two.T
            found = []
            for q, vector_, x, y in zip(batch["class_id"], batch["vector"], a, b):
                _, bar = cells_in_order(x, y, sizes, width, enough)
                for g in np.unique(group_of[x + y.max() >= bar - 1e-9]).tolist():
                    found += [(q, vector_, bar, g, k, q % parts) for k in range(cuts[g])]
            yield pd.DataFrame(found, columns=["query", "vector", "bar", "group", "block", "part"])

    probes = asking.mapInPandas(
        opened, f"query long, vector {kind}, bar double, group int, block int, part int")

    def compare(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query": [], "class_id": [], "score": []})
        asked, vectors = _matrix(left["vector"]), _matrix(right["vector"])
        cell, keys, query = (right["cell"].to_numpy(), right["class_id"].to_numpy(), left["query"].to_numpy())
        out = []
        for at in range(0, len(left), 512):
            some = asked[at:at + 512]
            sums = (some[:, :half] @ one.T)[:, cell // width] + (some[:, half:] @ two.T)[:, cell % width]
            open_ = sums >= left["bar"].to_numpy()[at:at + 512, None] - 1e-9
            q, k, s = _best(some, vectors, keys, open_, nearest + 1)
            out.append(pd.DataFrame({"query": query[at:at + 512][q], "class_id": k, "score": s}))
        return pd.concat(out)

    near = (probes.groupBy("group", "block", "part").cogroup(entries.groupBy("group", "block", "part"))
            .applyInPandas(compare, "query long, class_id long, score double"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "class_id")
    best = near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= nearest + 1)
    # classes back to rows: the copies of a vector share its score
    listed = (best.join(classes.select("class_id", "ids"), "class_id")
              .groupBy("query").agg(F.collect_list(F.struct("score", "ids")).alias("found"))
              .select("query", F.slice(F.array_sort(F.flatten(F.transform("found", lambda f: F.transform(
                  f["ids"], lambda i: F.struct((-f["score"]).alias("minus"), i.alias("id")))))),
                  1, nearest + 1).alias("found")))
    queries = members.where(asks).select(F.col("vec_id").alias("query_id"), F.col("class_id").alias("query"))
    mine = listed.join(queries, "query").select("query_id", F.slice(F.filter(
        "found", lambda f: f["id"] != F.col("query_id")), 1, nearest).alias("found"))
    return mine.select("query_id", F.posexplode("found").alias("rank", "f")).select(
        "query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("f.id").alias("vec_id"),
        (-F.col("f.minus")).alias("score"))
