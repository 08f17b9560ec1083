"""Boosted trees grown from histograms: level by level, best leaf first, or all leaves of a level alike."""

from __future__ import annotations

import math
import random
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import stored

#: Bins of a feature, and trees that are added up anew at each level before sums so far are written.
BINS, EVERY = 64, 8
#: Rows that are kept in one block.
BLOCK = 1 << 16


class Preset(NamedTuple):
    """How trees grow and what a split needs."""
    growth: str               # level, leaf or symmetric
    l2: float                 # added to the curvature of a leaf
    least_curvature: float    # of either side of a split
    least_rows: int
    rows: float               # shares that a tree sees
    columns: float
    from_average: bool        # start at the log-odds of the labels, not at 0
    leaves: int = 1 << 30


# ---------------------------------------------------------------- fixed values: model settings
PRESETS = {
    "XGBoost": Preset("level", 1.0, 1.0, 1, 0.8, 0.8, False),
    # its share of rows has no effect while its rounds of bagging are 0
    "LightGBM": Preset("leaf", 0.0, 1e-3, 20, 1.0, 0.8, True, 31),
    "CatBoost": Preset("symmetric", 3.0, 0.0, 0, 0.8, 1.0, False),
}
ROUNDS, DEPTH, RATE = 200, 6, 0.1


class Split(NamedTuple):
    gain: float
    feature: int
    bin: int                  # rows of a higher bin go right
    left: tuple               # sums (g, h, n) of either side
    right: tuple


class Tree(NamedTuple):
    splits: dict[int, Split]          # node -> split; the children of k are 2k and 2k + 1, the root is 1
    values: dict[int, float]          # leaf -> what it adds


def edges_of(rows: DataFrame, features: list[str], bins: int = BINS) -> list[list[float]]:
    """For each feature the values that its bins end at: quantiles, a bounded number."""
    shares = [(i + 1) / bins for i in range(bins - 1)]
    found = rows.agg(*[F.percentile_approx(f, shares, 10_000).alias(f) for f in features]).first()
    return [sorted(set(found[f] or ())) for f in features]


def _binned(features: list[str], edges: list[list[float]]) -> Column:
    """For each feature the number of edges below its value."""
    def bin_of(name: str, ends: list[float]) -> Column:
        if not ends:
            return F.lit(0)
        return F.size(F.filter(F.array(*[F.lit(float(e)) for e in ends]), lambda e: e < F.col(name)))
    return F.array(*[bin_of(f, ends) for f, ends in zip(features, edges)])


def _walk(splits: dict[int, Split], test, leaf, node: int = 1) -> str:
    """SQL that follows the splits from ``node`` to ``leaf(node)``."""
    if node not in splits:
        return leaf(node)
    left, right = (_walk(splits, test, leaf, 2 * node + side) for side in (0, 1))
    return f"IF({test(splits[node])}, {right}, {left})"


def _added(trees: list[Tree], test) -> str:
    terms = [_walk(t.splits, test, lambda k, t=t: f"{t.values[k]!r}D") for t in trees]
    return f"aggregate(array({', '.join(terms)}), 0D, (s, x) -> s + x)" if terms else "0D"


def _score(g: float, h: float, l2: float) -> float:
    return g * g / (h + l2) if h + l2 > 0 else 0.0


def _minus(a: tuple, b: tuple) -> tuple:
    return tuple(x - y for x, y in zip(a, b))


def _candidates(bins: dict[tuple[int, int], tuple], total: tuple, preset: Preset):
    """(feature, bin, left, right) for every place at which a node can be cut; ``bins`` (feature, bin) -> sums."""
    for feature in sorted({f for f, _ in bins}):
        left = (0.0, 0.0, 0)
        here = sorted(b for f, b in bins if f == feature)
        for b in here[:-1]:
            left = tuple(x + y for x, y in zip(left, bins[feature, b]))
            yield feature, b, left, _minus(total, left)


def best_split(bins: dict[tuple[int, int], tuple], total: tuple, preset: Preset) -> Split | None:
    """The cut of largest gain; of equal ones that of the first feature and the lowest bin."""
    best = None
    for feature, b, left, right in _candidates(bins, total, preset):
        if min(left[1], right[1]) < preset.least_curvature or min(left[2], right[2]) < preset.least_rows:
            continue
        gain = round(_score(*left[:2], preset.l2) + _score(*right[:2], preset.l2) - _score(*total[:2], preset.l2), 9)
        if gain > 0 and (best is None or gain > best.gain):
            best = Split(gain, feature, b, left, right)
    return best


def best_common_split(nodes: dict[int, dict], totals: dict[int, tuple], preset: Preset) -> dict[int, Split]:
    """The one cut, the same in all nodes of a level, of largest summed gain."""
    places = sorted({(f, b) for bins in nodes.values() for f, b in bins})
    best, found = 0.0, {}
    for feature, b in places:
        made, gain = {}, 0.0
        for node, bins in nodes.items():
            parts = [v for (f, k), v in bins.items() if f == feature and k <= b]
            left = tuple(map(sum, zip(*parts))) if parts else (0.0, 0.0, 0)
            right = _minus(totals[node], left)
            if right[2] <= 0:
                right = (0.0, 0.0, 0)
            gain += _score(*left[:2], preset.l2) + _score(*right[:2], preset.l2) - _score(*totals[node][:2], preset.l2)
            made[node] = Split(gain, feature, b, left, right)
        if round(gain, 9) > best:
            best, found = round(gain, 9), made
    return found


def _kept(splits: dict[int, Split], leaves: int) -> dict[int, Split]:
    """The splits made if always the leaf of largest gain is cut next, until there are so many leaves.

    A node's best cut does not depend on when it is made, so all are known beforehand.
    """
    kept, able = {}, {1} & splits.keys()
    while able and len(kept) + 1 < leaves:
        node = min(able, key=lambda k: (-splits[k].gain, k))
        able.remove(node)
        kept[node] = splits[node]
        able |= {2 * node, 2 * node + 1} & splits.keys()
    return kept


def grown(histogram, preset: Preset, depth: int, rate: float) -> Tree:
    """A tree from ``histogram(splits, nodes)``, which gives node -> (feature, bin) -> sums (g, h, n) of a level's nodes."""
    splits: dict[int, Split] = {}
    level, total = [1], None
    totals: dict[int, tuple] = {}
    for _ in range(depth):
        nodes = histogram(splits, level)
        for node, bins in nodes.items():
            first = min(f for f, _ in bins)
            totals[node] = tuple(map(sum, zip(*[v for (f, _), v in bins.items() if f == first])))
        total = total or totals.get(1)
        if preset.growth == "symmetric":
            found = best_common_split(nodes, totals, preset)
        else:
            found = {k: s for k in sorted(nodes) if (s := best_split(nodes[k], totals[k], preset))}
        splits |= found
        level = [child for k in found for child in (2 * k, 2 * k + 1)]
        if not level:
            break
    splits = _kept(splits, preset.leaves) if preset.growth == "leaf" else splits
    sums = {1: total or (0.0, 0.0, 0)}
    for k, s in splits.items():
        sums[2 * k], sums[2 * k + 1] = s.left, s.right
    values = {k: -rate * g / (h + preset.l2) if h + preset.l2 > 0 else 0.0
              for k, (g, h, _) in sums.items() if k not in splits}
    return Tree(splits, values)


_BLOCKS = pa.schema([(c, pa.binary()) for c in ("bins", "target", "weight", "digest", "margin")])


def _blocks(binned: DataFrame, start: float) -> DataFrame:
    """``binned`` (bins, target, weight, digest) as blocks: a row holds the columns of up to ``BLOCK`` rows, and their margins."""
    def block(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held)
        columns = [rows["bins"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.uint16),
                   *[rows[c].to_numpy() for c in ("target", "weight", "digest")], np.full(len(rows), start)]
        return pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in columns], schema=_BLOCKS)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= BLOCK:
                yield block(held)
                held, n = [], 0
        if n:
            yield block(held)
    return binned.mapInArrow(packed, ", ".join(f"{c} binary" for c in _BLOCKS.names))


def _opened(batches: Iterator[pa.RecordBatch], features: int) -> Iterator[tuple[np.ndarray, ...]]:
    """bins, target, weight, digest, margin of one block after another."""
    kinds = (np.uint16, np.float64, np.float64, np.int64, np.float64)
    for batch in batches:
        for row in zip(*batch.columns):
            bins, *rest = (np.frombuffer(v.as_buffer(), kind) for v, kind in zip(row, kinds))
            yield bins.reshape(-1, features), *rest


def _nodes(bins: np.ndarray, splits: dict[int, Split]) -> np.ndarray:
    """The node at which each row ends."""
    at = np.ones(len(bins), np.int64)
    size = 2 * max(splits, default=0) + 2
    feature, cut = np.full(size, -1), np.zeros(size, np.int64)
    for k, s in splits.items():
        feature[k], cut[k] = s.feature, s.bin
    while len(moving := np.flatnonzero(feature[at] >= 0)):
        node = at[moving]
        at[moving] = 2 * node + (bins[moving, feature[node]] > cut[node])
    return at


def _margins(bins: np.ndarray, margin: np.ndarray, trees: list[Tree]) -> np.ndarray:
    """``margin`` with what the trees add to it."""
    for tree in trees:
        values = np.zeros(max(tree.values) + 1)
        for k, value in tree.values.items():
            values[k] = value
        margin = margin + values[_nodes(bins, tree.splits)]
    return margin


def _drawn(digest: np.ndarray, k: int, share: float) -> np.ndarray:
    """Whether tree ``k`` sees a row: by XXH64 of ``k`` from the digest on, as xxhash64 over one more column gives it."""
    one, two, three, five = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))
    h = digest.view(np.uint64) + five + np.uint64(4)
    h ^= np.full(1, k, np.uint64) * one
    h = (h << np.uint64(23) | h >> np.uint64(41)) * two + three
    h = (h ^ h >> np.uint64(33)) * two
    h = (h ^ h >> np.uint64(29)) * three
    return (h ^ h >> np.uint64(32)) % np.uint64(1 << 20) < np.uint64(int(share * (1 << 20)))


def _moved(blocks: DataFrame, features: int, trees: list[Tree]) -> DataFrame:
    """The blocks with margins that hold what the trees add."""
    def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = [_margins(bins, margin, trees).tobytes() for bins, *_, margin in _opened([batch], features)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(new, pa.binary())], schema=_BLOCKS)
    return blocks.mapInArrow(moved, blocks.schema)


def _histogram(blocks: DataFrame, features: int, columns: list[int], bins_of: int, pending: list[Tree], k: int, share: float):
    """Sums of a level by (node, feature, bin), in one stage of tasks over whole blocks. No more tasks than cores send
    theirs, at most nodes x features x bins sums each, whatever the number of tables."""
    def of(splits: dict[int, Split], level: list[int]) -> dict[int, dict]:
        shape = (len(level), len(columns), bins_of)

        def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            place = np.full(2 * max(level) + 2, -1)
            place[level] = np.arange(len(level))
            sums = np.zeros((3, math.prod(shape)))
            for bins, target, weight, digest, margin in _opened(batches, features):
                at = place[np.minimum(_nodes(bins, splits), len(place) - 1)]
                seen = np.flatnonzero(at >= 0 if share >= 1 else (at >= 0) & _drawn(digest, k, share))
                bins, at, weight = bins[seen], at[seen], weight[seen]
                with np.errstate(over="ignore"):
                    p = 1 / (1 + np.exp(-_margins(bins, margin[seen], pending)))
                g, h = np.nan_to_num(weight * (p - target[seen])), np.nan_to_num(weight * p * (1 - p))
                for i, f in enumerate(columns):
                    cell = (at * shape[1] + i) * bins_of + bins[:, f]
                    for total, of_row in zip(sums, (g, h, None)):
                        total += np.bincount(cell, of_row, len(total))
            yield pa.RecordBatch.from_pydict({"sums": pa.array([sums.tobytes()], pa.binary())})
        cores = blocks.sparkSession.sparkContext.defaultParallelism
        sums = np.zeros((3, *shape))
        for r in blocks.coalesce(cores).mapInArrow(summed, "sums binary").collect():
            sums += np.frombuffer(r.sums).reshape(sums.shape)
        out: dict[int, dict] = {}
        for i, j, b in np.argwhere(sums[2] > 0).tolist():
            g, h, n = sums[:, i, j, b].tolist()
            out.setdefault(level[i], {})[columns[j], b] = (g, h, int(n))
        return out
    return of


class Boosted(NamedTuple):
    features: list[str]
    edges: list[list[float]]
    start: float
    trees: list[Tree]

    def margin(self) -> str:
        """SQL over the features: the log-odds of label 1."""
        def by_value(split: Split) -> str:
            return f"`{self.features[split.feature]}` > {float(self.edges[split.feature][split.bin])!r}D"
        return f"{self.start!r}D + {_added(self.trees, by_value)}"


def fit(rows: DataFrame, features: list[str], key: list[str], preset: Preset, seed: int, rounds: int = ROUNDS,
        depth: int = DEPTH, rate: float = RATE, bins: int = BINS) -> Boosted:
    """Boost trees on stored ``rows`` (features, key, target 0 or 1, weight).

    Tables are read as bins, which are kept in blocks; each level of a tree is one job, and all it computes from
    a block is numbers. Every tree draws its features, and its rows by a digest of ``key``. Margins are
    written every ``EVERY`` trees, so a level adds up few trees and a lost executor costs
    few of them. Without rows, or with one label, nothing is cut.
    """
    edges = edges_of(rows, features, bins)
    start = 0.0
    if preset.from_average:
        share = rows.agg((F.sum(F.col("weight") * F.col("target")) / F.sum("weight")).alias("p")).first().p or 0.5
        share = min(max(share, 1e-9), 1 - 1e-9)
        start = math.log(share / (1 - share))
    blocks = stored(_blocks(rows.select(
        _binned(features, edges).alias("bins"), F.col("target").cast("double").alias("target"),
        F.col("weight").cast("double").alias("weight"), F.xxhash64(*key, F.lit(seed)).alias("digest")), start), "binned")
    rng, trees, pending = random.Random(seed), [], []
    for k in range(rounds):
        columns = sorted(rng.sample(range(len(features)), math.ceil(preset.columns * len(features))))
        tree = grown(_histogram(blocks, len(features), columns, bins, pending, k, preset.rows), preset, depth, rate)
        trees.append(tree)
        pending.append(tree)
        if len(pending) == EVERY and k + 1 < rounds:
            blocks = stored(_moved(blocks, len(features), pending), "margins")
            pending = []
    return Boosted(features, edges, start, trees)
