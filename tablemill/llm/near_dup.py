"""Near duplicates by a chosen-path set similarity join over minwise tokens of word shingles."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns_of, stored
from .components import components
from .hashing import TOKENS, mixed, odd_bits, shingles, tokens

#: Independent trees, and how deep a tree may branch.
TREES, DEPTH = 8, 10
#: Levels from one at which sets are held against their node's hub to the next.
STARS = 4
#: A node with so many sets outside its largest component is compared exhaustively; others branch.
SMALL = 512
#: Sets of the largest component that few others are held against at a time, and sets of a node with
#: many others that two blocks of them are compared at a time.
BLOCK, LARGE = 512, 4096
#: In a node of more than so many sets the hub is the one nearest to the middle of so many sketches.
CROWD, MIDDLE = 64, 32
#: Ratios of size, each the largest that two linked sets can have, that one band of sizes spans.
BAND = 4


@dataclass(frozen=True)
class Rule:
    """Shingles of ``words`` words; two sets are linked from ``part`` / ``whole`` on."""

    words: int = 5
    part: int = 80
    whole: int = 100

    @property
    def least(self) -> float:
        return self.part / self.whole

    @property
    def estimate(self) -> float:
        """Pairs that agree in a smaller share of tokens are not looked at: 5.5 standard
        deviations below the limit, less than one true link in ten million."""
        return max(0.0, self.least - 5.5 * math.sqrt(self.least * (1 - self.least) / TOKENS))

    @property
    def apart(self) -> float:
        """Linked sets differ in at most so many shingles for each of the shingles of both."""
        return (self.whole - self.part) / (self.whole + self.part)

    def bands(self, n: int) -> list[int]:
        """The bands of sizes that a set of ``n`` is in: its own, and the one below if a set there may be linked
        with it. Of two sets that are linked the smaller one's band holds both."""
        reach = -math.log(self.least)
        if not 0 < reach < 1:
            return [0]
        own = math.floor(math.log(n) / (BAND * reach))
        return [own, own - 1] if own and math.log(n) - own * BAND * reach <= reach + 1e-9 else [own]


def _described(rule: Rule):
    """Size, key, the paths on which a set leaves the roots, and its sketches. Each band of sizes has its own roots."""
    second = 1 / rule.least - 1
    roots = [(tree, tree) for tree in range(TREES)]
    roots += [(tree, TREES + tree) for tree in range(TREES) if (tree + 1) * second % 1 < second]

    @F.pandas_udf("n long, key binary, paths array<long>, sketch binary, odd binary")
    def describe(texts: pd.Series) -> pd.DataFrame:
        out = []
        for text in texts:
            one = shingles(text, rule.words)
            if not len(one):
                out.append((0, None, None, None, None))
                continue
            least = tokens(one)
            out.append((len(one), hashlib.blake2b(one.tobytes(), digest_size=16).digest(),
                        [_path(band * TREES + tree, c, least[c]) for band in rule.bands(len(one)) for tree, c in roots],
                        (mixed(least) & np.uint64(255)).astype(np.uint8).tobytes(), odd_bits(one).tobytes()))
        return pd.DataFrame(out, columns=["n", "key", "paths", "sketch", "odd"])
    return describe


def _path(parent: int, place: int, token: int) -> int:
    return xxhash.xxh64_intdigest(b"%d/%d/%d" % (parent, place, token)) >> 1


def _children(rule: Rule):
    """The paths on which a set leaves a node: one token, and a second so often that 1 / least go
    on in the mean. Which tokens depends on the path alone, so sets that agree stay together;
    below the roots, whose tokens are whole, a byte of a token stands for it."""
    second = 1 / rule.least - 1
    rest = TOKENS - 2 * TREES

    @F.pandas_udf("array<long>")
    def children(paths: pd.Series, sketches: pd.Series) -> pd.Series:
        out = []
        for path, own in zip(paths, sketches):
            h = xxhash.xxh64_intdigest(int(path).to_bytes(8, "little", signed=True))
            chosen = [2 * TREES + h % rest]
            if (h >> 20 & 0xFFFFF) / 0x100000 < second:
                chosen.append(2 * TREES + (chosen[0] - 2 * TREES + 1 + (h >> 44) % (rest - 1)) % rest)
            out.append([_path(path, c, own[c]) for c in chosen])
        return pd.Series(out)
    return children


def _agreement():
    """Share of the bytes of two sketches that agree."""
    @F.pandas_udf("double")
    def agreement(a: pd.Series, b: pd.Series) -> pd.Series:
        if not len(a):
            return pd.Series([], dtype="float64")
        x = np.frombuffer(b"".join(a), np.uint8).reshape(-1, TOKENS)
        y = np.frombuffer(b"".join(b), np.uint8).reshape(-1, TOKENS)
        return pd.Series((x == y).mean(axis=1))
    return agreement


def _may_link(rule: Rule, x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether sets of n and m shingles may be linked. The bits in which their odd sketches differ are never more
    than the shingles in which they do, so what this rules out is not linked."""
    return np.bitwise_count(x ^ y).sum(axis=1) <= rule.apart * (n + m) + 1e-6


def _confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (a, b) whose full sets are linked, after a look at the odd sketches. Only texts of pairs that
    these leave are read."""
    @F.pandas_udf("boolean")
    def plausible(left: pd.DataFrame, right: pd.DataFrame) -> pd.Series:
        if not len(left):
            return pd.Series([], dtype="bool")
        x, y = (np.frombuffer(b"".join(side["odd"]), np.uint64).reshape(len(side), -1) for side in (left, right))
        return pd.Series(_may_link(rule, x, y, left["n"].to_numpy(), right["n"].to_numpy()))

    @F.pandas_udf("boolean")
    def linked(left: pd.Series, right: pd.Series) -> pd.Series:
        out, last, x = [], None, None
        for a, b in zip(left, right):
            if a is not last and a != last:
                last, x = a, shingles(a, rule.words)
            y = shingles(b, rule.words)
            both = len(np.intersect1d(x, y, assume_unique=True))
            out.append(rule.whole * both >= rule.part * (len(x) + len(y) - both))
        return pd.Series(out, dtype="bool")

    def beside(rows: DataFrame, held: DataFrame, value) -> DataFrame:
        return (rows.join(held.select(F.col("key").alias("b"), value.alias("right")), "b")
                .join(held.select(F.col("key").alias("a"), value.alias("left")), "a"))

    asked = stored(beside(pairs, classes, F.struct("n", "odd")).where(plausible("left", "right"))
                   .select("a", "b"), "asked")
    needed = asked.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    read = stored(_texts(needed, classes, docs), "texts")
    return stored(beside(asked, read, F.col("text")).where(linked("left", "right")).select("a", "b"), "links")


def _across(members: DataFrame, rule: Rule) -> DataFrame:
    """Pairs of one node's sets that are of different components and may be linked.

    ``members`` has (path, key, root, sketch, odd, n, main, size, rest): the root of the node's largest component,
    the node's sets, and how many of them are of other components. If these are few, the largest component
    is dealt to blocks and the others go to each of them, which is less rows than the node has; else
    all sets are dealt, and each pair of blocks is compared. Rows come sorted by node and
    pair of blocks, so a task holds one such pair at a time.
    """
    def near(marks, odd, n, key, root, left, right) -> list:
        one, two = np.flatnonzero(left), np.flatnonzero(right)
        out = []
        for i in one:
            other = two[root[two] != root[i]]
            if len(other):
                most = rule.apart * (n[other] + n[i]) + 1e-6
                close = other[(np.abs(n[other] - n[i]) <= most) & ((marks[other] == marks[i]).mean(axis=1) >= rule.estimate)]
                close = close[_may_link(rule, odd[close], odd[i], n[close], n[i])]
                out += [(min(key[i], key[j]), max(key[i], key[j])) for j in close]
        return out

    def columns(rows: pd.DataFrame) -> tuple:
        return (np.frombuffer(b"".join(rows["sketch"]), np.uint8).reshape(-1, TOKENS),
                np.frombuffer(b"".join(rows["odd"]), np.uint64).reshape(len(rows), -1),
                rows["n"].to_numpy(), rows["key"].to_numpy(), pd.factorize(rows["root"])[0], rows["left"].to_numpy(), rows["right"].to_numpy())

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            place = rows[["path", "x", "y"]].to_numpy()
            ends = np.flatnonzero((place[1:] != place[:-1]).any(axis=1)) + 1
            starts = [0, *ends.tolist()]
            sides = columns(rows)
            out = {p for a, b in zip(starts, ends.tolist()) if b - a > 1 for p in near(*(v[a:b] for v in sides))}
            held = rows.iloc[starts[-1]:].reset_index(drop=True)
            yield pd.DataFrame(sorted(out), columns=["a", "b"])
        if held is not None:
            yield pd.DataFrame(sorted(set(near(*columns(held)))), columns=["a", "b"])

    few = F.col("rest") <= SMALL
    blocks = F.ceil(F.col("size") / F.when(few, BLOCK).otherwise(LARGE)).cast("int")
    own = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
    every = F.expr("sequence(0, blocks - 1)")
    stranger = F.col("root") != F.col("main")
    dealt = (members.withColumn("blocks", blocks).withColumn("own", own)
             .withColumn("other", F.explode(F.when(few & ~stranger, F.array("own")).otherwise(every)))
             .select("path", "key", "root", "sketch", "odd", "n",
                     F.when(few, F.col("other")).otherwise(F.least("own", "other")).alias("x"),
                     F.when(few, F.col("other")).otherwise(F.greatest("own", "other")).alias("y"),
                     F.when(few, stranger).otherwise(F.col("own") <= F.col("other")).alias("left"),
                     F.when(few, ~stranger | (F.col("own") == F.col("other")))
                     .otherwise(F.col("own") >= F.col("other")).alias("right")))
    return (dealt.repartition("path", "x", "y").sortWithinPartitions("path", "x", "y")
            .mapInPandas(compare, "a binary, b binary").distinct())


def _hubs(level: DataFrame) -> DataFrame:
    """(path, first): the set of each node that the others are held against. In a large node it is the one nearest
    to the middle of some of its sketches, which near copies of one text are linked with more often than with
    any one of them; in others the smallest. A node's sets are never gathered."""
    @F.pandas_udf("binary")
    def middle(sketches: pd.Series) -> pd.Series:
        out = []
        for some in sketches:
            marks = np.frombuffer(b"".join(some), np.uint8).reshape(-1, TOKENS)
            out.append(np.array([np.bincount(place).argmax() for place in marks.T], np.uint8).tobytes())
        return pd.Series(out)

    nodes = level.groupBy("path").agg(F.min("key").alias("first"), F.count("*").alias("size"))
    large = stored(level.join(nodes.where(F.col("size") > CROWD).select("path"), "path")
                   .select("path", "key", "sketch"), "large")
    some = (large.groupBy("path", F.pmod(F.xxhash64("key"), F.lit(MIDDLE)).alias("slot"))
            .agg(F.min(F.struct("key", "sketch")).alias("one"))
            .groupBy("path").agg(F.array_sort(F.collect_list("one")).alias("some"))
            .select("path", middle(F.col("some.sketch")).alias("middle")))
    near = (large.join(some, "path").withColumn("share", _agreement()("sketch", "middle"))
            .groupBy("path").agg(F.max(F.struct("share", "key")).alias("top")))
    return (nodes.where(F.col("size") <= CROWD).select("path", "first")
            .union(near.select("path", F.col("top.key").alias("first"))))


def _joined(classes: DataFrame, docs: DataFrame, rule: Rule) -> DataFrame:
    """(node, root) of the classes that are linked with others.

    At the first level, and at every ``STARS``th below it, each node's sets are held against
    its hub; what is linked by then is one component. Nodes that still hold several
    components are compared exhaustively if few of their sets are outside the largest one, and
    branch else, so a level's work is a small number of pairs for each of its rows. No pair
    that is connected by then is made, and a group of copies costs a pair for each. What
    has not come apart at the last level is compared in blocks, exhaustively too.
    Nodes of all levels are compared at the end, in one pass, as are links confirmed.
    """
    children, agreement = _children(rule), _agreement()
    spark = classes.sparkSession
    links = spark.createDataFrame([], "a binary, b binary")
    tried, small = links, None
    sketches = stored(classes.select("key", "sketch"), "sketches")
    paths = classes.select("key", F.explode("paths").alias("path"))
    met = paths.groupBy("path").agg(F.count("*").alias("size")).where("size > 1")
    # every set is its own root at first
    level = stored(paths.join(met.select("path"), "path").join(sketches, "key")
                   .select("path", "key", "sketch", F.col("key").alias("root")), "level")
    for depth in range(DEPTH):
        if depth % STARS == 0:
            nodes = _hubs(level)
            firsts = sketches.select(F.col("key").alias("first"), F.col("sketch").alias("hub"))
            star = stored(level.join(nodes.join(firsts, "first"), "path")
                          .where(F.col("key") != F.col("first"))
                          .where(agreement("sketch", "hub") >= F.lit(rule.estimate))
                          .select(F.least("first", "key").alias("a"), F.greatest("first", "key").alias("b")).distinct()
                          .join(tried, ["a", "b"], "left_anti"), "star")
            if not star.isEmpty():
                tried = tried.union(star)
                links = links.union(_confirmed(star, classes, docs, rule))
                roots = stored(components(links), "roots")
                level = (level.drop("root").join(roots.withColumnRenamed("node", "key"), "key", "left")
                         .withColumn("root", F.coalesce("root", "key")))
        parts = (level.groupBy("path", "root").agg(F.count("*").alias("n"))
                 .groupBy("path").agg(F.max(F.struct("n", "root")).alias("top"), F.sum("n").alias("size"))
                 .where("top.n < size")
                 .select("path", "size", F.col("top.root").alias("main"), (F.col("size") - F.col("top.n")).alias("rest")))
        mixed = stored(level.join(parts, "path"), "mixed")
        last = depth == DEPTH - 1
        now = mixed if last else mixed.where(F.col("rest") <= SMALL)
        small = now if small is None else small.union(now)
        large = mixed.where(F.col("rest") > SMALL)
        if last or large.isEmpty():
            break
        level = stored(large.withColumn("path", F.explode(children("path", "sketch")))
                       .select("path", "key", "sketch", "root").distinct(), "level")
    small = small.join(classes.select("key", "n", "odd"), "key")
    pairs = stored(_across(small, rule).join(tried, ["a", "b"], "left_anti"), "across")
    links = links.union(_confirmed(pairs, classes, docs, rule))
    return stored(components(links), "roots")


def _texts(keys: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """(key, text): one document's text for each class asked for, so that copies are not gathered. Which they
    are is written first, so that if they are few the engine knows and does not shuffle all texts."""
    held = stored(keys.join(classes.select(
        "key", F.col("one.id").alias("id"), F.col("one.text_key").alias("text_key")), "key"), "held")
    read = docs.select(F.col("doc_id").alias("read_id"), F.col("text_key").alias("read_key"), "text")
    return (read.join(held, (F.col("text_key") == F.col("read_key")) & F.col("id").eqNullSafe(F.col("read_id")))
            .select("key", "text").dropDuplicates(["key"]))


def rooted(docs: DataFrame, rule: Rule, text: str) -> DataFrame:
    """``group`` with __root, the component itself, which tells apart those without doc_id."""
    base = docs.drop("n_shingles", "component_id", "kept")
    held = F.coalesce(F.col(text), F.lit(""))
    texts = base.select("doc_id", held.alias("text"), F.unhex(F.md5(held)).alias("text_key"))
    described = stored(texts.withColumn("set", _described(rule)("text")).select("doc_id", "text_key", "set.*"), "sets")
    filled = described.where(F.col("key").isNotNull())
    one = F.struct(F.col("doc_id").alias("id"), "text_key")
    classes = stored(filled.groupBy("key").agg(
        F.min("doc_id").alias("doc_id"), F.min(one).alias("one"), F.first("paths").alias("paths"),
        F.first("sketch").alias("sketch"), F.first("odd").alias("odd"), F.first("n").alias("n")), "classes")
    roots = _joined(classes, texts, rule)
    rooted = classes.select("key", "doc_id").join(
        roots.withColumnRenamed("node", "key"), "key", "left")
    lone = rooted.where(F.col("root").isNull()).select(
        "key", F.col("key").alias("root"), F.col("doc_id").alias("component_id"))
    shared = rooted.where(F.col("root").isNotNull())
    ids = shared.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    labels = lone.union(shared.join(ids, "root").select("key", "root", "component_id"))
    # every text once: copies are gathered before their set's label is looked up
    known = stored(described.groupBy("text_key").agg(F.first("key").alias("key"), F.first("n").alias("n"))
                   .join(labels, "key", "left")
                   .select(F.col("text_key").alias("__key"), F.col("n").alias("__n"), F.col("root").alias("__root"),
                           F.col("component_id").alias("__component")), "labels")
    out = base.withColumn("__text", F.unhex(F.md5(held))).join(known, F.col("__text") == F.col("__key"))
    out = out.withColumn("__mine", F.when(F.col("__n") == 0, F.col("doc_id")).otherwise(F.col("__component")))
    return out.select(*columns_of(out, {"__text", "__key", "__n", "__root", "__component", "__mine"}),
                      F.col("__n").alias("n_shingles"), F.col("__mine").alias("component_id"),
                      F.col("doc_id").eqNullSafe(F.col("__mine")).alias("kept"), "__root")


def group(docs: DataFrame, rule: Rule = Rule(), text: str = "text") -> DataFrame:
    """``docs`` with n_shingles, component_id and kept.

    Sets of shingles that are equal are one class, whatever their number of
    rows; classes are joined by ``rule`` and links confirmed on full sets.
    component_id is the smallest doc_id that a document reaches. A text without
    words, or null, has 0 shingles and is alone; so is its component_id its own.
    A row without doc_id takes its component's smallest, null if all lack one; kept says
    that doc_id and component_id are equal, nulls too. Repeated rows reach
    each other and agree. Columns named like the new ones are replaced.
    """
    return rooted(docs, rule, text).drop("__root")


def one_of_each(docs: DataFrame, rule: Rule = Rule(), text: str = "text") -> DataFrame:
    """``docs`` without near duplicates: of each component the row with its smallest doc_id, and
    one of rows that share it. Rows without words all stay, as they are like nothing."""
    judged = stored(rooted(docs, rule, text).where("kept"), "kept")
    alone = judged.where("n_shingles = 0")
    rest = judged.where("n_shingles > 0").dropDuplicates(["__root"])
    new = {"n_shingles", "component_id", "kept", "__root"}
    return alone.union(rest).select(*columns_of(judged, new))
