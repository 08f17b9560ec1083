"""The trie of conversation prefixes, totalled over subtrees by bands of depth."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Levels of a band; a node is sent to so many ancestors at most in a round.
BAND = 8
#: Turns of one conversation whose running digests one task works out.
STRETCH = 1024
#: A conversation takes its first turns from the conversation with the next lower multiple of this.
FAMILY = 5
#: The number of turns taken is the id's checksum modulo this.
TAKEN = 9

NOTHING = hashlib.sha256().hexdigest()


def numbered_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, place, mark, bytes): the turns of each conversation numbered 1, 2, .. by turn, null first.

    Equal turns are ordered by role, then text. ``mark`` is a 128-bit digest of
    role and text. Rows are dealt to ranges of (conversation, turn), numbered
    inside their range, and start after the counts of the ranges before, so a
    conversation of any length spreads over tasks.
    """
    plain = turns.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long"), "turn", *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text")])
    marked = plain.select("*", F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text")
                                     .cast("binary")).alias("mark"))
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    ranged = stored(marked.repartitionByRange(F.col("conv_id"), *order)
                    .withColumn("part", F.spark_partition_id()), "ranged_turns")
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (ranged.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
              .select("conv_id", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")))
    inside = Window.partitionBy("part", "conv_id").orderBy(*order)
    return (ranged.withColumn("k", F.row_number().over(inside)).join(starts, ["conv_id", "part"])
            .select("conv_id", (F.col("start") + F.col("k")).alias("place"), "mark",
                    F.octet_length("text").cast("long").alias("bytes")))


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(convs, rows): every conversation with its length, and its turns as (conv_id, depth, mark, bytes).

    Conversation c is the first h turns of c - c % FAMILY, all if it has fewer,
    none if there is no such conversation, then its own turns after its first h; h
    is crc32 of c in decimal modulo TAKEN. ``turns`` as of ``numbered_turns``, stored.
    """
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("own")).select(
        "conv_id", "own", (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"),
        (F.crc32(F.col("conv_id").cast("string").cast("binary")) % TAKEN).alias("h"))
    convs = stored(convs, "conversations")
    of_base = convs.select(F.col("conv_id").alias("base"), F.col("own").alias("base_own"))
    convs = stored(convs.join(of_base, "base", "left").select(
        "conv_id", "base", "h", F.least("h", F.coalesce("base_own", F.lit(0))).alias("taken"),
        F.greatest(F.col("own") - F.col("h"), F.lit(0)).alias("kept")), "rebuilt_conversations")
    head = (convs.where("taken > 0").select("conv_id", F.col("base").alias("of"),
                                            F.explode(F.sequence(F.lit(1).cast("long"), F.col("taken"))).alias("place"))
            .join(turns.where(F.col("place") < TAKEN).withColumnRenamed("conv_id", "of"), ["of", "place"])
            .select("conv_id", F.col("place").alias("depth"), "mark", "bytes"))
    tail = (turns.join(convs.where("kept > 0").select("conv_id", "h", "taken"), "conv_id").where("place > h")
            .select("conv_id", (F.col("place") - F.col("h") + F.col("taken")).alias("depth"), "mark", "bytes"))
    return (convs.select("conv_id", (F.col("taken") + F.col("kept")).alias("turns")),
            stored(head.unionByName(tail), "rebuilt_turns"))


def _prefixes(rows: DataFrame) -> DataFrame:
    """``rows`` with (a, b), 128 bits that stand for all turns up to this one.

    Each turn gives bits that depend on its depth and mark; those of a prefix are
    combined by exclusive or, whose running value needs no order of work: first
    over stretches of ``STRETCH`` turns, then over the stretches of a conversation.
    """
    bits = rows.withColumn("a", F.xxhash64(F.lit(1), "depth", "mark")).withColumn("b", F.xxhash64("mark", "depth", F.lit(2)))
    cut = bits.withColumn("stretch", F.floor((F.col("depth") - 1) / STRETCH)).drop("mark")
    running = Window.partitionBy("conv_id", "stretch").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("conv_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    starts = (cut.groupBy("conv_id", "stretch").agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
              .select("conv_id", "stretch", *[F.coalesce(F.bit_xor(x).over(before), F.lit(0)).alias(f"start_{x}")
                                              for x in ("a", "b")]))
    return (cut.select("conv_id", "depth", "bytes", "stretch", *[F.bit_xor(x).over(running).alias(x) for x in ("a", "b")])
            .join(starts, ["conv_id", "stretch"])
            .select("conv_id", "depth", "bytes", *[F.col(x).bitwiseXOR(F.col(f"start_{x}")).alias(x) for x in ("a", "b")]))


def nodes_and_places(convs: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, places), stored: (conv_id, depth, n_convs, bytes) of every distinct prefix, known by its smallest
    member and depth; and (conv_id, depth, node), the node that each conversation passes at each depth."""
    root = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("bytes"),
                        F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
    passed = stored(_prefixes(rows).select("conv_id", "depth", "bytes", "a", "b").unionByName(root), "prefixes")
    found = stored(passed.groupBy("depth", "a", "b").agg(
        F.min("conv_id").alias("node"), F.count("*").alias("n_convs"), F.max("bytes").alias("bytes")), "nodes")
    places = stored(passed.select("conv_id", "depth", "a", "b").join(
        found.select("depth", "a", "b", "node"), ["depth", "a", "b"]).select("conv_id", "depth", "node"), "places")
    return found.select(F.col("node").alias("conv_id"), "depth", "n_convs", "bytes"), places


def _sent(rows: DataFrame, places: DataFrame, first: Column, last: Column, step: int, sums: list[str]) -> DataFrame:
    """The sums of ``rows`` given to those ancestors whose depths are ``step`` times the levels first..last."""
    up = rows.withColumn("level", F.explode(F.sequence(first, last)))
    return (up.select("conv_id", (F.col("level") * step).alias("depth"), *sums).join(places, ["conv_id", "depth"])
            .select(F.col("node").alias("conv_id"), "depth", *sums))


def subtree_totals(nodes: DataFrame, places: DataFrame, sums: list[str], band: int = BAND, step: int = 1) -> DataFrame:
    """``nodes`` (conv_id, depth, sums), all at multiples of ``step``, with sums over their subtrees.

    A node is sent to its ancestors inside its band of ``band`` levels. The tops
    of bands, now with the sums of their band, are a trie ``band`` times less deep,
    which is totalled in the same way; the completed total of a top is then sent
    once to its ancestors in the band above. So a node is sent to at most ``band``
    ancestors a round, and there are as many rounds as the depth has digits to the
    base ``band``, twice. Each round is written.
    """
    level = (F.col("depth") / step).cast("long")
    top = level - level % band
    here = stored(_sent(nodes, places, top, level, step, sums).groupBy("conv_id", "depth")
                  .agg(*[F.sum(c).alias(c) for c in sums]), "in_band")
    deepest = here.agg(F.max("depth")).first()[0]
    if deepest is None or deepest < band * step:
        return here
    tops = subtree_totals(here.where(level % band == 0), places, sums, band, step * band)
    up = _sent(tops.where("depth > 0"), places, level - band, level - 1, step, sums)
    return stored(here.unionByName(up).groupBy("conv_id", "depth")
                  .agg(*[F.sum(c).alias(c) for c in sums]), "completed")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (node, depth, conv_id) to one digest a node; ids are hashed as they come and never gathered."""
    key, running, done = None, None, []

    def finished() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict(dict(zip(("conv_id", "depth", "ends_sha256"), map(list, zip(*done)))))
    for batch in batches:
        nodes, depths, ids = (c.to_pylist() for c in batch.columns)
        at = 0
        while at < len(ids):
            end = at + 1
            while end < len(ids) and nodes[end] == nodes[at] and depths[end] == depths[at]:
                end += 1
            text = ",".join(map(str, ids[at:end])).encode()
            if key == (nodes[at], depths[at]):
                running.update(b"," + text)
            else:
                if key is not None:
                    done.append((*key, running.hexdigest()))
                key, running = (nodes[at], depths[at]), hashlib.sha256(text)
            at = end
        if done:
            yield finished()
            done.clear()
    if key is not None:
        done.append((*key, running.hexdigest()))
        yield finished()


def ends(convs: DataFrame, places: DataFrame) -> DataFrame:
    """(conv_id, depth, ends_sha256) of nodes at which conversations end: the digest of these, in order."""
    last = (convs.withColumnRenamed("turns", "depth").join(places, ["conv_id", "depth"])
            .select("node", "depth", "conv_id"))
    return (last.repartition("node", "depth").sortWithinPartitions("node", "depth", "conv_id")
            .mapInArrow(_digests, "conv_id long, depth long, ends_sha256 string"))


def trie(turns: DataFrame, band: int = BAND) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256), a row per node.

    A node is a distinct sequence of the first d turns (role, text) of rebuilt
    conversations, known by its depth d and its smallest member; the root has
    d = 0 and no parent. n_leaves and saved_tokens are totals of the subtree; a
    node saves (n_convs - 1) times the bytes of its last text.

    Null role and text are empty. Equal turns are ordered by role and text, and
    repeated rows are turns of their own. Rows without conv_id belong to no
    conversation and take no part. Long texts are only seen by the scan and one
    shuffle. Other columns are not looked at. An empty table has no nodes, not
    even a root. ``%`` of a negative id is negative, so it takes its first turns
    from the next multiple towards 0. All conversations may begin or end alike:
    counts are added up before they are shuffled, and the ids that end at one
    node pass through one task as a stream.
    """
    convs, rows = rebuilt(stored(numbered_turns(turns), "numbered_turns"))
    nodes, places = nodes_and_places(convs, rows)
    parents = places.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("node").alias("parent_conv_id"))
    nodes = stored(nodes.join(parents.where("depth > 0"), ["conv_id", "depth"], "left"), "nodes_with_parents")
    children = (nodes.where("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth"))
                .agg(F.count("*").alias("n_children")))
    nodes = stored(nodes.join(children, ["conv_id", "depth"], "left").na.fill(0, ["n_children"]), "nodes_with_children")
    own = nodes.select("conv_id", "depth", (F.col("n_children") == 0).cast("long").alias("n_leaves"),
                       ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens"))
    totals = subtree_totals(own, places, ["n_leaves", "saved_tokens"], band)
    return (nodes.join(totals, ["conv_id", "depth"]).join(ends(convs, places), ["conv_id", "depth"], "left")
            .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                    F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256")))
