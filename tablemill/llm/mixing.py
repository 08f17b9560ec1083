"""Entropy balancing: documents get rates, as even as may be, that meet their source's token target."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import columns_of, source_rank, stored, text_of, words

#: Weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)
#: No source and no document is taken more often than this.
MOST = 3
#: Newton stops when every source's words are this near their target, relatively.
NEAR = 1e-6
ROUNDS = 40
#: Documents of one source and size that are ranked in one task.
GROUP = 4096


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target) of (source, source_size).

    All words are shared by weight; a source stops at ``most`` times its own and
    leaves the excess to the others, until none is above. Each round needs two
    sums over the sources, and at least one more source stops in it.
    """
    rank = source_rank(sources, "source", "__rank").withColumnRenamed("source", "__of")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          (F.col("__rank") % len(weights) + 1).cast("int"))
    weighed = stored(
        sources.join(rank, sources["source"].eqNullSafe(rank["__of"]))
        .select("source", "source_size", weight.alias("__weight")), "weights")
    cap = F.col("source_size") * float(most)
    level, stopped = 0.0, -1
    while True:
        full = F.col("__weight") * F.lit(level) >= cap
        got = weighed.agg(
            F.sum("source_size").alias("all"), F.count_if(full).alias("full"),
            F.sum(F.when(full, cap)).alias("held"),
            F.sum(F.when(~full, F.col("__weight"))).alias("open")).first()
        if got["full"] == stopped or not got["open"]:
            break
        stopped = got["full"]
        level = (float(got["all"]) - float(got["held"] or 0.0)) / got["open"]
    return weighed.select("source", "source_size",
                          F.least(F.col("__weight") * F.lit(level), cap).alias("target"))


def _rate(tilt: Column, feature: Column, most: int) -> Column:
    return F.when(tilt.isNull(), 0.0).otherwise(
        F.least(F.lit(float(most)), F.exp(F.least(tilt * feature, F.lit(50.0)))))


def balance(cells: DataFrame, most: int = MOST, rounds: int = ROUNDS) -> DataFrame:
    """(source, tilt) of (source, size, n, source_size, target): where the convex dual is smallest.

    A document of size z takes rate min(most, exp(tilt * x)), with x = 1 + z / the source's
    largest size: the rates with the least relative entropy to "each once" that
    sum to the target in words weighed by x. Documents of one source and size share a
    rate, so every sum runs over (source, size, n) and a source with a third of
    all rows costs no more than one with as many sizes. A Newton step that
    leaves the bracket known so far is replaced by its middle, so it always ends.
    """
    state = stored(
        cells.groupBy("source").agg(
            F.max("size").alias("largest"), F.first("target").alias("target"),
            F.first("source_size").alias("source_size"))
        .select("source", "target", "source_size", "largest",
                F.lit(-50.0).alias("low"), F.log(F.lit(float(most))).alias("high"),
                F.greatest(F.log(F.expr("try_divide(target, source_size)")) / 1.5, F.lit(-50.0))
                .alias("tilt")), "tilt")
    for _ in range(rounds):
        joined = cells.select("source", "size", "n").join(
            state.withColumnRenamed("source", "__of"),
            F.col("source").eqNullSafe(F.col("__of")))
        x = 1.0 + F.col("size") / F.greatest(F.col("largest"), F.lit(1))
        rate, mass = _rate(F.col("tilt"), x, most), F.col("n") * F.col("size")
        sums = (joined.groupBy("source").agg(
            F.sum(mass * rate).alias("got"),
            F.sum(F.when(rate < most, mass * rate * x).otherwise(0.0)).alias("slope"),
            *[F.first(c).alias(c) for c in ("target", "source_size", "largest", "low", "high", "tilt")]))
        gap = F.col("got") - F.col("target")
        low = F.when(gap < 0, F.col("tilt")).otherwise(F.col("low"))
        high = F.when(gap > 0, F.col("tilt")).otherwise(F.col("high"))
        step = F.col("tilt") - F.try_divide(gap, F.col("slope"))
        middle = (low + high) / 2
        near = F.abs(gap) <= NEAR * F.col("target")
        new = F.when(near, F.col("tilt")).when(
            (F.col("slope") > 0) & (step > low) & (step < high), step).otherwise(middle)
        state = stored(sums.select("source", "target", "source_size", "largest", low.alias("low"),
                                   high.alias("high"), new.alias("tilt"), near.alias("near")), "tilt")
        if not state.where(~F.col("near")).limit(1).count():
            break
    return state.select("source", "tilt", "largest")


def copies_of_cells(cells: DataFrame, most: int = MOST) -> DataFrame:
    """(source, size, n, copies): the rates rounded to whole copies per source and size.

    Cells are first rounded with a dither that is spread evenly over the sizes of
    a source; what a source then lacks or has too much, a few documents' words,
    is mended from the largest size down, each size taking as many copies as fit.
    The mending folds over a source's distinct sizes, not over its documents.
    """
    tilt = balance(cells, most).withColumnRenamed("source", "__of")
    order = Window.partitionBy("source").orderBy("size")
    x = 1.0 + F.col("size") / F.greatest(F.col("largest"), F.lit(1))
    wanted = F.col("n") * _rate(F.col("tilt"), x, most)
    dither = F.expr("(row_number() OVER (PARTITION BY source ORDER BY size) * 0.6180339887498949D) % 1")
    rounded = stored(
        cells.join(tilt, F.col("source").eqNullSafe(F.col("__of")))
        .withColumn("__dither", dither)
        .select("source", "size", "n", "target",
                F.least(F.floor(wanted + F.col("__dither")), F.col("n") * most).alias("m")), "copies")
    per_source = (rounded.where(F.col("size") > 0).groupBy("source").agg(
        (F.first("target") - F.sum(F.col("size") * F.col("m"))).alias("lack"),
        F.reverse(F.sort_array(F.collect_list(F.struct("size", "n", "m")))).alias("sizes")))

    def mend(state, cell):
        room = F.when(state["lack"] > 0, cell["n"] * most - cell["m"]).otherwise(cell["m"])
        fit = F.least(room, F.floor(F.abs(state["lack"]) / cell["size"]))
        move = F.when(state["lack"] > 0, fit).otherwise(-fit).cast("long")
        return F.when(fit > 0, F.struct(
            (state["lack"] - move * cell["size"]).alias("lack"),
            F.concat(state["moves"], F.array(F.struct(
                cell["size"].alias("size"), move.alias("move")))).alias("moves"))).otherwise(state)

    start = F.struct(F.col("lack").cast("double").alias("lack"),
                     F.expr("CAST(array() AS array<struct<size:bigint,move:bigint>>)").alias("moves"))
    moves = (per_source.select(
        F.col("source").alias("__of"),
        F.explode(F.aggregate("sizes", start, mend)["moves"]).alias("__m"))
        .select("__of", F.col("__m.size").alias("__size"), F.col("__m.move").alias("__move")))
    return (rounded.join(moves, F.col("source").eqNullSafe(F.col("__of"))
                         & (F.col("size") == F.col("__size")), "left")
            .select("source", "size", "n", "target",
                    (F.col("m") + F.coalesce("__move", F.lit(0))).alias("copies")))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``docs`` with size, source_size, target and copies (0 to ``most``).

    The size of a document is its number of words, 0 for none and for null.
    Equal documents of equal source are told apart by the digest of doc_id and
    text alone, so runs agree; rows that are equal in all of it are exchangeable. A null
    source is a source like others. Documents without words have 0 copies
    taken of nothing: they are kept once. Columns named like the new ones are
    replaced; an empty table gives an empty one.
    """
    new = ("size", "source_size", "target", "copies")
    base = docs.drop(*new)
    sized = stored(base.select(
        "source", "doc_id", F.size(words(text_of())).cast("long").alias("size"),
        F.xxhash64("doc_id", "text").alias("digest")), "sizes")
    plan = copies_of_documents(sized, weights, most)
    own = base.withColumn("__digest", F.xxhash64("doc_id", "text"))
    twins = Window.partitionBy("__digest", "doc_id", "source").orderBy("source")
    left = own.withColumn("__twin", F.row_number().over(twins))
    right = (plan.withColumn("__twin", F.row_number().over(
        Window.partitionBy("digest", "doc_id", "source").orderBy("copies")))
        .select(F.col("digest").alias("__d"), F.col("doc_id").alias("__id"),
                F.col("source").alias("__of"), F.col("__twin").alias("__t"), *new))
    return (left.join(right, (F.col("__digest") == F.col("__d")) & (F.col("__twin") == F.col("__t"))
                      & left["doc_id"].eqNullSafe(F.col("__id"))
                      & left["source"].eqNullSafe(F.col("__of")))
            .select(*[left[f"`{c}`"] for c in base.columns], *new))


def copies_of_documents(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS,
                        most: int = MOST) -> DataFrame:
    """(source, doc_id, size, digest) with source_size, target, copies; ``sized`` is a stored table."""
    cells = stored(sized.groupBy("source", "size").agg(F.count("*").alias("n")), "cells")
    sources = stored(cells.groupBy("source").agg(
        F.sum(F.col("n") * F.col("size")).alias("source_size")), "sources")
    aim = stored(targets(sources, weights, most), "targets").withColumnRenamed("source", "__of")
    known = stored(
        cells.join(aim, F.col("source").eqNullSafe(F.col("__of"))).drop("__of"), "known")
    copies = copies_of_cells(known, most)
    # Documents of one source and size share their copies evenly; a large cell is cut by digest
    # into groups, each with its part of the copies, so that no task ranks a whole cell.
    cut = F.greatest(F.ceil(F.col("n") / GROUP), F.lit(1))
    cell = copies.join(aim.select("__of", "source_size"), F.col("source").eqNullSafe(F.col("__of")))
    cell = stored(cell.select(F.col("source").alias("__of"), F.col("size").alias("__size"),
                              F.col("n").alias("__n"), "copies", "source_size", "target",
                              cut.alias("__cut")), "cell_copies")
    here = (sized.join(cell, F.col("source").eqNullSafe(F.col("__of")) & (F.col("size") == F.col("__size")))
            .withColumn("__group", F.pmod(F.xxhash64("digest"), F.col("__cut"))))
    here = stored(here.select("source", "doc_id", "size", "digest", "__group", "__n", "copies",
                              "source_size", "target"), "grouped")
    key = ["source", "size", "__group"]
    before = (Window.partitionBy("source", "size").orderBy("__group")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    groups = (here.groupBy(*key).agg(F.count("*").alias("g"), F.first("__n").alias("n"),
                                     F.first("copies").alias("c"))
              .withColumn("upto", F.sum("g").over(before))
              .select(F.col("source").alias("__of"), F.col("size").alias("__size"),
                      F.col("__group").alias("__at"), F.col("g").alias("__g"),
                      (F.floor(F.col("c") * F.col("upto") / F.col("n"))
                       - F.floor(F.col("c") * (F.col("upto") - F.col("g")) / F.col("n")))
                      .alias("__c")))
    groups = stored(groups, "groups")
    rank = F.row_number().over(Window.partitionBy(*key).orderBy("digest", "doc_id"))
    return (here.withColumn("__rank", rank)
            .join(groups, F.col("source").eqNullSafe(F.col("__of"))
                  & (F.col("size") == F.col("__size")) & (F.col("__group") == F.col("__at")))
            .select("source", "doc_id", "size", "digest", "source_size", "target",
                    F.least(F.lit(most), (F.floor(F.col("__c") / F.col("__g")) + F.when(
                        F.col("__rank") <= F.col("__c") % F.col("__g"), 1).otherwise(0)))
                    .cast("int").alias("copies")))


def repeated(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``docs``, each row as often as the mix takes it; rows without words stay as they are,
    as they weigh nothing."""
    took = mix(docs, weights, most)
    times = F.when(F.col("size") == 0, 1).otherwise(F.col("copies"))
    return (took.withColumn("__time", F.explode(F.array_repeat(F.lit(0), times)))
            .select(*columns_of(took, {"size", "source_size", "target", "copies"} - set(docs.columns))))
