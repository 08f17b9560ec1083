"""Quality of a document: fixed rules, then the likelihood ratio of its hashed n-grams under trusted and raw text."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bind, columns_of, stored, text_of, words

#: Counters that 1-grams and 2-grams are hashed to; a power of two.
BUCKETS = 1 << 14
#: Labelled documents that stand for trusted text, chosen by digest: half gives the
#: counts, half the threshold. The raw counts take every document.
TRUSTED = 20_000
#: This share of trusted documents may fall below the threshold, at most.
LOST = 0.01
MIN_WORDS = 50
MOST_REPEATED = 50                     # per cent of words
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"

RULES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _covered(hashes: Column) -> Column:
    """Words in 3-word windows that occur twice, of the words' hashes.

    If windows are not all distinct, they are sorted by hash, so equal ones are neighbours; those that have
    an equal neighbour are put back in order, and each covers what the next leaves of three words.
    """
    windows = F.transform(
        F.slice(hashes, 1, F.greatest(F.size(hashes) - 2, F.lit(0))),
        lambda h, i: F.xxhash64(h, F.get(hashes, i + 1), F.get(hashes, i + 2)))

    def twice(sorted_: Column) -> Column:
        def known(w: Column, j: Column) -> Column:
            other = F.coalesce(F.get(sorted_, j - 1)["h"] == w["h"], F.lit(False))
            return F.when(other | F.coalesce(F.get(sorted_, j + 1)["h"] == w["h"], F.lit(False)), w["i"])
        return F.sort_array(F.filter(F.transform(sorted_, known), lambda i: i.isNotNull()))

    def total(places: Column) -> Column:
        gaps = F.transform(places, lambda p, j: F.least(
            F.coalesce(F.get(places, j + 1) - p, F.lit(3)), F.lit(3)))
        return F.aggregate(gaps, F.lit(0), lambda s, g: s + g)

    def covered(each: Column) -> Column:
        placed = F.transform(each, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(each)) == F.size(each), 0).otherwise(
            bind(bind(F.sort_array(placed), twice), total))

    return bind(windows, covered)


def _hashes(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def _pairs(hashes: Column) -> Column:
    """Hashes of neighbours, one fewer than words."""
    return F.zip_with(F.slice(hashes, 1, F.greatest(F.size(hashes) - 1, F.lit(0))),
                      F.slice(hashes, 2, F.greatest(F.size(hashes) - 1, F.lit(0))),
                      lambda a, b: F.xxhash64(a, b))


def _bucket(h: Column) -> Column:
    return h.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")


def rules(docs: DataFrame, text: str = "text", weight: list[float] | None = None) -> DataFrame:
    """``docs`` with the counts of ``RULES`` and base_failed, and with ``weight`` also llr; see ``judged``.

    A text is cut into words and these are hashed once for all of them.
    """
    whole = text_of(text)
    lines = F.filter(F.split(whole, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counts = bind(_hashes(whole), lambda h: F.struct(
        F.size(h).cast("long").alias("n_words"), _covered(h).cast("long").alias("n_repeat_words"),
        *([] if weight is None else [_mean(weight, h).alias("llr")])))
    out = docs.withColumn("__n", counts)
    n, repeated = F.col("__n.n_words"), F.col("__n.n_repeat_words")
    return out.select(
        *columns_of(out, {*RULES, "base_failed", "__n"}), n.alias("n_words"),
        F.length(F.translate(whole, BLANKS, "")).cast("long").alias("word_chars"),
        (F.length(whole) - F.length(F.translate(whole, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        bind(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated.alias("n_repeat_words"),
        ((n < MIN_WORDS) | (100 * repeated > MOST_REPEATED * n)).alias("base_failed"),
        *([] if weight is None else [F.col("__n.llr").alias("llr")]))


def weights(docs: DataFrame, trusted: DataFrame, text: str = "text") -> list[float]:
    """The log likelihood ratio of each bucket, trusted over raw, both smoothed by one.

    ``trusted`` holds distinct doc_id, as few as ``TRUSTED`` allows, and is
    broadcast; there are as many sums as buckets, whatever the corpus.
    """
    known = trusted.select(F.col("doc_id").alias("__id"), F.lit(True).alias("__trusted"))
    here = docs.select("doc_id", F.col(text).alias("text")).join(
        F.broadcast(known), F.col("doc_id") == F.col("__id"), "left")
    buckets = bind(_hashes(text_of()), lambda h: F.concat(
        F.transform(h, _bucket), F.transform(_pairs(h), _bucket)))
    counts = (here.select("__trusted", F.explode(buckets).alias("bucket")).groupBy("bucket")
              .agg(F.count("*").alias("raw"), F.count("__trusted").alias("trusted")).collect())
    raw, good = [1] * BUCKETS, [1] * BUCKETS
    for c in counts:
        raw[c["bucket"]] += c["raw"]
        good[c["bucket"]] += c["trusted"]
    level = math.log(sum(raw) / sum(good))
    return [round(math.log(g / r) + level, 5) for g, r in zip(good, raw)]


def ratio(weight: list[float], text: str = "text") -> Column:
    """Mean log likelihood ratio of a text's 1-grams and 2-grams; 0 for a text without words."""
    return bind(_hashes(text_of(text)), lambda h: _mean(weight, h))


def _mean(weight: list[float], h: Column) -> Column:
    table = F.from_json(F.lit("[" + ",".join(f"{w:g}" for w in weight) + "]"), "array<double>")
    following = F.slice(h, 2, F.greatest(F.size(h), F.lit(1)))
    each = F.zip_with(h, following, lambda a, b: F.get(table, _bucket(a)) + F.when(
        b.isNotNull(), F.get(table, _bucket(F.xxhash64(a, b)))).otherwise(0.0))
    return F.aggregate(each, F.lit(0.0), lambda s, x: s + x) / F.greatest(2 * F.size(h) - 1, F.lit(1))


def trusted_ids(labels: DataFrame, most: int = TRUSTED) -> DataFrame:
    """doc_id, and part 0 or 1, of at most ``most`` documents labelled as good, by digest."""
    digest = F.xxhash64("doc_id")
    return stored(
        labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull())
        .select("doc_id").distinct().orderBy(digest, "doc_id").limit(most)
        .withColumn("part", F.pmod(F.shiftright(digest, 7), F.lit(2))), "trusted")


def cut_between(counts: list[tuple[float, int, int]], lost: float = LOST) -> float | None:
    """The threshold for (score, good, bad) counts: of those that lose at most ``lost`` of the
    good, the one with the best F1 for the bad, in the middle of its gap; the ``lost`` quantile
    if there are no bad, None if there are no good."""
    counts = sorted(counts)
    good, bad = sum(c[1] for c in counts), sum(c[2] for c in counts)
    if not good:
        return None
    below_good = below_bad = 0
    best, cut = -1.0, counts[0][0]
    for at, (score, g, b) in enumerate(counts):
        if below_good > lost * good:
            break
        if not bad:
            cut = score
        elif (f1 := 2 * below_bad / (below_good + below_bad + bad)) > best:
            best, cut = f1, (score + counts[at - 1][0]) / 2 if at else score
        below_good, below_bad = below_good + g, below_bad + b
    return cut


def judged(docs: DataFrame, labels: DataFrame, text: str = "text", most: int = TRUSTED,
           lost: float = LOST) -> DataFrame:
    """``docs`` with the rules' counts, base_failed, llr and kept.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the whole text; a null text has none.
    A document fails the rules below 50 words or if more than half of them stand in
    repeated 3-word windows. Else it is kept if its n-grams' mean likelihood ratio,
    trusted over raw, is not below a threshold, set by ``cut_between`` from trusted documents that
    were not counted and as many at most that are labelled as bad, all of which pass the rules. Without trusted documents the rules decide alone.
    Rows are judged by their text, so repeated rows agree; columns named
    like the new ones are replaced; an empty table gives an empty one.
    """
    chosen = trusted_ids(labels, most)
    weight = weights(docs, chosen.where("part = 0"), text)
    digest = F.xxhash64("doc_id")
    bad = stored(labels.where((F.col("quality") == 0) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
                 .join(chosen, "doc_id", "left_anti").orderBy(digest, "doc_id").limit(most), "bad")
    sides = F.broadcast(chosen.where("part = 1").select(F.col("doc_id").alias("__id"), F.lit(1).alias("good"))
                        .unionByName(bad.select(F.col("doc_id").alias("__id"), F.lit(0).alias("good"))))
    # stored, as the rules would else be counted for every document before the join
    held = rules(stored(docs.select("doc_id", F.col(text).alias("text")).join(
        sides, F.col("doc_id") == F.col("__id")), "held"), weight=weight)
    # scores in thousandths: as few counts as there are of these
    counts = (held.where("not base_failed").groupBy(F.round("llr", 3).alias("score"))
              .agg(F.sum("good").alias("good"), F.sum(1 - F.col("good")).alias("bad")).collect())
    cut = cut_between([(c["score"], c["good"], c["bad"]) for c in counts], lost)
    threshold = -math.inf if cut is None else round(cut, 6)
    scored = rules(docs.drop("llr", "kept"), text, weight)
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= F.lit(threshold)))
