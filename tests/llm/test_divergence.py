"""Divergence of sources against plain sums over every term."""
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tablemill.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
TERM = re.compile("[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def corpus():
    rng = random.Random(4)
    words = ["the", "Of", "été", "ÉTÉ", "x1y", "don't", "a_b", "日本", "naïve", "zz", "q r"] + [f"w{chr(97 + i)}" for i in range(20)]
    out = [(1, None, None, None, 0), (2, "", "en", "empty", 0), (3, "12 !!", "xx", "only", 0), (4, None, "xx", "", 0),
           (5, "the " * 5000, "en", "s1", 0), (6, "a" * 3000 + " the", "en", "s1", 0)]
    for i in range(7, 160):
        text = " ".join(rng.choices(words, k=rng.randint(0, 30)))
        row = (i, text, rng.choice(["en", "en", "fr", None]), rng.choice(["s1", "s2", "Ω", None, "s3"]), 0)
        out += [row] * rng.choice([1, 1, 1, 3])
    return out


def plain(items, least, listed):
    count, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source, _ in items:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = TERM.findall((text or "").translate(LOWER))
        count[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        here = sorted(s for g, s in groups if g == lang)
        whole = Counter()
        for s in here:
            whole.update(count[lang, s])

        def shares(counts):
            total = sum(counts[t] for t in kept) + 5 * len(kept)
            return {t: 1 + 10**9 * (counts[t] + 5) // total for t in kept}
        p, q = {s: shares(count[lang, s]) for s in here}, shares(whole)
        for s in here:
            pair = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in here if o != s]
            term = [(t, p[s][t] - q[t]) for t in kept if count[lang, s][t] and p[s][t] > q[t]]
            for part, rows in (("pair", pair), ("term", term)):
                rows.sort(key=lambda r: (-r[1], r[0].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(rows)
                        if part == "pair" or k < listed]
    return sorted(out)


@pytest.mark.parametrize("least,listed,terms,sources,piece",
                         [(30, 50, 4096, 64, 1 << 23), (3, 4, 5, 2, 16), (1, 50, 7, 1, 1), (10**6, 50, 4, 2, 64)])
def test_audit(spark, monkeypatch, least, listed, terms, sources, piece):
    monkeypatch.setattr(divergence, "PIECE", piece)
    items = corpus()
    got = divergence.audit(spark.createDataFrame(items, SCHEMA), least, listed, terms, sources).collect()
    assert sorted(tuple(r) for r in got) == plain(items, least, listed)


def test_joint_tables_count_every_term_once(spark):
    items = corpus()
    entries, groups = divergence.priced(spark.createDataFrame(items, SCHEMA), 3)
    held = {(r.lang, r.source, r.term): r["count"] for r in entries.collect()}
    got = Counter()
    for r in divergence.joint_tables(entries, groups, 5, 2).collect():
        got[(r.lang, *sorted([(r.a, r.a_count), (r.b, r.b_count)]))] += r.terms
    want = Counter()
    sources = {(r.lang, r.source) for r in groups.collect()}
    for lang, a in sources:
        for other, b in sources:
            if other == lang and a < b:
                for t in {k[2] for k in held if k[0] == lang and k[1] in (a, b)}:
                    want[lang, (a, held.get((lang, a, t), 0)), (b, held.get((lang, b, t), 0))] += 1
    assert got == want


def test_shares_of_large_counts_are_exact(spark):
    rows = [(c, n, v) for c in (0, 1, 7, 10**12, 9 * 10**15) for n in (10**16, 10**13 + 7) for v in (1, 3, 10**7) if c <= n]
    got = spark.createDataFrame(rows, "c long, n long, v long").select(
        "*", divergence.share(F.col("c"), F.col("n"), F.col("v")).alias("p")).collect()
    assert all(r.p == 1 + 10**9 * (r.c + 5) // (r.n + 5 * r.v) for r in got)


def test_pieces_hold_every_term(monkeypatch):
    rng = random.Random(2)
    for size in (1, 2, 3, 7, 50):
        monkeypatch.setattr(divergence, "PIECE", size)
        for _ in range(50):
            text = "".join(rng.choice("ab  é1Z") for _ in range(rng.randint(0, 60)))
            got = [w for part in divergence._terms(text.encode()) for w in part]
            assert got == [t.encode() for t in TERM.findall(text.translate(LOWER))]


def test_nothing_and_other_columns(spark):
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = spark.createDataFrame(corpus(), SCHEMA)
    more = rows.withColumn("term", F.lit("x")).withColumn("count", F.lit(1)).withColumn("a.b", F.lit(1))
    assert divergence.audit(more, 3).count() == divergence.audit(rows, 3).count()
