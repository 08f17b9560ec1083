"""Operators that look for like vectors, documents and passages, against all pairs."""
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablemill.llm import hashing, near_dup, neighbours, substrings
from tablemill.llm.components import components

SCHEMA = "doc_id long, text string"


def make(spark, items, schema=SCHEMA):
    return spark.createDataFrame(items, schema)


# -- vectors --------------------------------------------------------------------------------------

def plain_nearest(rows, asked, most):
    ok = [(k, np.array(v, float)) for k, v in rows
          if v and all(x is not None and math.isfinite(x) for x in v) and any(v) and k is not None]
    out = {}
    for k, v in ok:
        if asked(k):
            best = sorted((-float(v @ w), j) for j, w in ok if j != k)[:most]
            out[k] = [(j, -s) for s, j in best]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def vectors(n, d=16, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, d))
    rows = centres[rng.integers(0, 8, n)] + rng.normal(scale=0.6, size=(n, d))
    return [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(rows / np.linalg.norm(rows, axis=1)[:, None])]


def test_all_candidates_if_few(spark):
    rows = vectors(12, 4) + [(100, None), (101, []), (102, [0.0] * 4), (103, [1.0, None, 0.0, 0.0]), (None, [1.0] * 4),
                             (104, [1.0, float("nan"), 0.0, 0.0]), (105, [1.0, float("inf"), 0.0, 0.0])]
    got = found(neighbours.search(make(spark, rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 2 == 0))
    want = plain_nearest(rows, lambda k: k % 2 == 0, 20)
    assert {k: [j for j, _ in v] for k, v in got.items()} == {k: [j for j, _ in v] for k, v in want.items()}
    for k in want:
        assert [s for _, s in got[k]] == pytest.approx([s for _, s in want[k]])


def test_copies_tie_by_key_and_never_crowd_out(spark):
    rows = vectors(60, 8, 2)
    rows += [(1000 + i, rows[0][1]) for i in range(300)] + [(2000, [-0.0] + rows[3][1][1:]), (2001, [0.0] + rows[3][1][1:])]
    df = make(spark, rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit("old"))
    got = found(neighbours.search(df, F.col("vec_id") % 20 == 0, look=10_000))
    want = plain_nearest(rows, lambda k: k % 20 == 0, 20)
    assert got.keys() == want.keys()
    for k in want:
        assert [s for _, s in got[k]] == pytest.approx([s for _, s in want[k]])
        assert all(abs(a[1] - b[1]) < 1e-9 for a, b in zip(got[k], want[k]))
    assert [j for j, _ in got[1000]] == [0, *range(1001, 1020)]


def test_recall_in_whole_table(spark):
    rows = vectors(6000, 32, 3)
    got = found(neighbours.search(make(spark, rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0))
    want = plain_nearest(rows, lambda k: k % 20 == 0, 20)
    hits = sum(len({j for j, _ in got[k]} & {j for j, _ in want[k]}) for k in want)
    assert got.keys() == want.keys() and hits >= 0.9 * 20 * len(want)
    assert all(len(v) == 20 for v in got.values())


def test_recall_of_vectors_without_structure(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(rng.normal(size=(4000, 48)))]
    got = found(neighbours.search(make(spark, rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0,
                                  sample=1500))
    want = plain_nearest(rows, lambda k: k % 20 == 0, 20)
    assert sum(len({j for j, _ in got[k]} & {j for j, _ in want[k]}) for k in want) >= 0.9 * 20 * len(want)


def test_large_groups_are_cut(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 16)
    monkeypatch.setattr(neighbours, "QUERIES", 4)
    rows = vectors(500, 8, 4)
    got = found(neighbours.search(make(spark, rows, "vec_id long, embedding array<float>"),
                                  F.col("vec_id") % 50 == 0, codes=2, look=500))
    want = plain_nearest(rows, lambda k: k % 50 == 0, 20)
    assert {k: [j for j, _ in v] for k, v in got.items()} == {k: [j for j, _ in v] for k, v in want.items()}


def test_no_vectors(spark):
    assert neighbours.search(make(spark, [], "vec_id long, embedding array<float>"), F.lit(True)).count() == 0
    one = make(spark, [(1, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert neighbours.search(one, F.lit(True)).count() == 0


def test_pairs_come_by_their_sum():
    rng = np.random.default_rng(5)
    for _ in range(50):
        a, b = rng.normal(size=4), rng.normal(size=5)
        counts = {i: int(rng.integers(0, 3)) for i in range(20)}
        got, bar = neighbours.cells_in_order(a, b, counts, 5, 10 ** 9)
        order = sorted(((-(a[i] + b[j]), i * 5 + j) for i in range(4) for j in range(5)))
        assert got == [c for _, c in order if counts[c]]
        assert bar == pytest.approx(-max(s for s, c in order if counts[c]))


# -- components -----------------------------------------------------------------------------------

@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(400 + i, 401 + i) for i in range(70)]
    root = {x: x for e in edges for x in e}
    for _ in range(400):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.root for r in components(make(spark, edges, "a long, b long")).collect()}
    assert got == {x: r for x, r in root.items() if any(x in e and e[0] != e[1] for e in edges)}


# -- near duplicates ------------------------------------------------------------------------------

def sets(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    k = min(k, len(words))
    return frozenset(tuple(words[i:i + k]) for i in range(len(words) - k + 1))


def plain_groups(items, rule):
    own = [sets(t, rule.words) for _, t in items]
    root = list(range(len(items)))

    def up(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(items)):
        for j in range(i):
            both = len(own[i] & own[j])
            if both and rule.whole * both >= rule.part * len(own[i] | own[j]):
                root[up(i)] = up(j)
    ids = {}
    for i, (doc, _) in enumerate(items):
        if own[i]:
            ids.setdefault(up(i), []).append(doc)
    least = {r: min((d for d in v if d is not None), default=None) for r, v in ids.items()}
    mine = [least[up(i)] if own[i] else items[i][0] for i in range(len(items))]
    return sorted(((d, len(s), m, d == m) for (d, _), s, m in zip(items, own, mine)), key=str)


def corpus(seed, n=250):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    shared = " ".join(rng.choices(words, k=9))
    items = []
    for i in range(n):
        if items and rng.random() < 0.5:
            base = (rng.choice(items)[1] or "a b").split()
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4, 8])):
                base[rng.randrange(len(base))] = rng.choice(words)
            text = " ".join(base)
        else:
            text = " ".join(rng.choices(words, k=rng.randint(1, 150)))
            text = text + "\n" + shared if rng.random() < 0.6 else text
        items.append((i, text.upper() if rng.random() < 0.1 else text))
    return items + [(n, None), (n + 1, ""), (n + 2, " \n"), (None, "x y z q"), (5, "x Y z q"), (n + 3, "x y"), (n + 4, "X  y"),
                    (n + 5, "é É"), (n + 6, "É é"), (2, items[2][1]), (2, items[2][1])]


@pytest.mark.parametrize("seed,rule", [(1, near_dup.Rule(3, 85)), (2, near_dup.Rule()), (3, near_dup.Rule(3, 85))])
def test_groups_are_those_of_all_pairs(spark, seed, rule):
    items = corpus(seed)
    got = near_dup.group(make(spark, items).withColumn("kept", F.lit("old")), rule).collect()
    rows = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got), key=str)
    assert rows == plain_groups(items, rule)


def test_large_nodes_branch_and_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "SMALL", 3)
    monkeypatch.setattr(near_dup, "DEPTH", 3)
    rng = random.Random(9)
    words = [f"w{i}" for i in range(4000)]
    base = rng.choices(words, k=80)
    items = []
    for i in range(120):                                  # a drifting chain: far ends share little
        for _ in range(rng.choice([0, 1, 2, 5])):
            base[rng.randrange(80)] = rng.choice(words)
        items.append((i, " ".join(base)))
    rule = near_dup.Rule(3, 85)
    got = near_dup.group(make(spark, items), rule).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got), key=str) == plain_groups(items, rule)


def test_common_token_branches_over_levels(spark, monkeypatch):
    """Sets with a large common part meet in hot nodes, which come apart over several levels."""
    levels = []
    before = near_dup.stored
    monkeypatch.setattr(near_dup, "stored", lambda rows, name: levels.append(name) or before(rows, name))
    monkeypatch.setattr(near_dup, "SMALL", 8)
    rng = random.Random(5)
    common = " ".join(f"c{i}" for i in range(60))
    items = []
    for i in range(150):
        own = [f"v{rng.randrange(10 ** 6)}" for _ in range(60)]
        items.append((2 * i, common + " " + " ".join(own)))
        if i % 10 == 0:
            own[rng.randrange(60)] = "changed"
            items.append((2 * i + 1, common + " " + " ".join(own)))
    rule = near_dup.Rule(3, 85)
    got = near_dup.group(make(spark, items), rule).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got), key=str) == plain_groups(items, rule)
    assert levels.count("level") > 2


def test_near_copies_of_one_text_are_not_all_looked_up(spark, monkeypatch):
    """Copies of a text with so many changes that most pairs of them are not linked, but nearly."""
    rows = {}
    before = near_dup.stored
    monkeypatch.setattr(near_dup, "stored", lambda r, name: rows.setdefault(name, []).append(
        before(r, name)) or rows[name][-1])
    monkeypatch.setattr(near_dup, "CROWD", 16)
    rng = random.Random(12)
    words = [f"w{i}" for i in range(4000)]
    base, items = rng.choices(words, k=150), []
    for i in range(240):
        own = list(base)
        for place in rng.sample(range(150), rng.choice([2, 4, 6, 8, 10])):
            own[place] = rng.choice(words)
        items.append((i, " ".join(own)))
    rule = near_dup.Rule(3, 85)
    got = near_dup.group(make(spark, items), rule).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got), key=str) == plain_groups(items, rule)
    assert sum(r.count() for r in rows["across"]) < 10 * len(items)


@pytest.mark.parametrize("rule", [near_dup.Rule(3, 85), near_dup.Rule(), near_dup.Rule(3, 50)])
def test_linked_sizes_share_a_band(rule):
    for n in [*range(1, 3000), 20_000]:
        for m in {n, math.ceil(rule.least * n), (math.ceil(rule.least * n) + n) // 2}:
            assert set(rule.bands(n)) & set(rule.bands(m))


def test_odd_bits_never_differ_more_than_sets():
    rng = np.random.default_rng(8)
    for n in (1, 30, 900, 5000):
        one = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        two = np.unique(np.concatenate([one[rng.random(len(one)) < 0.9],
                                        rng.integers(0, 1 << 63, n // 9, dtype=np.uint64)]))
        bits = np.bitwise_count(hashing.odd_bits(one) ^ hashing.odd_bits(two)).sum()
        assert bits <= len(np.setxor1d(one, two)) and hashing.odd_bits(one).nbytes == hashing.ODD // 8


def test_one_of_each(spark):
    items = corpus(4)
    df = make(spark, items).withColumn("__x", F.lit(1)).withColumn("n_chars", F.lit(3))
    got = near_dup.one_of_each(df)
    assert got.columns == df.columns
    rule = near_dup.Rule()
    groups = {(d, n, m) for d, n, m, kept in plain_groups(items, rule) if kept and n}  # doc_id 5 is in two
    empty = [i for i in items if not sets(i[1], 5)]
    assert got.count() == len(groups) + len(empty)
    assert near_dup.one_of_each(make(spark, [])).count() == 0


def test_unlike_rows_without_doc_id_all_stay(spark):
    assert near_dup.one_of_each(make(spark, [(None, "a b c d e f"), (None, "g h i j k l"), (None, "a b c d e f")])).count() == 2


def test_very_long_text(spark):
    long = " ".join(str(i) for i in range(60_000))
    items = [(1, long), (2, long + " end"), (3, "z" * 300_000), (4, long[:len(long) // 2])]
    assert [(r.doc_id, r.component_id) for r in near_dup.group(make(spark, items)).orderBy("doc_id").collect()] == [
        (1, 1), (2, 1), (3, 3), (4, 4)]


# -- passages -------------------------------------------------------------------------------------

def passage_corpus(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(20_000)]
    passage = rng.choices(words, k=70)
    docs, planted = [], {}
    for i in range(160):
        body = rng.choices(words, k=rng.randint(30, 200))
        if i % 4 == 0:
            own = list(passage)
            for _ in range(rng.choice([0, 0, 2, 4])):
                own[rng.randrange(len(own))] = rng.choice(words)
            at = rng.randint(0, len(body))
            planted[i] = (at, at + len(own))
            body = body[:at] + own + body[at:]
        docs.append((i, " ".join(body)))
    return docs, planted


@pytest.mark.parametrize("seed", [1, 2])
def test_planted_passages_are_found_and_no_others(spark, seed):
    docs, planted = passage_corpus(seed)
    got = substrings.shared(make(spark, docs + [(None, None), (900, ""), (901, "a b c"), (0, docs[0][1])])).collect()
    seen = {}
    for r in got:
        assert r.doc_a != r.doc_b and r.n_matched >= 0.8 * r.n_words
        assert min(r.a_end - r.a_start, r.b_end - r.b_start) >= 50
        seen.setdefault(r.doc_a, []).append((r.a_start, r.a_end))
        seen.setdefault(r.doc_b, []).append((r.b_start, r.b_end))
    assert set(seen) == set(planted)
    for doc, spans in seen.items():
        low, high = planted[doc]
        assert any(abs(s - low) <= 6 and abs(e - high) <= 6 for s, e in spans)


def test_exact_copies_and_bounds(spark):
    docs, _ = passage_corpus(3)
    text = docs[1][1] + " " + docs[2][1]
    n = len(text.split())
    items = [(1, text), (2, text), (3, text.upper()), (None, text + " x")] + [(10 + i, text) for i in range(40)]
    got = substrings.shared(make(spark, items)).collect()
    whole = {d for r in got for d in (r.doc_a, r.doc_b) if r.n_matched == n}
    assert whole == {1, 2, 3, None, *range(10, 50)}
    assert len(got) <= 3 * len(items)
    assert substrings.shared(make(spark, [])).count() == 0


@pytest.mark.parametrize("size", [45, 60])
def test_passages_made_of_frequent_lines(spark, size):
    rng = random.Random(size)
    words = [f"w{i}" for i in range(20_000)]
    lines = [rng.choices(words, k=size) for _ in range(3)]
    items = []
    for i in range(150):
        some = lines[i % 3]
        if i in (40, 41, 80, 81):                        # two lines together, in two documents only
            some = lines[0] + lines[1] if i < 80 else lines[1] + lines[2]
        items.append((i, " ".join(rng.choices(words, k=40) + some + rng.choices(words, k=40))))
    got = substrings.shared(make(spark, items)).where(f"n_matched >= {2 * size}").collect()
    assert {tuple(sorted((r.doc_a, r.doc_b))) for r in got} == {(40, 41), (80, 81)}


def test_recall_of_passages_with_changed_words(spark):
    rng = random.Random(15)
    words = [f"w{i}" for i in range(200_000)]
    items, share = [], {}
    for at, (n, same) in enumerate([(52, 0.9), (60, 0.85), (80, 0.82)]):
        for i in range(1000 * at, 1000 * at + 200, 2):
            one = rng.choices(words, k=n)
            other = list(one)
            for place in rng.sample(range(1, n - 1), round(n * (1 - same))):
                other[place] = rng.choice(words)
            items += [(i + j, " ".join(rng.choices(words, k=50) + x + rng.choices(words, k=50)))
                      for j, x in enumerate((one, other))]
    got = {(min(r.doc_a, r.doc_b), max(r.doc_a, r.doc_b)) for r in substrings.shared(make(spark, items)).collect()}
    assert all(a % 2 == 0 and b == a + 1 for a, b in got)
    for at in range(3):
        share[at] = sum(a // 1000 == at for a, _ in got)
    print(share)
    assert share[0] >= 60 and share[1] >= 85 and share[2] >= 95


def aligned(x, y):
    """The passages of two lists of words, from every seed they have in common."""
    x, y = (substrings.word_hashes(" ".join(v)) for v in (x, y))
    (h, p), (g, q) = substrings.seeds(x), substrings.seeds(y)
    i, j = np.nonzero(h[:, None] == g[None])
    return substrings.passages(x, y, p[i], q[j])


@pytest.mark.parametrize("gap", [20, 40, 60, 100, 150, 200, 300, 600, 1000])
def test_two_passages_apart_are_both_found(gap):
    rng = random.Random(gap)
    words = [f"w{i}" for i in range(200_000)]
    one, two = (rng.choices(words, k=100) for _ in range(2))
    for short in (gap, gap // 3):                        # gaps of one length, and of two
        x = one + rng.choices(words, k=gap) + two
        y = rng.choices(words, k=30) + one + rng.choices(words, k=short) + two
        got = aligned(x, y)
        for start, end in ((0, 100), (100 + gap, 200 + gap)):
            assert any(a <= start and end <= b for a, b, *_ in got)
        assert all(same >= 0.8 * n >= 40 for *_, n, same in got)


def test_short_passages_in_a_row_are_all_found():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(200_000)]
    some = [rng.choices(words, k=60) for _ in range(5)]
    x, y = ([w for p in some for w in p + rng.choices(words, k=25)] for _ in range(2))
    held = {at for a, b, *_ in aligned(x, y) for at in range(a, b)}
    assert held >= {85 * k + i for k in range(5) for i in range(60)}


def test_long_gaps_are_aligned():
    rng = random.Random(6)
    words = [f"w{i}" for i in range(200_000)]
    middle = rng.choices(words, k=1100)
    other = [rng.choice(words) if at % 5 == 4 else w for at, w in enumerate(middle)]
    ends = [rng.choices(words, k=300) for _ in range(2)]
    got = aligned(ends[0] + middle + ends[1], ends[0] + other + ends[1])
    assert [r[-1] for r in got] == [600 + 880]


@pytest.mark.parametrize("seed", range(20))
def test_parts_are_the_longest_alike(seed):
    rng = random.Random(seed)
    steps = np.array([(n, n, n) if at % 2 == 0 else (rng.randint(0, n), rng.randint(0, n), 0)
                      for at in range(21) for n in (rng.randint(1, 30),)])

    def alike(s, e):
        a, b, n = steps[s:e].sum(axis=0)
        return s % 2 == 0 and e % 2 == 1 and min(a, b) >= 50 and n >= 0.8 * max(a, b)

    most = max((steps[s:e, 2].sum() for s in range(21) for e in range(s + 1, 22) if alike(s, e)), default=0)
    got = substrings._parts(steps, 50, 0.8)
    assert all(alike(s, e) for s, e in got) and max((steps[s:e, 2].sum() for s, e in got), default=0) == most
    assert all(e <= s or f <= r for s, f in got for r, e in got if (s, f) != (r, e))
    free = [(s, e) for s in range(21) for e in range(s + 1, 22)
            if alike(s, e) and all(e <= p or q <= s for p, q in got)]
    assert not free


def plain_chain(a, b, n, cost):
    order = sorted(range(len(a)), key=lambda j: b[j])
    best = {}
    for j in order:
        best[j] = n[j] + max([0.0] + [
            best[i] - cost * (a[j] - a[i] - n[i] + b[j] - b[i] - n[i]) for i in best
            if a[i] + n[i] <= a[j] and b[i] + n[i] <= b[j]])
    return max(best.values())


def test_chains_have_the_best_score():
    rng = random.Random(7)
    for _ in range(200):
        m = rng.randint(1, 12)
        a, b, n = (np.array([rng.randint(lo, hi) for _ in range(m)]) for lo, hi in ((0, 60), (0, 60), (1, 9)))
        got = substrings.chains(a, b, n, 0.3)
        assert sorted(j for c in got for j in c) == list(range(m))
        first = got[0]
        score = sum(n[j] for j in first) - 0.3 * sum(
            a[q] - a[p] - n[p] + b[q] - b[p] - n[p] for p, q in zip(first, first[1:]))
        assert score == pytest.approx(plain_chain(a, b, n, 0.3))


def test_every_long_run_has_a_seed():
    rng = np.random.default_rng(3)
    for n in (5, 6, 16, 17, 18, 200):
        h = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        _, at = substrings.seeds(h)
        gaps = np.diff(np.concatenate([[-1], at, [max(n - substrings.K + 1, 0)]]))
        assert (len(at) > 0) == (n >= substrings.K) and (n < substrings.K or gaps.max() <= substrings.WINDOW)


@pytest.mark.parametrize("stripe", [3, 4096])
def test_common_subsequence(monkeypatch, stripe):
    monkeypatch.setattr(substrings, "STRIPE", stripe)
    rng = random.Random(4)
    for _ in range(100):
        x, y = ([rng.randint(0, 4) for _ in range(rng.randint(0, 9))] for _ in range(2))
        table = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, p in enumerate(x):
            for j, q in enumerate(y):
                table[i + 1][j + 1] = table[i][j] + 1 if p == q else max(table[i][j + 1], table[i + 1][j])
        assert substrings._common(np.array(x), np.array(y)) == table[-1][-1]


def test_every_two_documents_of_a_passage_meet(spark):
    rng = random.Random(31)
    words = [f"w{i}" for i in range(20_000)]
    passage, line = rng.choices(words, k=60), rng.choices(words, k=12)
    items = [(i, " ".join(rng.choices(words, k=40) + (passage if i < 9 else line) + rng.choices(words, k=40))) for i in range(20)]
    got = [tuple(sorted((r.doc_a, r.doc_b))) for r in substrings.shared(make(spark, items)).collect()]
    assert sorted(got) == [(i, j) for i in range(9) for j in range(i + 1, 9)]


@pytest.mark.parametrize("block", [4, 128])
def test_a_passage_of_which_each_half_is_frequent(spark, monkeypatch, block):
    monkeypatch.setattr(substrings, "BLOCK", block)
    rng = random.Random(32)
    words = [f"w{i}" for i in range(20_000)]
    halves = [rng.choices(words, k=40) for _ in range(2)]
    items = [(i, " ".join(rng.choices(words, k=30) + halves[i % 2] + rng.choices(words, k=30))) for i in range(40)]
    for i in (11, 12, 13, 14):                           # others hold but one half, at lower and higher keys
        items.append((100 + i, " ".join(rng.choices(words, k=30) + halves[0] + halves[1] + rng.choices(words, k=30))))
    got = {tuple(sorted((r.doc_a, r.doc_b))) for r in substrings.shared(make(spark, items)).collect()}
    assert got == {(i, j) for i in range(111, 115) for j in range(i + 1, 115)}


def test_what_is_left_out_unaligned_has_no_passage(monkeypatch):
    rng = random.Random(33)
    words = [f"w{i}" for i in range(3000)]
    lines = [rng.choices(words, k=n) for n in (8, 14, 25, 33, 41, 47, 55)]
    first = rng.choices(words, k=10)
    texts = []
    for i in range(60):
        body = list(first)
        for line in rng.sample(lines, rng.choice([0, 1, 1, 2, 3])):
            line = list(line)
            for _ in range(rng.choice([0, 0, 1, 3])):
                line[rng.randrange(len(line))] = rng.choice(words)
            body += rng.choices(words, k=rng.choice([0, 2, 6, 40])) + line
        texts.append(" ".join(body + rng.choices(words, k=rng.choice([0, 3, 60]))))
    seed = int(substrings.seeds(substrings.word_hashes(" ".join(first)))[0].view("int64")[0])

    def found(few, cut):
        monkeypatch.setattr(substrings, "FEW", few)
        return sorted(substrings.meetings(seed, texts, list(range(len(texts))), [[]] * len(texts), cut))
    texts = [t for t in texts if seed in substrings.seeds(substrings.word_hashes(t))[0].view("int64")]
    assert len(texts) > 40
    every = found(-1, 0)
    assert len(every) > 40 and every == found(32, 0)
    assert found(32, 20) == [m for m in every if m[0] < 20 <= m[1]]


def test_copies_are_given_with_every_other_document(spark):
    rng = random.Random(34)
    words = [f"w{i}" for i in range(20_000)]
    passage = rng.choices(words, k=60)
    copied = [" ".join(rng.choices(words, k=9) + passage), " ".join(passage + rng.choices(words, k=5))]
    items = [(i, copied[i % 2]) for i in range(8)] + [(8, " ".join(passage)), (0, copied[0])]
    got = {}
    for r in substrings.shared(make(spark, items)).collect():
        a, b = sorted([(r.doc_a, r.a_start, r.a_end), (r.doc_b, r.b_start, r.b_end)])
        assert (a[0], b[0]) not in got
        got[a[0], b[0]] = (a[1:], b[1:])
    at = {0: (9, 69), 1: (0, 60)}
    other = {(i, j) for i in range(9) for j in range(i + 1, 9) if i % 2 != j % 2 or j == 8}
    assert other <= set(got)
    for i, j in other:
        assert got[i, j] == (at[i % 2], (0, 60) if j == 8 else at[j % 2])
    for kind in (0, 1):                                  # each copy with the first and the last of its kind
        assert sum(i % 2 == j % 2 == kind and j < 8 for i, j in got) == 5
