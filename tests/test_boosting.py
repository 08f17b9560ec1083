"""Trees from histograms against trees grown row by row in plain Python."""
import math
import random

import pytest
from pyspark.sql import functions as F

from tablemill.operators import boosting
from tablemill.operators.store import stored

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows():
    rng, out = random.Random(3), []
    for i in range(200):
        a, b, c = round(rng.random(), 2), rng.choice([0.0, 0.25, 0.5]), rng.gauss(0, 1)
        out.append((i, a, b, c, float((a > 0.4) != (b > 0.2) or rng.random() < 0.1), rng.choice([1.0, 2.0])))
    return out


@pytest.fixture(scope="module")
def table(spark, rows):
    return stored(spark.createDataFrame(rows, "id int, a double, b double, c double, target double, weight double"), "rows")


def plain_tree(rows, margins, columns, edges, preset, depth, rate):
    """(splits as node -> (feature, threshold), leaf values), every place tried on the rows themselves."""
    slopes = {}
    for r, m in zip(rows, margins):
        p = 1 / (1 + math.exp(-m))
        slopes[r[0]] = (r[5] * (p - r[4]), r[5] * p * (1 - p))

    def sums(held):
        return sum(slopes[r[0]][0] for r in held), sum(slopes[r[0]][1] for r in held)

    def score(held):
        g, h = sums(held)
        return g * g / (h + preset.l2) if h + preset.l2 > 0 else 0.0

    def places(nodes):
        for f in columns:
            for e in edges[f]:
                parts = {k: ([r for r in held if r[1 + f] <= e], [r for r in held if r[1 + f] > e]) for k, held in nodes.items()}
                yield f, e, parts

    nodes, splits, gains, held = {1: rows}, {}, {}, {1: rows}
    for _ in range(depth):
        found = {}
        if preset.growth == "symmetric":
            best = 0.0
            for f, e, parts in places(nodes):
                gain = round(sum(score(x) + score(y) - score(nodes[k]) for k, (x, y) in parts.items()), 9)
                if gain > best:
                    best, found = gain, {k: (f, e, *xy) for k, xy in parts.items()}
        else:
            for k in nodes:
                best = 0.0
                for f, e, parts in places({k: nodes[k]}):
                    x, y = parts[k]
                    if min(sums(x)[1], sums(y)[1]) < preset.least_curvature or min(len(x), len(y)) < max(1, preset.least_rows):
                        continue
                    gain = round(score(x) + score(y) - score(nodes[k]), 9)
                    if gain > best:
                        best, found[k] = gain, (f, e, x, y)
                gains[k] = best
        nodes = {}
        for k, (f, e, x, y) in found.items():
            splits[k] = (f, e)
            held[2 * k], held[2 * k + 1] = x, y
            nodes |= {2 * k: x, 2 * k + 1: y}
    if preset.growth == "leaf":
        kept, able = {}, {1} & splits.keys()
        while able and len(kept) + 1 < preset.leaves:
            k = max(able, key=lambda k: (gains[k], -k))
            able = (able - {k}) | ({2 * k, 2 * k + 1} & splits.keys())
            kept[k] = splits[k]
        splits = kept
    leaves = {1} | {c for k in splits for c in (2 * k, 2 * k + 1)}
    values = {}
    for k in leaves - splits.keys():
        g, h = sums(held[k])
        values[k] = -rate * g / (h + preset.l2) if h + preset.l2 > 0 else 0.0
    return splits, values


@pytest.mark.parametrize("name,leaves", [("XGBoost", None), ("LightGBM", None), ("LightGBM", 5), ("CatBoost", None)])
def test_first_tree_is_the_plain_one(rows, table, name, leaves):
    preset = boosting.PRESETS[name]._replace(rows=1.0, columns=1.0)
    preset = preset._replace(leaves=leaves) if leaves else preset
    made = boosting.fit(table, FEATURES, ["id"], preset, 1, rounds=2, depth=4)
    margins = [made.start] * len(rows)
    for tree in made.trees:
        splits, values = plain_tree(rows, margins, range(3), made.edges, preset, 4, boosting.RATE)
        got = {k: (s.feature, made.edges[s.feature][s.bin]) for k, s in tree.splits.items()}
        assert len(got) > 2 and {k: v for k, v in got.items()} == splits
        assert tree.values == pytest.approx(values)
        for i, r in enumerate(rows):
            k = 1
            while k in splits:
                k = 2 * k + (r[1 + splits[k][0]] > splits[k][1])
            margins[i] += values[k]
    said = {r.id: r.m for r in table.select("id", F.expr(made.margin()).alias("m")).collect()}
    assert [said[r[0]] for r in rows] == pytest.approx(margins)
    if leaves:
        assert all(len(t.values) == leaves for t in made.trees)


def test_presets_differ_and_learn(table):
    made = {name: boosting.fit(table, FEATURES, ["id"], preset, 1, rounds=10, depth=3) for name, preset in boosting.PRESETS.items()}
    for name, model in made.items():
        wrong = table.where((F.expr(model.margin()) > 0) != (F.col("target") > 0.5)).count()
        assert wrong < 45, name
    assert all(len({(s.feature, s.bin) for k, s in t.splits.items() if k.bit_length() == d}) <= 1
               for t in made["CatBoost"].trees for d in range(1, 4))
    shapes = {name: [sorted((k, s.feature, s.bin) for k, s in t.splits.items()) for t in m.trees] for name, m in made.items()}
    assert shapes["XGBoost"] != shapes["LightGBM"] != shapes["CatBoost"] != shapes["XGBoost"]
    drawn = boosting.PRESETS["XGBoost"]._replace(columns=0.34)
    used = [{s.feature for s in t.splits.values()} for t in boosting.fit(table, FEATURES, ["id"], drawn, 1, rounds=6, depth=2).trees]
    assert max(map(len, used)) <= 2 and len(set().union(*used)) == 3


def test_margins_written_now_and_then_change_nothing(table, monkeypatch):
    preset = boosting.PRESETS["XGBoost"]
    one = boosting.fit(table, FEATURES, ["id"], preset, 5, rounds=5, depth=2)
    monkeypatch.setattr(boosting, "EVERY", 2)
    two = boosting.fit(table, FEATURES, ["id"], preset, 5, rounds=5, depth=2)
    assert [t.splits.keys() for t in one.trees] == [t.splits.keys() for t in two.trees]
    for a, b in zip(one.trees, two.trees):
        assert a.values == pytest.approx(b.values)


def test_nothing_to_cut(spark, table):
    same = stored(table.where("target = 1"), "same")
    made = boosting.fit(same, FEATURES, ["id"], boosting.PRESETS["XGBoost"], 1, rounds=2, depth=2)
    assert same.where(F.expr(made.margin()) <= 0).count() == 0
    none = stored(table.where("id < 0"), "none")
    made = boosting.fit(none, FEATURES, ["id"], boosting.PRESETS["LightGBM"], 1, rounds=2, depth=2)
    assert table.where(F.expr(made.margin()) > 0).count() == 0


def test_rows_are_drawn_by_the_digest_of_their_key(spark):
    import numpy as np
    keys = spark.range(2000).select(F.when(F.col("id") % 7 > 0, F.col("id")).alias("id"), (F.col("id") % 5).cast("string").alias("more"))
    for k in (0, 7, 199):
        drawn = F.pmod(F.xxhash64("id", "more", F.lit(42), F.lit(k)), F.lit(1 << 20)) < int(0.8 * (1 << 20))
        got = keys.select(F.xxhash64("id", "more", F.lit(42)).alias("d"), drawn.alias("drawn")).collect()
        said = boosting._drawn(np.array([r.d for r in got], np.int64), k, 0.8)
        assert said.tolist() == [r.drawn for r in got]


def test_a_level_is_one_job_of_one_stage(spark, table, monkeypatch):
    """A tree of depth 3 asks for sums three times; each time the blocks are read once and nothing is shuffled."""
    monkeypatch.setattr(boosting, "EVERY", 100)
    context, asked = spark.sparkContext, {}
    for rounds in (1, 6):
        group = f"boosting-{rounds}"
        context.setJobGroup(group, group)
        boosting.fit(table, FEATURES, ["id"], boosting.PRESETS["XGBoost"], 1, rounds=rounds, depth=3)
        jobs = [context.statusTracker().getJobInfo(i) for i in context.statusTracker().getJobIdsForGroup(group)]
        asked[rounds] = len(jobs), sum(len(j.stageIds) for j in jobs)
    context.setLocalProperty("spark.jobGroup.id", None)
    assert asked[6][0] - asked[1][0] <= 5 * 3 and asked[6][1] - asked[1][1] <= 5 * 3


def test_blocks_of_any_size_give_the_same_trees(table, monkeypatch):
    preset = boosting.PRESETS["LightGBM"]
    one = boosting.fit(table, FEATURES, ["id"], preset, 5, rounds=3, depth=3)
    monkeypatch.setattr(boosting, "BLOCK", 7)
    two = boosting.fit(table.repartition(3), FEATURES, ["id"], preset, 5, rounds=3, depth=3)
    assert [t.splits.keys() for t in one.trees] == [t.splits.keys() for t in two.trees]
    for a, b in zip(one.trees, two.trees):
        assert a.values == pytest.approx(b.values)
