"""Grid lookups by sweep, and the kernel's landmarks, against plain Python."""
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablemill import fixed
from tablemill.operators import grid, learn
from tablemill.operators.store import stored

CELLS = "page_id long, table_idx int, overlaps boolean, height int, src_row int, src_idx int, row int, col long, rowspan long, colspan long, text string"


def random_cells():
    """Tables whose cells leave holes, and others whose cells overlap."""
    rng, out = random.Random(5), []
    for page in range(40):
        overlaps, height, taken = page % 3 == 0, rng.randint(1, 6), set()
        for r in range(height):
            at = 0
            for i in range(rng.randint(0, 5)):
                at += rng.randint(0, 2)
                h, w = rng.randint(1, 3), rng.randint(1, 3)
                here = {(y, x) for y in range(r, min(r + h, height)) for x in range(at, at + w)}
                if not overlaps and here & taken:
                    at += 1
                    continue
                taken |= here
                out.append((page, 0, overlaps, height, r, i, r, at, h, w, f"{page}.{r}.{i}"))
                at += rng.randint(0, w)
    return out


@pytest.fixture(scope="module")
def cells(spark):
    rows = random_cells()
    slots, begin = defaultdict(dict), {}
    for c in rows:
        page, _, _, height, r, i, y, x, h, w, text = c
        for yy in range(y, min(y + h, height)):
            for xx in range(x, x + w):
                slots[page][yy, xx] = max(slots[page].get((yy, xx), (-1, -1, "")), (r, i, text))
    return rows, slots, stored(spark.createDataFrame(rows, CELLS), "cells")


def plan_of(rows):
    return rows._jdf.queryExecution().optimizedPlan().toString()


def no_range_join(rows):
    return not any(("<=" in line or ">=" in line or " < " in line or " > " in line)
                   for line in plan_of(rows).splitlines() if "Join" in line)


def test_cell_at(spark, cells):
    rows, slots, frame = cells
    asked = [(p, 0, r, c, "why") for p in range(41) for r in range(-1, 8) for c in range(0, 18)]
    found = grid.cell_at(grid.cover(frame), spark.createDataFrame(asked, "page_id long, table_idx int, row int, col long, more string"))
    assert no_range_join(found)
    got = {(r.page_id, r.row, r.col): r.text for r in found.collect()}
    assert len(got) == len(asked)
    assert got == {(p, r, c): slots[p].get((r, c), (0, 0, None))[2] for p, _, r, c, _ in asked}


def test_column_above_and_row_left(cells):
    rows, slots, frame = cells
    covered = grid.cover(frame)
    above, left = grid.column_above(frame, covered), grid.row_left(frame, covered)
    assert no_range_join(above) and no_range_join(left)
    got = {(r.page_id, r.src_row, r.src_idx): r.texts for r in above.collect()}
    beside = {(r.page_id, r.src_row, r.src_idx): r.texts for r in left.collect()}
    for page, _, _, height, r, i, y, x, h, w, text in rows:
        column = []
        for yy in range(y):
            hit = slots[page].get((yy, x))
            if hit and hit[2] not in column:
                column.append(hit[2])
        assert got.get((page, r, i), []) == column
        line = sorted((c[7], c[10]) for c in rows if c[0] == page and c[7] < x and c[6] <= y < min(c[6] + c[8], height))
        assert beside.get((page, r, i), []) == [t for _, t in line]


def test_a_line_of_a_hundred_thousand_cells_ends(spark):
    n = 100_000
    cells = spark.range(n).select(
        F.lit(1).cast("long").alias("page_id"), F.lit(0).alias("table_idx"), F.lit(False).alias("overlaps"), F.lit(1).alias("height"),
        F.lit(0).alias("src_row"), F.col("id").cast("int").alias("src_idx"), F.lit(0).alias("row"), (F.col("id") * 2).alias("col"),
        F.lit(1).cast("long").alias("rowspan"), F.lit(1).cast("long").alias("colspan"), F.col("id").cast("string").alias("text"))
    asked = cells.select("page_id", "table_idx", "row", "col").union(cells.select("page_id", "table_idx", "row", F.col("col") + 1))
    got = grid.cell_at(grid.cover(cells), asked).agg(F.count("*").alias("n"), F.count("text").alias("held"), F.count_if(
        F.col("text").cast("long") * 2 == F.col("col")).alias("right")).first()
    assert (got.n, got.held, got.right) == (2 * n, n, n)
    last = grid.row_left(cells.where(f"src_idx IN (5, {n - 1})"), grid.cover(cells)).select("src_idx", F.size("texts").alias("k"))
    assert {(r.src_idx, r.k) for r in last.collect()} == {(5, 5), (n - 1, n - 1)}


def test_kernel_error(spark):
    """300 tables' shares of types: the mean error of the kernel stays below 0.002, the largest below 0.1."""
    rng = np.random.default_rng(2)
    points = rng.dirichlet([1.5, 0.3, 2.0, 0.2, 0.2, 0.4, 0.3], 300)
    gamma = 1 / (points.shape[1] * points.var())
    marks, root = learn.kernel_map(points, gamma, learn.LANDMARKS)
    mapped = np.exp(-gamma * ((points[:, None] - marks[None]) ** 2).sum(axis=2)) @ root
    exact = np.exp(-gamma * ((points[:, None] - points[None]) ** 2).sum(axis=2))
    error = np.abs(mapped @ mapped.T - exact)
    assert error.mean() < 0.002 and error.max() < 0.1
    rows = spark.createDataFrame([(i, 0, *map(float, p)) for i, p in enumerate(points)], ["page_id", "table_idx", *fixed.FEATURES])
    stage = learn._kernel_stage(rows)
    got = stage.transform(rows).orderBy("page_id").collect()
    features = np.asarray([[r[f"rbf_{k}"] for k in range(learn.LANDMARKS)] for r in got])
    assert np.abs(features @ features.T - exact).mean() < 0.002
    few = learn.kernel_map(points[[3, 3, 5]], gamma, 8)
    assert few[0].shape == (2, 7)
