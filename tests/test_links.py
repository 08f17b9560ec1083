import random

from conftest import table
from pyspark.sql import functions as F

from tablemill.operators import grid, links, verdict
from tablemill.operators.store import stored
from tablemill.sources import tables


def random_tables(n, seed=11):
    """Tables with headers, sections, totals and spans, most of them sound, some broken."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        groups = [rng.randint(1, 3) for _ in range(rng.randint(1, 3))]
        width = sum(groups)
        two = max(groups) > 1 and rng.random() < .7
        head = ["<th rowspan=2>K</th>" if two else "K"]
        head += [f"<th colspan={g}>G{i}</th>" if g > 1 else (f"<th rowspan=2>G{i}</th>" if two else f"G{i}")
                 for i, g in enumerate(groups)] if two else [f"h{i}" for i in range(width)]
        rows = [head]
        if two:
            rows.append([f"s{i}{j}" for i, g in enumerate(groups) if g > 1 for j in range(g)])
        if rng.random() < .2:
            rows.append([f"<td colspan={width + 1}>Section</td>"])
        for part in range(rng.randint(1, 3)):
            for k in range(rng.randint(1, 3)):
                rows.append([f"k{part}{k}"] + [rng.choice(["1", "2", "-"]) for _ in range(width)])
            if width > 1 and rng.random() < .6:
                rows.append([f"<td colspan=2>sum{part}</td>"] + [
                    rng.choice(["3", "4", ""]) for _ in range(width - 1)])
        if width > 2 and rng.random() < .5:
            rows.append(["<td colspan=3>all</td>"] + ["9"] * (width - 2))
        if rng.random() < .25:      # break something
            row = rng.choice(rows)
            row[rng.randrange(len(row))] = rng.choice(
                ["<td rowspan=2>r</td>", "<td colspan=2>c</td>", "<td rowspan=2 colspan=2>rc</td>", "z"])
        out.append(table(*rows))
    return out


def by_walking(cells):
    """Paths and totals of one table by walking its grid, slot by slot."""
    cells = sorted(cells, key=lambda c: (c.p_row, c.p_col))
    height, slot = 1 + max(c.p_row for c in cells), {}
    for c in cells:
        for r in range(c.p_row, min(c.p_row + max(c.p_rowspan, 1), height)):
            for k in range(c.p_col, c.p_col + max(c.p_colspan, 1)):
                slot[r, k] = c

    def met(places, role):
        seen = []
        for place in places:
            c = slot.get(place)
            if c is not None and c.role == role and c.cell_no not in seen:
                seen.append(c.cell_no)
        return seen
    above = {c.cell_no: met([(r, c.p_col) for r in range(c.p_row)], "title") for c in cells}
    beside = {c.cell_no: met([(c.p_row, k) for k in range(c.p_col)], "sidebar") for c in cells}
    types = {}
    for c in cells:
        if c.role == "data":
            for t in above[c.cell_no]:
                types.setdefault(t, set()).add(c.detail)

    def signature(r):
        for c in cells:
            if c.p_row == r and c.role == "result" and c.detail == "STRING":
                return c.p_col, c.p_colspan
    totals = set()
    for c in cells:
        if c.role != "result" or c.type != "GENUINE" or not above[c.cell_no]:
            continue
        if types.get(above[c.cell_no][-1], set()) - {"DIMENSION", "MONEY", "PERCENT", "MEASUREMENT", "NO_DATA"}:
            continue
        for r in range(c.p_row - 1, -1, -1):
            other = slot.get((r, c.p_col))
            if other is None:
                continue
            if other.role == "title" or other.role == "result" and signature(r) == signature(c.p_row):
                break
            if other.role == "data":
                totals.add((c.cell_no, other.cell_no))
    return above, beside, totals


def test_paths_and_totals_equal_walking_the_grid(as_pages):
    pathed = stored(links.paths(verdict.roles(verdict.judge(as_pages(random_tables(500))))), "pathed")
    found, totals = {}, {}
    for r in pathed.collect():
        found.setdefault(r.page_id, []).append(r)
    for r in links.total_links(pathed).collect():
        totals.setdefault(r.page_id, []).append((r.total.no, r.data.no))
    assert len(found) > 200 and sum(map(len, totals.values())) > 200
    for page, cells in found.items():
        above, beside, summed = by_walking(cells)
        for c in cells:
            assert [n.no for n in c.header_path] == above[c.cell_no], (page, c)
            assert [n.no for n in c.sidebar_path] == beside[c.cell_no], (page, c)
        mine = totals.get(page, [])
        assert len(mine) == len(set(mine)) and set(mine) == summed, page


def test_spreading_and_keeping_together_agree(as_pages):
    cells = verdict.roles(verdict.judge(as_pages(random_tables(60, 2))))
    view = ["page_id", "cell_no", "header_path.no", "sidebar_path.no"]
    one = sorted(map(str, links.paths(cells).select(*view).collect()))
    two = sorted(map(str, links.paths(cells, colocate=False).select(*view).collect()))
    assert one == two and one


def test_paths_shuffle_once(as_pages):
    cells = links.paths(verdict.roles(verdict.judge(as_pages(random_tables(5)))))
    plan = cells._jdf.queryExecution().executedPlan().toString()
    initial = plan.split("Initial Plan")[-1]
    assert initial.count("Exchange hashpartitioning") == 1
    assert initial.count("ArrowEvalPython") == 2


def test_audit_finds_a_wrong_total(as_pages):
    html = table(["K", "A", "B"], ["x", "1", "2"], ["y", "3", "4,5"], ["<td colspan=2>sum</td>", "7"])
    pathed = stored(links.paths(verdict.roles(verdict.judge(as_pages([html])))), "pathed")
    got = links.audit_totals(links.total_links(pathed)).collect()
    assert [(r.row, r.col, r.stated, r.summed, r.n_cells, r["diff"]) for r in got] == [
        (3, 2, 7.0, 6.5, 2, 0.5)]


def test_cover_settles_overlaps(as_pages):
    rng = random.Random(4)
    pages = [table(*[[f"<td rowspan={rng.randint(1, 3)} colspan={rng.randint(1, 3)}>{r}.{c}</td>"
                      for c in range(rng.randint(1, 3))] for r in range(rng.randint(1, 4))])
             for _ in range(150)]
    cells = tables.extract_cells(tables.extract_tables(as_pages(pages)))
    expected, overlapping = {}, 0
    for c in sorted(cells.collect(), key=lambda c: (c.page_id, c.src_row, c.src_idx)):
        overlapping += c.overlaps
        for r in range(c.row, min(c.row + c.rowspan, c.height)):
            for k in range(c.col, c.col + c.colspan):
                expected[c.page_id, r, k] = c.text
    got = {(r.page_id, r.row, r.col): r.text for r in grid.slots(grid.cover(cells)).collect()}
    assert got == expected and overlapping
    assert grid.slots(grid.cover(cells)).count() == len(expected)


def test_left_tables_keep_page_places(as_pages):
    html = table(["Date", "2024-01-01"], ["Qty", "5"])
    got = {(r.row, r.col): (r.role, [n.text for n in r.header_path]) for r in links.paths(
        verdict.roles(verdict.judge(as_pages([html])))).collect()}
    assert got == {(0, 0): ("title", []), (0, 1): ("data", ["Date"]), (1, 0): ("title", []),
                   (1, 1): ("data", ["Qty"])}


def test_giant_table(as_pages):
    """One table holding nearly all cells goes through whole."""
    big = table(["K", "A", "B"], *[[f"k{i}", str(i), "-"] for i in range(20000)],
                ["<td colspan=2>sum</td>", "7"])
    pages = as_pages([big] + random_tables(20))
    pathed = stored(links.paths(verdict.roles(verdict.judge(pages))), "pathed")
    assert pathed.where("page_id = 0 AND size(header_path) = 1").count() == 60002
    assert links.total_links(pathed).where("page_id = 0").count() == 20000
