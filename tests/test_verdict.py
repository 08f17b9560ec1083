import random

import pytest
from conftest import table
from pyspark.sql import functions as F

from tablemill.operators import lines, verdict
from tablemill.functions import spans
from tablemill.operators import grid
from tablemill.sources import tables

HEAD = ["Name", "Value"]
CASES = [  # markup, verdict, orientation, part of the message
    (table(HEAD, ["a", "1"], ["b", "2"]), "genuine", "top", None),
    (table(["Date", "2024-01-01"], ["Qty", "5"]), "genuine", "left", None),
    (table(["a", "b"]), "LayoutError", None, "1 на 2"),
    (table(["a"], ["b"], ["c"]), "LayoutError", None, "3 на 1"),
    (table(["a"], ["b", "c"]), "LayoutError", None, "2 на 1"),
    (table(["a", "b"], ["c"]), "LayoutError", None, "слишком малого"),
    # a header of two levels, and one that does not end on one line
    (table(["<td rowspan=2>R</td>", "<td colspan=2>G</td>"], ["a", "b"], ["x", "1", "2"],
           ["y", "3", "4"]), "genuine", "top", None),
    (table(["R", "<td colspan=2>G</td>"], ["x", "1", "p"], ["y", "3", "q"]), "LayoutError", None,
     "не соответствует заголовку"),
    (table(["R", "<td colspan=2>G</td>"], ["x", "1", "2"], ["y", "3", "4"]), "genuine", "left", None),
    (table(["A", "<td rowspan=2>B</td>"], ["x"], ["y", "3"]), "LayoutError", None, "выступает"),
    # wrong kinds of content
    (table(["<td><img></td>", "B"], ["a", "1"], ["b", "2"]), "TitleTypeError", None, "MEDIA"),
    (table(["A", "B", "C"], ["a", "1", "x"], ["b", "<td><img></td>", "y"]), "DataTypeError", None, "PHOTO"),
    (table(["A", "B", "C"], ["a", "1", "x"], ["<td><input></td>", "2", "5"]), "DataTypeError", None, ""),
    (table(["A", "B", "C"], ["a", "1", "x"], ["", "2", "y"]), "TitleTypeError", None, "боковик"),
    # totals, sections, split and merged cells, empty cells that lend their height
    (table(["A", "B", "C"], ["a", "1", "2"], ["b", "3", "4"], ["<td colspan=2>Total</td>", "6"]),
     "genuine", "top", None),
    (table(["A", "B", "C"], ["<td colspan=3>Part</td>"], ["a", "1", "2"], ["b", "3", "4"]),
     "genuine", "top", None),
    (table(["A", "B", "C"], ["a", "1", "2"], ["<td colspan=2>Total</td>", "x"], ["b", "3", "4"]),
     "DataTypeError", None, "Несовместимые"),
    (table(["A", "B", "C"], ["a", "1", "x"], ["<td colspan=3>5</td>"], ["b", "3", "y"]),
     "DataTypeError", None, "нет типа данных строка"),
    (table(["A", "B", "C"], ["<td rowspan=2>a</td>", "u", "p"], ["v", "q"],
           ["<td colspan=2>w</td>", "<td><a>r</a></td>"]), "genuine", "top", None),
    (table(["A", "B"], ["a", "1"], ["b", "<td rowspan=2></td>"], ["c"]), "LayoutError", None, "зубчатые"),
    (table(HEAD, ["a", "1"], ["b", "<td rowspan=4>2</td>"], ["c"]), "LayoutError", None, "rowspan=3"),
    # unreadable
    (table(HEAD, ["a", "<td rowspan=0>1</td>"], ["b", "2"]), "error", None, "ValueError"),
    (table(HEAD, ["a", "<td colspan=two>1</td>"], ["b", "2"]), "error", None, "'two'"),
    (table(HEAD, ["a", "<td colspan=0>1</td>", "2"], ["b", "2"]), "genuine", "left", None),
]


def test_hand_made_tables(as_pages):
    got = {r.page_id: r for r in verdict.verdicts(
        verdict.judge(as_pages([c[0] for c in CASES]))).collect()}
    wrong = [(c, got[i]) for i, c in enumerate(CASES)
             if (got[i].verdict, got[i].orientation) != c[1:3]
             or (c[3] is None) != (got[i].message is None)
             or (c[3] is not None and c[3] not in got[i].message)]
    assert not wrong, "\n".join(map(str, wrong))


def test_roles(as_pages):
    html = table(["<td rowspan=2>R</td>", "<td colspan=2>G</td>"], ["a", "b"], ["x", "1", "2"],
                 ["y", "3", "4"], ["<td colspan=2>Sum</td>", "6"])
    got = {(r.row, r.col): r.role for r in verdict.roles(verdict.judge(as_pages([html]))).collect()}
    assert got == {(0, 0): "title", (0, 1): "title", (1, 1): "title", (1, 2): "title",
                   (2, 0): "sidebar", (2, 1): "data", (2, 2): "data", (3, 0): "sidebar",
                   (3, 1): "data", (3, 2): "data", (4, 0): "result", (4, 2): "result"}


POOL = ["", "-", "a", "b", "5", "$5", "2024-01-01", "<a>x</a>", "<img>", "7 см"]


@pytest.fixture(scope="module")
def random_grids():
    rng = random.Random(3)
    grids = []
    for _ in range(600):
        h, w = rng.randint(2, 5), rng.randint(2, 5)
        kinds = [rng.choice(POOL) for _ in range(w)]
        grids.append(table(*[[rng.choice(POOL) if rng.random() < .12 else
                              ("h" if r == 0 or c == 0 and rng.random() < .9 else kinds[c])
                              for c in range(w)] for r in range(h)]))
    return grids


def leaf(rows):
    """A table's rows as the leaf takes them."""
    return [[{"k": c.no, "detail": c.detail, "type": c.type, "h": c.rowspan, "w": c.colspan,
              "pos": c.shown_col, "y": c.shown_row} for c in row] for row in rows]


def test_both_checks_agree_on_span_free_grids(as_pages, random_grids):
    """The closed expressions and the leaf over lines give the same verdict, message and roles."""
    typed = tables.type_tables(tables.extract_tables(as_pages(random_grids)))
    judged = verdict.judge_tables(typed).collect()
    assert len(judged) == len(random_grids) and {r.verdict for r in judged} >= {
        "genuine", "TitleTypeError", "DataTypeError"}
    for r in judged:
        assert r.plain
        told = lines.judge(leaf(r.rows))
        assert told["kind"] == r.verdict
        if r.verdict == "genuine":
            mine = {(p.k, p.role, p.p_row, p.p_col) for p in r.placed}
            assert mine == {(p["k"], p["role"], p["p_row"], p["p_col"]) for p in told["cells"]}
            assert {p.p_row for p in r.placed} == set(
                range(len(r.rows) if r.orientation == "top" else len(r.rows[0])))
        else:
            flat = [c for row in r.rows for c in row]
            for a in told["args"]:
                shown = {"text": flat[a["k"]].text, "type": flat[a["k"]].type,
                         "detail": flat[a["k"]].detail}[a["what"]]
                assert shown in r.message


def tiled(rng, h, w):
    """A grid of h by w slots cut into cells at random: rows of (rowspan, colspan)."""
    owner, rows = {}, [[] for _ in range(h)]
    for r in range(h):
        for c in range(w):
            if (r, c) not in owner:
                rs, cs = rng.choice([1, 1, 2, h - r]), rng.choice([1, 1, 2, w - c])
                rs, cs = min(rs, h - r), min(cs, w - c)
                while any((r, c + d) in owner for d in range(cs)):
                    cs -= 1
                owner.update({(r + i, c + j): True for i in range(rs) for j in range(cs)})
                rows[r].append((c, rs, cs))
    return rows


def test_turning_twice_gives_the_grid_back(as_pages):
    rng = random.Random(5)
    grids = [g for g in (tiled(rng, rng.randint(2, 6), rng.randint(2, 6)) for _ in range(300))
             if all(g) and len({c for row in g for c, _, _ in row}) == 1 + max(
                 c + cs - 1 for row in g for c, _, cs in row)]
    pages = as_pages([table(*[[f"<td rowspan={rs} colspan={cs}>x</td>" for _, rs, cs in row] for row in g])
                      for g in grids])
    for r in tables.type_tables(tables.extract_tables(pages)).collect():
        grid_ = [[lines.Cell(c["k"], c["detail"], c["type"], c["h"], c["w"], i, c["pos"], c["y"]) for c in row]
                 for i, row in enumerate(leaf(r.rows))]
        back = lines.turned(lines.turned(grid_))
        assert [[(c.k, c.h, c.w) for c in row] for row in back] == [[(c.k, c.h, c.w) for c in row] for row in grid_]


def test_shown_is_the_first_slot_left_to_a_cell():
    rng = random.Random(8)
    for _ in range(300):
        rows = [[(rng.choice([0, 1, 1, 2, 3, 9]), rng.choice([0, 1, 1, 2, 3, 9])) for _ in range(rng.randint(1, 4))]
                for _ in range(rng.randint(1, 4))]
        limit, taken, n = sum(w for _, w in rows[0]), {}, 0
        for r, row in enumerate(rows):
            col = 0
            for h, w in row:
                while col < limit and (r, col) in taken:
                    col += 1
                for rr in range(r, min(r + h, len(rows))):
                    for c in range(col, min(col + w, limit)):
                        taken[rr, c] = n
                col, n = col + w, n + 1
        first = {}
        for c, r in sorted((c, r) for r, c in taken):
            first.setdefault(taken[r, c], (r, c))
        got = [place for row in spans.shown(rows) for place in row]
        assert got == [first.get(i, (None, None)) for i in range(n)], rows


def test_a_span_of_any_width_costs_nothing(as_pages):
    wide = table(HEAD, ["a", "<td colspan=300000000>1</td>"], ["b", "2"])
    far = table(HEAD, ["a", f"<td colspan={1 << 60}>1</td>"], ["b", "2"])
    cells = tables.extract_cells(tables.extract_tables(as_pages([wide, far, table(HEAD, ["a", "1"])])))
    covered = grid.cover(cells)
    asked = cells.select("page_id", "table_idx", F.lit(1).alias("row"), F.lit(299_999_999).cast("bigint").alias("col"))
    assert {(r.page_id, r.text) for r in grid.cell_at(covered, asked.distinct()).collect()} == {(0, "1"), (2, None)}
    assert covered.where("page_id = 0").count() == 6
    told = {r.page_id: r for r in verdict.verdicts(verdict.judge(as_pages([wide, far]))).collect()}
    assert "colspan=300000000" in told[0].message and told[1].status == "bad_span"


def test_every_genuine_cell_has_a_role(as_pages, random_grids):
    found = verdict.roles(verdict.judge(as_pages(random_grids)))
    assert verdict.unclassified(found).count() == 0
    assert found.where(F.size("covers") == 0).count() == 0


def test_a_batch_of_tables_is_read_from_its_columns(spark, as_pages):
    """Nulls, parts of arrays and cells that show nowhere give what rows of dicts give."""
    import pyarrow as pa

    from tablemill.operators.verdict import _ARROW_JUDGED
    html = ["<table><tr><th colspan=2>a</th><th>b</th></tr><tr><td>x</td><td>y</td><td>5</td></tr><tr><td>z</td><td>w</td><td>6</td></tr></table>",
            "<table><tr><td>a</td><td>b</td></tr><tr><td rowspan=4>c</td></tr><tr><td>d</td><td>1</td><td>2</td></tr></table>",
            "<table><tr><th>a</th><th>b</th></tr><tr><td rowspan=2>c</td><td>$1</td></tr><tr><td>7</td></tr></table>"]
    found = tables.type_tables(tables.extract_tables(as_pages(html))).orderBy("page_id").collect()
    rows = [leaf(r.rows) for r in found]
    rows[0][0][0]["pos"] = None
    cell = pa.struct([("k", pa.int32()), ("detail", pa.string()), ("type", pa.string()), ("h", pa.int64()), ("w", pa.int64()),
                      ("pos", pa.int64()), ("y", pa.int32())])
    batch = pa.array([rows[1], None, rows[0], rows[2], None, rows[1]], pa.list_(pa.list_(cell)))
    said = [pa.array([lines.judge(r) if r else None for r in part.to_pylist()], _ARROW_JUDGED) for part in (batch, batch[2:5], batch[:0])]
    assert [lines.judge_all(part, _ARROW_JUDGED).to_pylist() for part in (batch, batch[2:5], batch[:0])] == [s.to_pylist() for s in said]
    assert {r["kind"] for r in said[0].to_pylist() if r} != {None}
