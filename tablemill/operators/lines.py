"""The structure check of one table with spans or ragged rows, over its cells' types and spans.

Every line lays its cells, by width, into the columns that are free there: those
whose cell above has no height left. The columns are all that is carried from
line to line, and nothing is changed in place. One function lays a line; the
header, the data and, on the turned table, the row attributes differ in what they
object to and in what a cell leaves behind. Spark spreads the tables, decides the
span-free ones by itself (``verdict.plain_check``), and writes the messages.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from operator import itemgetter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ..fixed import HEADER_TYPES, TOP_HEADER_TYPES


class Cell(NamedTuple):
    k: int                   # number in the table
    detail: str
    type: str
    h: int
    w: int
    at: int                  # line, and place in it; None if it shows nowhere
    pos: int | None
    y: int | None            # place once turned
    was: tuple = ()          # line and place before turning


_PLACE_ONCE_TURNED = itemgetter(Cell._fields.index("y"), Cell._fields.index("k"))


class Column(NamedTuple):
    cell: Cell               # the last cell that counts for its type
    w: int
    left: int                # lines below this one that it still covers
    merged: bool = False


class Laid(NamedTuple):
    columns: list            # what stands below each free column
    used: int                # cells laid
    open: int                # free columns filled
    filled: int              # width filled of the next one
    begun: bool              # whether any cell was laid into it
    met: object              # the objection, or the mark, that ended the line


class Objection(NamedTuple):
    kind: str
    code: str
    args: tuple = ()
    block: str | None = None


CLOSES, TOTAL = "closes", "total"


def layout(code: str, *args, block=None) -> Objection:
    return Objection("LayoutError", code, args, block)


def text(cell: Cell) -> tuple:
    return cell.k, "text"


def num(n: int) -> tuple:
    return n, "num"


def wrong_type(cell: Cell, block: str) -> Objection:
    return Objection("TitleTypeError", "bad_type", (text(cell), (cell.k, "type")), block)


def unlike(above: Cell, cell: Cell) -> Objection | None:
    pair = {above.detail, cell.detail}
    if len(pair) == 1 or "NO_DATA" in pair or pair == {"LINK", "STRING"}:
        return None
    return Objection("DataTypeError", "column_type",
                     (text(above), (above.k, "detail"), text(cell), (cell.k, "detail")))


def width(items: Iterable) -> int:
    return sum([x.w for x in items])


def below(cell: Cell) -> Column:
    return Column(cell, cell.w, cell.h)


def lowered(columns: list) -> list | Objection:
    """The columns one line further down."""
    out = [Column(cell, w, left - 1, merged) for cell, w, left, merged in columns]
    return Objection("ValueError", "bad_row_span") if any([c.left < 0 for c in out]) else out


def lay(cells: list, free: list, judge: Callable, keep: Callable) -> Laid:
    """Lay cells into free columns from the left. ``judge(cell, column, filled)`` ends the line with
    what it returns, if anything; ``keep(cell, column)`` is the column a cell leaves behind."""
    under: list[list] = [[] for _ in free]
    no, filled = 0, 0
    for used, cell in enumerate(cells):
        if no == len(free):
            return Laid(under, used, no, 0, False, None)
        met = judge(cell, free[no], filled)
        if met:
            return Laid(under, used, no, filled, bool(under[no]), met)
        under[no].append(keep(cell, free[no]))
        filled += cell.w
        if filled == free[no].w:
            no, filled = no + 1, 0
    return Laid(under, len(cells), no, filled, no < len(free) and bool(under[no]), None)


def next_columns(columns: list, laid: Laid) -> list:
    """Columns with height left stay in place; the free ones give way to what was laid into them."""
    new = iter(laid.columns)
    return [c for column in columns for c in ([column] if column.left > 0 else next(new))]


# ------------------------------------------------------------------ header and row attributes
def closing_header(i: int, size: int, rest: list, cells: list, used: int) -> Objection | None:
    """The line that closes the header meets every further column with one cell of its width."""
    for column, cell in zip(rest, [*cells, *[None] * len(rest)]):
        if column.left > 0:
            return layout("jagged_head", text(column.cell), num(i), num(column.left))
        if cell is None:
            return layout("close_short", num(i), text(column.cell))
        if cell.w != column.w:
            return layout("close_width", text(cell), num(cell.w), text(column.cell), num(column.w))
    if len(cells) > len(rest):
        return layout("close_left", num(i), num(used + 1 + len(rest)), num(size))
    return None


def closing_sidebar(i: int, size: int, rest: list, cells: list, used: int) -> Objection | None:
    """On the turned table a column may reach one line further, and below the only level data may
    share a column. Whichever objection stands further left is made."""
    free = [c for c in rest if c.left < 1]

    def judge(cell, column, filled):
        if filled + cell.w > column.w or (filled + cell.w < column.w and i > 1):
            return layout("side_width", text(cell), num(cell.w), text(column.cell), num(column.w))
        return None
    laid = lay(cells, free, judge, lambda cell, column: below(cell))
    stuck = free[laid.open] if laid.open < len(free) else None
    for column in rest:
        if column is stuck:
            return laid.met or layout("close_short", num(i), text(stuck.cell))
        if column.left > 1:
            return layout("jagged_side", text(column.cell), num(i), num(column.left))
    return None


class Block(NamedTuple):
    close: int               # the line that closes the block
    sections: frozenset      # lines that are one label as wide as the table


def read_block(lines: list, block: str, settled: Callable = lambda cell: False) -> Block | Objection:
    """Header lines, or on the turned table lines of row attributes, down to the first data line."""
    header = block == "title"
    if len(lines) < 2:
        return layout("two_rows", block=block)
    top = [c for c in lines[0] if not settled(c)]
    for cell in top:
        if cell.type not in (TOP_HEADER_TYPES if header else HEADER_TYPES):
            return wrong_type(cell, block)
    if not top:
        return layout("no_role", block=block)

    def judge(cell, column, filled):
        if filled + cell.w > column.w:
            return layout("head_wide", text(cell), num(cell.w), text(column.cell), num(column.w))
        if not filled and cell.w == column.w:
            return CLOSES
        return None if cell.type in HEADER_TYPES else wrong_type(cell, block)

    columns, sections = [below(c) for c in top], set()
    for i, line in enumerate(lines[1:], 1):
        if len(line) == 1 and line[0].w == width(columns):
            sections.add(i)
            continue
        columns = lowered(columns)
        if isinstance(columns, Objection):
            return columns
        cells, free = [c for c in line if not settled(c)], [c for c in columns if c.left < 1]
        laid = lay(cells, free, judge, lambda cell, column: below(cell))
        if laid.met == CLOSES:
            if laid.used and (header or i > 1):
                return layout("jagged_block", text(cells[laid.used]), block=block)
            met = free[laid.open]
            rest = columns[next(n for n, c in enumerate(columns) if c is met) + 1:]
            close = closing_header if header else closing_sidebar
            return (close(i, len(line), rest, cells[laid.used + 1:], laid.used)
                    or Block(i, frozenset(sections)))
        if laid.met:
            return laid.met
        if laid.open < len(free):
            return layout("head_short", num(i), text(free[laid.open].cell))
        if header and laid.used < len(cells):
            return layout("head_left", num(i), num(laid.used), num(len(line)), num(len(columns)), num(len(columns)))
        columns = next_columns(columns, laid)
    return layout("head_only" if header else "side_only")


# ------------------------------------------------------------------ data
def no_total(i: int, line: list) -> Objection | None:
    """Why a line is no total: it has one label, nothing left of it and only values right."""
    labels = [n for n, c in enumerate(line) if c.detail == "STRING"]
    if len(labels) != 1:
        return Objection("DataTypeError", "total_label", ((i, "line"),))
    for n, cell in enumerate(line):
        allowed = n == labels[0] or cell.detail == "NO_DATA" or (n > labels[0] and cell.type == "GENUINE")
        if not allowed:
            code = "total_left" if n < labels[0] else "total_tail"
            return Objection("DataTypeError", code, (text(cell), (cell.k, "detail")))
    return None


def joined(columns: list, cell: Cell) -> list:
    """The columns, with those in front that one cell covers exactly made one; as they are if it covers
    no whole number of them, or all."""
    for n in range(1, len(columns)):
        if width(columns[:n]) == cell.w:
            return [columns[0]._replace(w=cell.w, merged=True), *columns[n:]]
    return columns


def read_data(lines: list, start: int) -> frozenset | Objection:
    """Lines below the one that closed the header, each of its columns' widths and kinds; those cut
    across by a total are returned."""
    columns, whole, totals = [below(c) for c in lines[start]], width(lines[start]), set()
    for i, line in enumerate(lines[start + 1:], start + 1):
        columns = lowered(columns)
        if isinstance(columns, Objection):
            return columns
        objection = no_total(i, line)
        laid_on = columns
        if objection and columns[0].left < 1 and line[0].w > columns[0].w:
            laid_on = joined(columns, line[0])

        def judge(cell, column, filled):
            if not filled and cell.w > column.w:
                return objection or TOTAL
            if filled + cell.w > column.w:
                return layout("split_wide", num(i), text(column.cell), num(column.w))
            if not unlike(column.cell, cell) and lends(cell, column) and column.left + cell.h < 0:
                return Objection("ValueError", "bad_row_span")
            return unlike(column.cell, cell)

        def lends(cell, column):                   # an empty cell: the column goes on from its last value
            return cell.detail == "NO_DATA" and cell.w == column.w and not column.merged

        def keep(cell, column):
            return Column(column.cell, column.w, column.left + cell.h, column.merged) if lends(cell, column) else below(cell)

        free = [c for c in laid_on if c.left < 1]
        laid = lay(line, free, judge, keep)
        if laid.met == TOTAL:
            if width(line) != whole:
                return layout("total_width", num(i), num(whole), num(width(line)))
            totals.add(i)
            columns = [Column(cell, w, 1, merged) for cell, w, _, merged in columns]
            continue
        if laid.met:
            return laid.met
        if laid.open < len(free):
            column = free[laid.open]
            if laid.begun:
                return layout("split_short", num(i), text(column.cell), num(column.w), num(laid.filled))
            return layout("data_short", num(i), text(column.cell))
        if laid.used < len(line):
            return layout("data_extra", num(i), num(laid.used), num(len(line)))
        columns = next_columns(laid_on, laid)
    for column in columns:
        if column.left != 1:
            return layout("overrun", text(column.cell), num(column.left))
    return frozenset(totals)


# ------------------------------------------------------------------ a table
def turned(lines: list) -> list:
    """The axes swapped: a line for each place at which some cell begins; cells that show nowhere, or
    past the first line's width, are left out."""
    limit, by_place = width(lines[0]), {}
    for cell in [c for line in lines for c in line if c.pos is not None and c.pos < limit]:
        by_place.setdefault(cell.pos, []).append(cell)
    return [[Cell(k, detail, type_, w, h, i, y, i, (at, pos)) for k, detail, type_, h, w, at, pos, y, _ in
             sorted(by_place[p], key=_PLACE_ONCE_TURNED)] for i, p in enumerate(sorted(by_place))]


def unfit(lines: list) -> Objection | None:
    """Spans that a second reading of the table cannot start from."""
    for cell in (c for line in lines for c in line):
        if cell.w < 1 or cell.h < 0:
            return Objection("ValueError", "bad_col_span" if cell.w < 1 else "bad_row_span")
    return None


def read_table(lines: list) -> list | Objection:
    """Header on top, then data, then row attributes: (cell, role, line, place) of every cell."""
    head = read_block(lines, "title")
    if isinstance(head, Objection):
        return head
    totals = read_data(lines, head.close)
    if isinstance(totals, Objection):
        return totals

    def role(at):
        return "title" if at < head.close else "result" if at in totals else "data"

    if len(lines) < 3:
        return [(c, role(c.at), c.at, c.pos) for line in lines for c in line]
    if unfit(lines):
        return unfit(lines)
    columns = turned(lines)
    side = read_block(columns, "sidebar", lambda c: role(c.was[0]) != "data")
    if isinstance(side, Objection):
        return side
    return [(c, "title" if i in side.sections else "sidebar" if i < side.close and role(c.was[0]) == "data"
             else role(c.was[0]), *c.was) for i, column in enumerate(columns) for c in column]


def _listed(values: pa.Array) -> list:
    """The values as Python's; texts are made once for each distinct one."""
    if pa.types.is_string(values.type):
        coded = values.dictionary_encode()
        names = [*coded.dictionary.to_pylist(), None]
        return [names[i] for i in coded.indices.fill_null(len(names) - 1).to_numpy().tolist()]
    out = values.fill_null(0).to_numpy().tolist()
    for i in np.flatnonzero(values.is_null().to_numpy(zero_copy_only=False)).tolist():
        out[i] = None
    return out


def _ends(lists: pa.Array) -> np.ndarray:
    """Where each list ends in the flattened values."""
    return np.cumsum(pc.list_value_length(lists).fill_null(0).to_numpy(), dtype=np.int64)


def tables(rows: pa.Array) -> Iterator[list]:
    """The lines of each table of a batch, read from its columns: none of a null."""
    lines = rows.flatten()
    table_ends, line_ends = _ends(rows), _ends(lines)
    cells = lines.flatten()
    sizes, first = np.diff(line_ends, prepend=0), np.concatenate([[0], table_ends])
    at = np.arange(len(lines)) - np.repeat(first[:-1], np.diff(first))
    fields = [_listed(pc.struct_field(cells, name)) for name in ("k", "detail", "type", "h", "w", "pos", "y")]
    fields.insert(Cell._fields.index("at"), np.repeat(at, sizes).tolist())
    made = list(map(Cell, *fields))
    cuts = [0, *line_ends.tolist()]
    held = [made[a:b] for a, b in zip(cuts, cuts[1:])]
    for a, b in zip(first.tolist(), table_ends.tolist()):
        yield held[a:b]


def judge_all(rows: pa.Array, kind: pa.DataType) -> pa.Array:
    """``judge`` of each table of a batch, null of a null."""
    known = rows.is_valid().to_numpy(zero_copy_only=False).tolist()
    return pa.array([judge_lines(lines) if held else None for held, lines in zip(known, tables(rows))], kind)


def judge(rows: list) -> dict:
    """``judge_lines`` of rows of cells as dicts."""
    return judge_lines([[Cell(c["k"], c["detail"], c["type"], c["h"], c["w"], i, c["pos"], c["y"]) for c in row]
                        for i, row in enumerate(rows)])


def judge_lines(lines: list) -> dict:
    """Read with the header on top, else with the table turned; of two objections the first one counts."""
    found, attempt = read_table(lines), "top"
    if isinstance(found, Objection) and found.kind != "ValueError":
        left, attempt = read_table(turned(lines)), "left"
        if not isinstance(left, Objection) or left.kind == "ValueError":
            found = left
    if isinstance(found, Objection):
        return {**found._asdict(), "args": [{"k": k, "what": what} for k, what in found.args],
                "attempt": None, "cells": []}
    across = attempt == "left"
    shape = {c.k: (c.h, c.w) for line in lines for c in line}
    return {"kind": "genuine", "code": None, "args": [], "block": None, "attempt": attempt, "cells": [
        {"k": c.k, "role": role, "p_row": at, "p_col": pos, "p_rowspan": shape[c.k][across],
         "p_colspan": shape[c.k][not across]} for c, role, at, pos in found]}
