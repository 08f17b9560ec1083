"""Tables of a batch of pages, read in columns.

Pages of well-formed, properly nested markup, the common case, are read all at once: their tags are two
sorted arrays of places, nesting is a running sum, and a tag is parsed once for each way it is written.
All other pages go one by one to ``markup``, whose results on these are the same.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ..functions.spans import place, shown
from .markup import SILENT, VOID, _attributes, _span, _tag, page_tables

ARROW_CELL = pa.struct([
    ("node", pa.int32()), ("tag", pa.string()), ("text", pa.string()),
    ("tags", pa.list_(pa.string())), ("rowspan", pa.int64()), ("colspan", pa.int64()),
    ("row", pa.int32()), ("col", pa.int64()), ("home_row", pa.int32()), ("home_col", pa.int64()),
    ("no", pa.int32()), ("shown_row", pa.int32()), ("shown_col", pa.int64()),
    ("gt_id", pa.string()), ("style", pa.string()), ("at", pa.int32()), ("at_len", pa.int32())])
ARROW_TABLE = pa.struct([
    ("table_idx", pa.int32()), ("status", pa.string()), ("problem", pa.string()),
    ("at", pa.int32()), ("at_len", pa.int32()), ("style", pa.string()),
    ("overlaps", pa.bool_()), ("rows", pa.list_(pa.list_(ARROW_CELL)))])
ARROW_TABLES = pa.list_(ARROW_TABLE)

PARTS = ("thead", "tbody", "tfoot")          # may stand between a table and its rows


def _between(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The texts from each of the rising ``bounds`` to the next."""
    return pa.StringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(data))


def _counts(at: np.ndarray, n: int) -> np.ndarray:
    """Where each of n groups begins among members that know their group, in order."""
    return np.concatenate([[0], np.cumsum(np.bincount(at, minlength=n))])


class _Tags:
    """The tags of pages that are still held to be well-formed, in order: where they begin and end, how each is written
    and its page."""

    def __init__(self, begin, end, page, ok):
        self.begin, self.end, self.page, self.ok = begin, end, page, ok
        self.written = None

    def drop(self, bad: np.ndarray) -> None:
        """Leave out the pages of the tags marked ``bad``."""
        if bad.any():
            self.ok[self.page[bad]] = False
            held = self.ok[self.page]
            self.begin, self.end, self.page = self.begin[held], self.end[held], self.page[held]
            self.written = None if self.written is None else self.written[held]


class _Written:
    """What each of the distinct tags says."""

    def __init__(self, tags: list[str]):
        n = len(tags)
        self.name, self.names = np.zeros(n, np.int64), {}
        self.bad, self.ends, self.closed, self.void = (np.zeros(n, bool) for _ in range(4))
        self.spans = np.ones((2, n), np.int64)
        self.gt_id, self.style = [None] * n, [None] * n
        for i, tag in enumerate(tags):
            found = _tag(tag[1:-1])
            if found is None or found[0] in SILENT:
                self.bad[i] = True
                continue
            name, given, self.closed[i], self.ends[i] = found
            self.name[i] = self.names.setdefault(name, len(self.names))
            self.void[i] = name in VOID
            if given and name in ("td", "th", "table"):
                attrs = _attributes(given)
                self.gt_id[i], self.style[i] = attrs.get("data-gt-id"), attrs.get("style")
                try:
                    if name != "table":
                        self.spans[:, i] = [_span(attrs[k]) if k in attrs else 1 for k in ("rowspan", "colspan")]
                except ValueError:
                    self.bad[i] = True
        self.listed = list(self.names)

    def is_one_of(self, *names: str) -> np.ndarray:
        return np.isin(self.name, [self.names[n] for n in names if n in self.names])


def _well_nested(tags: _Tags, says: _Written) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each tag the last one in its element, and the tag of its parent (-1: none); whether it begins an element.

    Pages whose tags do not pair up are left out.
    """
    def steps():
        w = tags.written
        single = ~says.ends[w] & (says.closed[w] | says.void[w])
        return single, np.where(single, 0, np.where(says.ends[w], -1, 1))

    step = steps()[1]
    depth, first = np.cumsum(step), np.searchsorted(tags.page, tags.page)
    depth = depth - (depth - step)[first]
    last = np.searchsorted(tags.page, tags.page, side="right") - 1
    tags.drop((depth < 0) | (depth[last] != 0) if len(depth) else np.zeros(0, bool))
    while True:
        single, step = steps()
        n = len(step)
        depth = np.cumsum(step)                          # 0 at the end of each page that is left
        level = depth - (step > 0)
        group = tags.page * (int(depth.max(initial=0)) + 1) + level
        paired = np.flatnonzero(step)
        paired = paired[np.argsort(group[paired], kind="stable")]
        begin, end = paired[::2], paired[1::2]           # on a level of a page they alternate
        unlike = says.name[tags.written[begin]] != says.name[tags.written[end]]
        if not unlike.any():
            break
        bad = np.zeros(n, bool)
        bad[begin[unlike]] = True
        tags.drop(bad)
    stop = np.arange(n)
    stop[begin] = end
    # the parent is the last beginning before a tag on the level below its own
    key = group[begin] * (n + 1) + begin
    before = np.searchsorted(key, (group - 1) * (n + 1) + np.arange(n)) - 1
    parent = np.where(level > 0, begin[before], -1) if len(begin) else np.full(n, -1)
    return stop, parent, step >= 0


def _stripped(texts: pa.Array, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.Array:
    """``texts``, which stand from ``begin`` to ``end``, without white space around them; most have none."""
    if not len(texts):
        return texts
    ends = np.stack([data[np.minimum(begin, len(data) - 1)], data[end - 1]])
    odd = (end > begin) & ((ends <= 32) | (ends >= 127)).any(axis=0)
    if not odd.any():
        return texts
    return pc.replace_with_mask(texts, pa.array(odd), pa.array([t.strip() for t in texts.filter(pa.array(odd)).to_pylist()], pa.string()))


def _grids(html: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Tables of each page, and which pages could be read so."""
    n = len(html)
    html = pc.fill_null(html, "")
    bounds = np.frombuffer(html.buffers()[1], np.int32)[html.offset:html.offset + n + 1].astype(np.int64)
    data = np.frombuffer(html.buffers()[2] or b"", np.uint8)[bounds[0]:bounds[-1]]
    bounds -= bounds[0]

    begin, end, amp = (np.flatnonzero(data == ord(sign)) for sign in "<>&")
    pages = [np.searchsorted(bounds, at, side="right") - 1 for at in (begin, end, amp)]
    ok = np.bincount(pages[0], minlength=n) == np.bincount(pages[1], minlength=n)
    ok[pages[2]] = False
    begin, end = begin[ok[pages[0]]], end[ok[pages[1]]]
    tags = _Tags(begin, end, pages[0][ok[pages[0]]], ok)
    wrong = begin > end
    wrong[:-1] |= end[:-1] > begin[1:]
    wrong[1:] |= end[:-1] > begin[1:]
    tags.drop(wrong)

    written = _between(data, np.append(np.stack([tags.begin, tags.end + 1], axis=1).ravel(), len(data)))
    written = written.take(pa.array(np.arange(0, 2 * len(tags.begin), 2))).dictionary_encode()
    says = _Written(written.dictionary.to_pylist())
    tags.written = written.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    w = tags.written
    # an end of a void tag, or void tags written both ways, are for the reader of single tags
    slashed, bare = (np.bincount(tags.page[says.void[w] & ~says.ends[w] & (says.closed[w] == c)], minlength=n) > 0 for c in (True, False))
    tags.drop(says.bad[w] | (says.void & says.ends)[w] | (slashed & bare)[tags.page])
    stop, parent, starts = _well_nested(tags, says)

    # a cell stands in a row, a row in a table or in a part of one, no table in another, and none is empty
    is_table, is_row, is_cell, is_part = (says.is_one_of(*names) for names in (("table",), ("tr",), ("td", "th"), PARTS))

    def kind(which: np.ndarray) -> np.ndarray:
        return which[tags.written] & starts

    def above(nodes: np.ndarray, which: np.ndarray) -> np.ndarray:
        return (parent[nodes] >= 0) & which[tags.written[parent[nodes]]]
    cell, row, table = (np.flatnonzero(kind(which)) for which in (is_cell, is_row, is_table))
    holder = np.where(above(row, is_part), parent[parent[row]], parent[row])
    bad = np.zeros(len(starts), bool)
    bad[cell[~above(cell, is_row)]] = True
    bad[row[(holder < 0) | ~is_table[tags.written[holder]]]] = True
    bad[table[1:][table[1:] < stop[table[:-1]]]] = True
    of_row = np.full(len(starts), -1)
    of_row[row] = holder
    table_of_cell = np.where(parent[cell] >= 0, of_row[parent[cell]], -1)
    bad[np.setdiff1d(table, table_of_cell)] = True
    tags_page, tags_written, tags_begin, tags_end = tags.page, tags.written, tags.begin, tags.end
    ok[tags_page[bad]] = False

    def left(nodes: np.ndarray) -> np.ndarray:
        return nodes[ok[tags_page[nodes]]]
    cell, table = left(cell), left(table)
    row, line = np.unique(parent[cell], return_inverse=True)           # those with cells
    row_table = np.searchsorted(table, of_row[row])
    row_first, table_first = _counts(line, len(row)), _counts(row_table, len(table))
    grid = row_table[line]                                             # of each cell
    cell_page = tags_page[cell]
    cells_before = _counts(cell_page, n)

    # places, as written if nothing spans
    use = tags_written[cell]
    rowspan, colspan = says.spans[0][use], says.spans[1][use]
    at_row = line - table_first[grid]
    at_col = np.arange(len(cell)) - row_first[line]
    no = np.arange(len(cell)) - row_first[table_first[grid]]
    show_row, show_col, hidden = at_row.copy(), at_col.copy(), np.zeros(len(cell), bool)
    overlaps = np.zeros(len(table), bool)
    for t in np.unique(grid[(rowspan != 1) | (colspan != 1)]).tolist():
        edges = row_first[table_first[t]:table_first[t + 1] + 1]
        here = slice(edges[0], edges[-1])
        both = list(zip(rowspan[here].tolist(), colspan[here].tolist()))
        cuts = (edges - edges[0]).tolist()
        spans = [both[a:b] for a, b in zip(cuts, cuts[1:])]
        columns, overlaps[t] = place(spans)
        at_col[here] = show_col[here] = [c for columns_ in columns for c in columns_]
        if overlaps[t] or min(map(min, both)) < 1:
            places = [p for line_ in shown(spans) for p in line_]
            hidden[here] = [p[0] is None for p in places]
            show_row[here], show_col[here] = ([p[k] or 0 for p in places] for k in (0, 1))

    # what stands in a cell: most often one text
    after = np.append(tags_begin[1:], len(data))
    plain = (stop[cell] <= cell + 1)
    stretch = _between(data, np.append(np.stack([tags_begin, tags_end + 1], axis=1).ravel(), len(data)))
    text = _stripped(stretch.take(pa.array(2 * cell + 1)), data, tags_end[cell] + 1, after[cell])
    sets: dict[tuple, int] = {("td",): 0, ("th",): 1}
    tagset = np.where(says.is_one_of("th")[use], 1, 0)
    single = stop[cell] == cell
    if single.any():
        text = pc.replace_with_mask(text, pa.array(single), pa.scalar("", pa.string()))
    rich = np.flatnonzero(~plain)
    if len(rich):
        texts = []
        for k, a, b in zip(rich.tolist(), cell[rich].tolist(), stop[cell[rich]].tolist()):
            inside = stretch.slice(2 * a, 2 * (b - a)).to_pylist()[1::2]
            texts.append(" ".join(filter(None, map(str.strip, inside))))
            names = tuple(sorted({says.listed[i] for i in says.name[tags_written[a:b + 1]].tolist()}))
            tagset[k] = sets.setdefault(names, len(sets))
        text = pc.replace_with_mask(text, pa.array(~plain), pa.array(texts, pa.string()))

    def told(values: list, nodes: np.ndarray) -> pa.Array:
        return pa.array(values, pa.string()).take(pa.array(tags_written[nodes]))

    def numbers(values: np.ndarray, kind: pa.DataType, mask: np.ndarray | None = None) -> pa.Array:
        return pa.array(values, mask=mask).cast(kind)
    fields = {
        "node": np.arange(len(cell)) - cells_before[cell_page], "tag": told([says.listed[i] for i in says.name.tolist()] if says.listed else [], cell),
        "text": text, "tags": pa.array(list(map(list, sets)), pa.list_(pa.string())).take(pa.array(tagset)),
        "rowspan": rowspan, "colspan": colspan, "row": at_row, "col": at_col, "home_row": at_row, "home_col": at_col, "no": no,
        "shown_row": numbers(show_row, pa.int32(), hidden), "shown_col": numbers(show_col, pa.int64(), hidden),
        "gt_id": told(says.gt_id, cell), "style": told(says.style, cell),
        "at": tags_begin[cell] - bounds[cell_page], "at_len": tags_end[cell] - tags_begin[cell] + 1}
    cells = pa.StructArray.from_arrays(
        [fields[f.name] if isinstance(fields[f.name], pa.Array) else numbers(fields[f.name], f.type) for f in ARROW_CELL], fields=list(ARROW_CELL))

    def grouped(firsts: np.ndarray, values: pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(firsts.astype(np.int32)), values)
    rows = grouped(table_first, grouped(row_first, cells))
    table_page = tags_page[table]
    tables_before = _counts(table_page, n)
    facts = {
        "table_idx": numbers(np.arange(len(table)) - tables_before[table_page], pa.int32()),
        "status": pa.array(["ok"], pa.string()).take(pa.array(np.zeros(len(table), np.int64))),
        "problem": pa.nulls(len(table), pa.string()), "at": numbers(tags_begin[table] - bounds[table_page], pa.int32()),
        "at_len": numbers(tags_end[table] - tags_begin[table] + 1, pa.int32()), "style": told(says.style, table),
        "overlaps": pa.array(overlaps), "rows": rows}
    tables = pa.StructArray.from_arrays([facts[f.name].cast(f.type) for f in ARROW_TABLE], fields=list(ARROW_TABLE))
    return grouped(tables_before, tables).cast(ARROW_TABLES), ok


def batch_tables(html: pa.Array) -> pa.Array:
    """``page_tables`` of each page; none of a null."""
    if not len(html):
        return pa.array([], ARROW_TABLES)
    html = html.cast(pa.string())
    found, ok = _grids(html)
    if ok.all():
        return found
    others = np.flatnonzero(~ok)
    single = pa.array([page_tables(h) if h else [] for h in html.take(pa.array(others)).to_pylist()], ARROW_TABLES)
    order = np.arange(len(html))
    order[others] = len(html) + np.arange(len(others))
    return pa.concat_arrays([found, single]).take(pa.array(order))
