"""Tag soup of one page -> its tables. The only code that reads markup.

A tolerant reader that never repairs: an end tag closes everything up to the
nearest open tag of that name, void tags close at once, nothing else is closed
by implication. What it returns is flat and small; everything about types,
structure and links is decided in Spark.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from functools import lru_cache
from html import unescape
from html.entities import html5
from html.parser import HTMLParser
from typing import NamedTuple

from ..functions.spans import SPAN_BITS, place, shown

# ---------------------------------------------------------------- fixed values: tags
VOID = frozenset([
    "area", "base", "br", "col", "embed", "hr", "img", "input", "keygen", "link", "menuitem", "meta", "param",
    "source", "track", "wbr", "basefont", "bgsound", "command", "frame", "image", "isindex", "nextid", "spacer"])
SILENT = frozenset(["script", "style", "template", "rt", "rp"])   # their text is no cell text
RAW = ("script", "style")                                         # no tags inside

# Well-formed markup, one token at a time. A page with anything else is left to
# the standard library's reader, whose results on these tokens are the same.
TOKEN = re.compile(
    r"""(?P<text>[^<&]+)
      | <(?P<start>[a-zA-Z][a-zA-Z0-9]*)(?P<attrs>(?:\s+[a-zA-Z][a-zA-Z0-9:_-]*
            (?:=(?:"[^"]*"|'[^']*'|[^\s"'<>=`/&]+))?)*)\s*(?P<empty>/?)>
      | </(?P<end>[a-zA-Z][a-zA-Z0-9]*)\s*>
      | &(?P<entity>[a-zA-Z][a-zA-Z0-9]*);
      | &\#(?P<char>[0-9]+|[xX][0-9a-fA-F]+);
      | (?P<lone>&(?=[^a-zA-Z#])|<(?=[^a-zA-Z/!?]))
      | (?P<aside><!--(?!-?>)(?:[^-]|-(?!-))*-->|<!(?i:doctype)[^>\[]*>)""", re.X)
ATTR = re.compile(r"""\s+([a-zA-Z][a-zA-Z0-9:_-]*)(?:=(?:"([^"]*)"|'([^']*)'|([^\s"'<>=`/&]+)))?""")


class _Tree:
    """Nodes as parallel lists; a negative child is a piece of text."""

    def __init__(self):
        self.name, self.up, self.kids, self.attrs, self.where = [""], [-1], [[]], [None], [None]
        self.texts = [""]
        self.open, self.count, self.silent, self.buffer = [0], {}, 0, []
        self.spent_void, self.tr_in_tr = {}, False

    def flush(self, _data=None):
        if self.buffer:
            text = "".join(self.buffer).strip()
            self.buffer.clear()
            if text and not self.silent:
                self.kids[self.open[-1]].append(-len(self.texts))
                self.texts.append(text)

    def shut(self, name):
        self.flush()
        if self.count.get(name):
            while True:
                gone = self.name[self.open.pop()]
                self.count[gone] -= 1
                self.silent -= gone in SILENT
                if gone == name:
                    break

    def start(self, tag, attrs, at, length, closed):
        self.flush()
        parent, node = self.open[-1], len(self.name)
        self.name.append(tag)
        self.up.append(parent)
        self.kids.append([])
        self.kids[parent].append(node)
        keep = tag == "td" or tag == "th" or tag == "table"
        self.attrs.append(attrs() if keep else None)
        self.where.append((at, length) if keep else None)
        self.open.append(node)
        self.count[tag] = self.count.get(tag, 0) + 1
        self.silent += tag in SILENT
        if tag == "tr" and self.name[parent] == "tr":
            self.tr_in_tr = True
        if closed:
            self.end(tag)
        elif tag in VOID:
            self.shut(tag)
            self.spent_void[tag] = self.spent_void.get(tag, 0) + 1

    def end(self, tag):
        if self.spent_void.get(tag):
            self.spent_void[tag] -= 1
        else:
            self.shut(tag)

    def entity(self, name):
        self.buffer.append(html5.get(name + ";", "&" + name))

    def char(self, name):
        code = int(name[1:], 16) if name[0] in "xX" else int(name)
        if 128 <= code < 160:
            text = bytes([code]).decode("windows-1252", "ignore") or chr(code)
        elif code > 0x10FFFF or 0xD800 <= code < 0xE000:
            text = "\N{REPLACEMENT CHARACTER}"
        else:
            text = chr(code)
        self.buffer.append(text)

    def read_plain(self, html):
        """Read a page made of well-formed tokens; False if it holds anything else."""
        at, match, stop = 0, TOKEN.match, len(html)
        while at < stop:
            token = match(html, at)
            if token is None:
                return False
            kind, begin, at = token.lastgroup, at, token.end()
            if kind == "text" or kind == "lone":
                self.buffer.append(token[0])
            elif kind == "end":
                self.end(token["end"].lower())
            elif kind == "empty":
                tag, written = token["start"].lower(), token["attrs"]
                closed = bool(token["empty"])
                if tag in RAW and not closed:
                    close = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
                    if close is None or html.find("</", at) != close.start():
                        return False
                    self.start(tag, dict, begin, at - begin, False)
                    self.shut(tag)
                    at = close.end()
                else:
                    self.start(tag, lambda: _attributes(written), begin, at - begin, closed)
            elif kind == "entity":
                self.entity(token["entity"])
            elif kind == "char":
                self.char(token["char"])
            else:
                self.flush()
        self.flush()
        return True

    def lift_rows(self):
        """A row directly inside a row moves to just behind it, last one first."""
        for node, name in enumerate(self.name):
            if name != "tr":
                continue
            inner = [k for k in self.kids[node] if k > 0 and self.name[k] == "tr"]
            if not inner:
                continue
            self.kids[node] = [k for k in self.kids[node] if k < 0 or self.name[k] != "tr"]
            siblings = self.kids[self.up[node]]
            at = len(siblings)
            while siblings[at - 1] != node:
                at -= 1
            siblings[at:at] = inner[::-1]
            for k in inner:
                self.up[k] = self.up[node]

    def walk(self):
        """Document order. -> node ids, first and last slot and text slots of each node, texts"""
        order, texts, slot = [], [], [None] * len(self.name)
        stack = [(0, None)]
        while stack:
            node, began = stack.pop()
            if began is not None:
                slot[node] = (began[0], len(order), began[1], len(texts))
            elif node < 0:
                texts.append(self.texts[-node])
            else:
                stack.append((node, (len(order), len(texts))))
                order.append(node)
                stack.extend((k, None) for k in reversed(self.kids[node]))
        return order, slot, texts


class _Flat(NamedTuple):
    """A page in document order: for each node its name, the node behind its last one, its stretch of the texts, its
    attributes and where its start tag stands."""
    name: list
    stop: list
    text_from: list
    text_to: list
    attrs: list
    where: list
    texts: list


WHOLE_START = re.compile(r"""([a-zA-Z][a-zA-Z0-9]*)((?:\s+[a-zA-Z][a-zA-Z0-9:_-]*
    (?:=(?:"[^"]*"|'[^']*'|[^\s"'<>=`/&]+))?)*)\s*(/?)""", re.X)
WHOLE_END = re.compile(r"/([a-zA-Z][a-zA-Z0-9]*)\s*")


@lru_cache(maxsize=4096)
def _tag(written):
    """(name, attributes as written, closed at once, is an end) of what stands between < and >; None if it is no
    well-formed tag, or one that a reader of single tags cannot follow."""
    end = WHOLE_END.fullmatch(written)
    if end:
        return end[1].lower(), "", False, True
    start = WHOLE_START.fullmatch(written)
    if start is None or start[1].lower() in RAW:
        return None
    return start[1].lower(), start[2], bool(start[3]), False


def read_flat(html):
    """What ``_Tree.read_plain`` and ``walk`` make of a page, in one pass over the pieces between its tags; None if the page
    holds anything but well-formed tags and text, or rows inside rows."""
    names, stop, text_from, text_to, attrs, where, texts = [""], [0], [0], [0], [None], [None], []
    opened, count, spent, silent = [0], {}, {}, 0
    begin, *pieces = html.split("<")
    if "&" in begin and (begin := _characters(begin)) is None:
        return None
    held, at = begin, len(html) - sum(map(len, pieces)) - len(pieces)      # text not yet ended, place of the tag
    for piece in pieces:
        written, sign, text = piece.partition(">")
        found = _tag(written) if sign else None
        if found is None:
            return None
        tag, given, closed, ends = found
        if not ends:
            if held:
                held = held.strip()
                if held and not silent:
                    texts.append(held)
                held = ""
            if tag == "tr" and names[opened[-1]] == "tr":
                return None
            opened.append(len(names))
            names.append(tag)
            stop.append(0)
            text_from.append(len(texts))
            text_to.append(0)
            keep = tag == "td" or tag == "th" or tag == "table"
            attrs.append((_attributes(given) if given else {}) if keep else None)
            where.append((at, len(written) + 2) if keep else None)
            count[tag] = count.get(tag, 0) + 1
            if tag in SILENT:
                silent += 1
            if not closed and tag in VOID:
                spent[tag] = spent.get(tag, 0) + 1
                ends = True
            elif closed:
                if spent.get(tag):
                    spent[tag] -= 1
                else:
                    ends = True
        elif spent.get(tag):
            spent[tag] -= 1
            ends = False
        if ends:
            if held:
                held = held.strip()
                if held and not silent:
                    texts.append(held)
                held = ""
            if count.get(tag):
                here, so_far = len(names), len(texts)
                while True:
                    node = opened.pop()
                    gone = names[node]
                    stop[node], text_to[node] = here, so_far
                    count[gone] -= 1
                    if gone in SILENT:
                        silent -= 1
                    if gone == tag:
                        break
        if text:
            if "&" in text and (text := _characters(text)) is None:
                return None
            held += text
        at += len(piece) + 1
    held = held.strip()
    if held and not silent:
        texts.append(held)
    for node in opened:
        stop[node], text_to[node] = len(names), len(texts)
    return _Flat(names, stop, text_from, text_to, attrs, where, texts)


def _characters(text):
    """Text between tags with its references resolved; None if one is not well-formed."""
    out, at = [], 0
    tree = _Tree()
    tree.buffer = out
    while at < len(text):
        token = TOKEN.match(text, at)
        if token is None:
            return None
        kind, at = token.lastgroup, token.end()
        if kind == "entity":
            tree.entity(token["entity"])
        elif kind == "char":
            tree.char(token["char"])
        else:
            out.append(token[0])
    return "".join(out)


def _attributes(written):
    """Attributes of a well-formed start tag; of a repeated one the last counts."""
    return {name.lower(): unescape(a or b or c) if a or b or c else a
            for name, a, b, c in ATTR.findall(written)}


class _Reader(HTMLParser):
    """Feeds a tree from markup of any kind."""

    def __init__(self, html):
        super().__init__(convert_charrefs=False)
        self.tree, self.base = _Tree(), 0
        self.handle_data, self.handle_endtag = self.tree.buffer.append, self.tree.end
        self.handle_entityref, self.handle_charref = self.tree.entity, self.tree.char
        self.handle_comment = self.handle_decl = self.tree.flush
        self.handle_pi = self.unknown_decl = self.tree.flush
        self.feed(html)
        self.base = len(html) - len(self.rawdata)
        self.close()
        self.tree.flush()

    def parse_starttag(self, i):
        self.at = self.base + i
        return super().parse_starttag(i)

    def handle_starttag(self, tag, attrs, closed=False):
        self.tree.start(tag, lambda: dict(attrs), self.at, len(self.get_starttag_text()), closed)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs, closed=True)


def _flat(tree):
    """A tree in document order, rows inside rows moved behind them, and which node of the page each one was."""
    if tree.tr_in_tr:
        tree.lift_rows()
    order, slot, texts = tree.walk()
    slots = [slot[n] for n in order]
    return _Flat([tree.name[n] for n in order], [s[1] for s in slots], [s[2] for s in slots], [s[3] for s in slots],
                 [tree.attrs[n] for n in order], [tree.where[n] for n in order], texts), order


def _read(html):
    flat = read_flat(html)
    if flat:
        return flat
    tree = _Tree()
    return tree if tree.read_plain(html) else _Reader(html).tree


def _span(text):
    """Declared span; raises ValueError when it is no integer, or one no table can have."""
    span = int(text or "")
    if abs(span) >> SPAN_BITS:
        raise ValueError(f"span out of range: {text!r}")
    return span


def _place(rows):
    """Write every cell's place into it; tell whether any overlap."""
    spans = [[(c["rowspan"], c["colspan"]) for c in row] for row in rows]
    if all(span == (1, 1) for line in spans for span in line) \
            and sum(map(len, rows)) == len({cell["node"] for row in rows for cell in row}):
        no = 0
        for r, row in enumerate(rows):                # every cell where it is listed
            for col, cell in enumerate(row):
                cell["row"] = cell["home_row"] = cell["shown_row"] = r
                cell["col"] = cell["home_col"] = cell["shown_col"] = col
                cell["no"] = no
                no += 1
        return False
    columns, overlaps = place(spans)
    home, no = {}, 0
    for r, (row, cols) in enumerate(zip(rows, columns)):
        for cell, col in zip(row, cols):
            cell["row"], cell["col"] = home[cell["node"]] = cell["shown_row"], cell["shown_col"] = r, col
            cell["no"] = no
            no += 1
    if overlaps or any(span[0] < 1 or span[1] < 1 for line in spans for span in line):
        for row, places in zip(rows, shown(spans)):
            for cell, (r, col) in zip(row, places):
                cell["shown_row"], cell["shown_col"] = r, col
    for row in rows:
        for cell in row:      # an element listed twice is known by its last place
            cell["home_row"], cell["home_col"] = home[cell["node"]]
    return overlaps


def _in_bytes(html, places, order):
    """Places of start tags, which rise in the order on the page, in bytes of UTF-8 instead of characters."""
    if html.isascii():
        return places
    out, before, done = list(places), 0, 0
    for n in sorted(range(len(places)), key=lambda n: order[n]):
        if places[n]:
            at, length = places[n]
            done, before = done + len(html[before:at].encode()), at
            out[n] = done, len(html[at:at + length].encode())
    return out


def page_tables(html: str) -> list[dict]:
    """Every table of a page in document order, nested ones too; ``at`` and ``at_len`` are where its or a
    cell's start tag stands, in bytes."""
    try:
        soup = _read(html)
        soup, order = (soup, range(len(soup.name))) if isinstance(soup, _Flat) else _flat(soup)
        where = _in_bytes(html, soup.where, order)
    except Exception as err:                               # one bad page must not fail a job
        return [{"table_idx": 0, "status": "bad_page", "problem": f"{type(err).__name__}: {err}",
                 "at": 0, "at_len": 0, "style": None, "overlaps": False, "rows": []}]
    names, stop = soup.name, soup.stop
    # numbered as on the page, before rows inside rows were moved
    tables = sorted((n for n, name in enumerate(names) if name == "table"), key=lambda n: order[n])
    if not tables:
        return []
    rows_at = [n for n, name in enumerate(names) if name == "tr"]
    cells_at = [n for n, name in enumerate(names) if name == "td" or name == "th"]
    number = {n: i for i, n in enumerate(sorted(cells_at, key=lambda n: order[n]))}

    def below(node, places):
        return places[bisect_right(places, node):bisect_left(places, stop[node])]

    def cell(node):
        attrs, (at, at_len), end = soup.attrs[node], where[node], stop[node]
        return {"node": number[node], "tag": names[node],
                "text": " ".join(soup.texts[soup.text_from[node]:soup.text_to[node]]),
                "tags": sorted(set(names[node:end])) if end - node > 1 else [names[node]],
                "rowspan": _span(attrs["rowspan"]) if "rowspan" in attrs else 1,
                "colspan": _span(attrs["colspan"]) if "colspan" in attrs else 1,
                "gt_id": attrs.get("data-gt-id"), "style": attrs.get("style"),
                "at": at, "at_len": at_len}

    out = []
    for idx, node in enumerate(tables):
        at, at_len = where[node]
        table = {"table_idx": idx, "status": "ok", "problem": None, "at": at, "at_len": at_len,
                 "style": soup.attrs[node].get("style"), "overlaps": False, "rows": []}
        try:
            rows = [[cell(n) for n in below(tr, cells_at)] for tr in below(node, rows_at)]
            rows = [row for row in rows if row]
            table["rows"] = rows or [[cell(n) for n in below(node, cells_at)]]
            table["overlaps"] = _place(table["rows"])
        except ValueError as err:
            table.update(status="bad_span", problem=f"ValueError: {err}")
        out.append(table)
    return out
