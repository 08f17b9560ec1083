"""Is a table genuine, and what is each of its cells? One row per table throughout.

Span-free rectangular tables, the common case, are decided by plain array
expressions; only the others send their types and spans (no texts) to the leaf
in ``lines``. Nothing here shuffles.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from .. import fixed
from ..functions.cell_types import column_kind
from ..sources.tables import TABLE_KEY, type_tables

_ARROW_JUDGED = pa.struct([
    ("kind", pa.string()), ("code", pa.string()), ("block", pa.string()),
    ("args", pa.list_(pa.struct([("k", pa.int64()), ("what", pa.string())]))),
    ("attempt", pa.string()), ("cells", pa.list_(pa.struct([
        ("k", pa.int32()), ("role", pa.string()), ("p_row", pa.int32()), ("p_col", pa.int64()),
        ("p_rowspan", pa.int64()), ("p_colspan", pa.int64())])))])


@F.arrow_udf(from_arrow_type(_ARROW_JUDGED))
def _read_lines(rows: pa.Array) -> pa.Array:
    from .lines import judge_all
    return judge_all(rows, _ARROW_JUDGED)


# Not for Catalyst to copy into filters: a pushed-down copy would run it twice.
_read_lines = _read_lines.asNondeterministic()


def too_small(rows: Column) -> Column:
    """One row, one cell per row, or a size from the fixed list."""
    first = F.size(rows[0])
    return ((F.size(rows) == 1)
            | ((F.size(rows) == 2) & ((first == 1) | (first + F.size(rows[1]) == 3)))
            | F.forall(rows, lambda r: F.size(r) == 1))


def is_plain(rows: Column) -> Column:
    """Every row equally long, no spans, at least 2 x 2."""
    width = F.size(rows[0])
    return ((F.size(rows) > 1) & (width > 1) & F.forall(rows, lambda r: (F.size(r) == width)
            & F.forall(r, lambda c: (c["rowspan"] == 1) & (c["colspan"] == 1))))


def _arg(k, what: str) -> Column:
    return F.struct(k.cast("bigint").alias("k"), F.lit(what).alias("what"))


def _outcome(kind, code, block, args: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), F.lit(code).alias("code"),
                    F.lit(block).cast("string").alias("block"), args.alias("args"))


def plain_check(height: Column, width: Column, at, number) -> Column:
    """First objection to a span-free grid read with its header on top, null if none.

    ``at(r, c)`` is a cell and ``number(r, c)`` its number in the source rows, so
    the same expression reads the grid in either direction.
    """
    zero = F.lit(0)

    def first_bad(count, cell, allowed):
        return F.filter(F.sequence(zero, count - 1), lambda i: ~cell(i)["type"].isin(allowed))

    head_bad = first_bad(width, lambda c: at(zero, c), fixed.TOP_HEADER_TYPES)
    side_bad = F.when(height > 2, F.filter(F.sequence(F.lit(1), height - 1), lambda r:
                                           ~at(r, zero)["type"].isin(fixed.HEADER_TYPES)))

    def column_break(c):
        """Where a column first leaves the kind it began with: (row, column, row compared to)."""
        filled = F.filter(F.sequence(F.lit(1), height - 1),
                          lambda r: column_kind(at(r, c)["detail"]).isNotNull())

        def found(rows):
            other = F.filter(rows, lambda r: column_kind(at(r, c)["detail"])
                             != column_kind(at(rows[0], c)["detail"]))
            return F.when(F.size(other) > 0, F.struct(
                other[0].alias("r"), c.alias("c"),
                F.array_max(F.filter(rows, lambda r: r < other[0])).alias("above")))
        return F.transform(F.array(filled), found)[0]

    breaks = F.array_min(F.filter(F.transform(F.sequence(zero, width - 1), column_break),
                                  lambda b: b.isNotNull()))

    def bad_type(r, c, block):
        return _outcome("TitleTypeError", "bad_type", block, F.array(
            _arg(number(r, c), "text"), _arg(number(r, c), "type")))

    def broken(b):
        parent, child = number(b["above"], b["c"]), number(b["r"], b["c"])
        return _outcome("DataTypeError", "column_type", None, F.array(
            _arg(parent, "text"), _arg(parent, "detail"),
            _arg(child, "text"), _arg(child, "detail")))

    def with_breaks(b):
        return (F.when(b.isNotNull(), broken(b))
                .otherwise(F.transform(F.array(side_bad), lambda s: F.when(
                    F.size(s) > 0, bad_type(s[0], zero, "sidebar")))[0]))

    return F.transform(F.array(head_bad), lambda h: F.when(
        F.size(h) > 0, bad_type(zero, h[0], "title"))
        .otherwise(F.transform(F.array(breaks), with_breaks)[0]))[0]


def _plain_places(height, width, attempt) -> Column:
    """Role and place of every cell of a genuine span-free grid."""
    top = attempt == "top"

    def placed(k):
        r, c = F.floor(k / width), k % width
        line, pos = F.when(top, r).otherwise(c), F.when(top, c).otherwise(r)
        lines = F.when(top, height).otherwise(width)
        role = (F.when(line == 0, "title").when((pos == 0) & (lines > 2), "sidebar")
                .otherwise("data"))
        one = F.lit(1).cast("bigint")
        return F.struct(k.alias("k"), role.alias("role"), line.cast("int").alias("p_row"),
                        pos.cast("bigint").alias("p_col"), one.alias("p_rowspan"),
                        one.alias("p_colspan"))
    return F.transform(F.sequence(F.lit(0), height * width - 1), placed)


def _text_of(code: Column, block: Column, args: Column, rows: Column, flat: Column) -> Column:
    """The message of an objection, with the texts and types of the cells it names."""
    def value(a):
        cell = flat[a["k"].cast("int")]
        return (F.when(a["what"] == "num", a["k"].cast("string"))
                .when(a["what"] == "text", cell["text"])
                .when(a["what"] == "detail", cell["detail"])
                .when(a["what"] == "type", cell["type"])
                .when(a["what"] == "line", F.array_join(
                    F.transform(rows[a["k"].cast("int")], lambda c: c["text"]), " | ")))

    values = F.transform(args, value)
    noun = F.when(block == "sidebar", fixed.ROLE_NOUNS["sidebar"]) \
        .otherwise(fixed.ROLE_NOUNS["title"])
    out = None
    for key, text in fixed.VERDICT_TEXTS.items():
        pattern = text.replace("%", "%%").replace("{H}", "%6$s")
        for i in range(5):
            pattern = pattern.replace("{%d}" % i, f"%{i + 1}$s")
        filled = F.format_string(pattern, *[F.get(values, F.lit(i)) for i in range(5)], noun)
        out = F.when(code == key, filled) if out is None else out.when(code == key, filled)
    return out


def judge_tables(typed: DataFrame) -> DataFrame:
    """Typed tables -> the same with ``verdict, message, orientation`` and ``placed``.

    ``verdict`` is genuine, LayoutError, TitleTypeError, DataTypeError or error;
    ``status`` tells tables that could not be read at all. ``placed`` holds role and
    place of every cell of a genuine table, in the orientation it was read in.
    """
    rows = F.col("rows")
    readable = F.col("status") == "ok"
    route = (F.when(~readable, "none").when(too_small(rows), "small")
             .when(is_plain(rows), "plain").otherwise("lines"))
    slim = F.transform(rows, lambda r: F.transform(r, lambda c: F.struct(
        c["no"].alias("k"), c["detail"].alias("detail"), c["type"].alias("type"),
        c["rowspan"].alias("h"), c["colspan"].alias("w"), c["shown_col"].alias("pos"),
        c["shown_row"].alias("y"))))

    height, width = F.size(rows), F.size(rows[0])
    plain = F.col("_route") == "plain"
    # The native checks come first, so that a filter on the verdict stops above the
    # Python step and finds their outcome instead of computing it once more.
    routed = (typed.withColumn("_route", route)
              .withColumn("_top", F.when(plain, plain_check(
                  height, width, lambda r, c: rows[r][c], lambda r, c: r * width + c)))
              .withColumn("_left", F.when(plain & F.col("_top").isNotNull(), plain_check(
                  width, height, lambda r, c: rows[c][r], lambda r, c: c * width + r)))
              .withColumn("_read", _read_lines(F.when(F.col("_route") == "lines", slim))))

    read, top, left = F.col("_read"), F.col("_top"), F.col("_left")
    attempt = F.when(plain, F.when(top.isNull(), "top").when(left.isNull(), "left")) \
        .otherwise(read["attempt"])
    kind = (F.when(F.col("_route") == "small", "LayoutError")
            .when(plain, F.when(top.isNull() | left.isNull(), "genuine").otherwise(top["kind"]))
            .otherwise(read["kind"]))
    told = F.coalesce(read.dropFields("attempt", "cells"), top)
    judged = (routed.withColumn("_attempt", attempt)
              .withColumn("_kind", kind)
              .withColumn("_told", F.when(F.col("_route") == "small", _outcome(
                  None, "small", None, F.array(_arg(height, "num"), _arg(width, "num"))))
                  .otherwise(told))
              .withColumn("placed", F.when(F.col("_kind") == "genuine", F.when(
                  plain, _plain_places(height, width, F.col("_attempt")))
                  .otherwise(read["cells"])))
              .withColumn("_flat", F.flatten(rows)))

    flat, told = F.col("_flat"), F.col("_told")
    text = _text_of(told["code"], told["block"], told["args"], rows, flat)
    failed = ~readable | (F.col("_kind") == "ValueError")
    same_place = F.forall(F.col("placed"), lambda p: (
        flat[p["k"]]["home_row"] == p["p_row"]) & (flat[p["k"]]["home_col"] == p["p_col"]))
    keep = [c for c in typed.columns if c not in ("status", "problem")]
    return judged.select(
        *keep,
        F.when(~readable, F.col("status")).when(F.col("_kind") == "ValueError", "error")
        .otherwise("ok").alias("status"),
        F.when(failed, "error").otherwise(F.col("_kind")).alias("verdict"),
        F.when(~readable, F.col("problem")).when(F.col("_kind") != "genuine",
               F.concat(F.col("_kind"), F.lit(": "), text)).alias("message"),
        F.when(F.col("_kind") == "genuine", F.when(same_place, "top").otherwise("left"))
        .alias("orientation"),
        (F.col("_route") == "plain").alias("plain"), "placed")


def verdicts(judged: DataFrame) -> DataFrame:
    """(key, verdict, message, orientation, status), one row per table."""
    key = [c for c in judged.columns if c in TABLE_KEY + ["kind"]]
    return judged.select(*key, "verdict", "message", "orientation", "status")


def is_genuine() -> Column:
    return F.col("verdict") == fixed.GENUINE_LABEL


def simple_grid_verdict(judged: DataFrame) -> DataFrame:
    """Verdicts of the tables that native expressions decide alone."""
    return verdicts(judged.where("plain"))


def _covers(p: Column, starts: Column, last_row: Column) -> Column:
    """Columns a cell covers, of those in which some cell starts, with the first and
    the last line in which it shows there."""
    bottom = F.least(p["p_row"] + F.greatest(p["p_rowspan"], F.lit(1)) - 1, last_row).cast("int")

    def span(col, first, last):
        return F.struct(col.alias("col"), first.alias("first"), last.alias("last"))

    wide = F.filter(starts, lambda s: (s >= p["p_col"]) & (s < p["p_col"] + p["p_colspan"]))
    return (F.when(p["p_colspan"] > 1, F.transform(wide, lambda c: span(c, p["p_row"], bottom)))
            .otherwise(F.array(span(p["p_col"], p["p_row"], bottom))))


def _beside(p: Column, last_row: Column) -> Column:
    """Lines a cell covers, with the first column in which it shows there."""
    bottom = F.least(p["p_row"] + F.greatest(p["p_rowspan"], F.lit(1)) - 1, last_row).cast("int")

    def span(line, first):
        return F.struct(line.alias("line"), first.alias("first"))

    return F.transform(F.sequence(p["p_row"], bottom), lambda r: span(r, p["p_col"]))


def roles(judged: DataFrame) -> DataFrame:
    """One row per cell of a genuine table.

    Place on the page (row, col, spans), place as read (``p_``), role and type,
    ``covers``/``beside`` (columns and lines it covers as read) and the table's size
    and ``signatures``: start and width of the labels of its total lines.
    """
    key = [c for c in judged.columns if c in TABLE_KEY + ["kind"]]
    placed, flat = F.col("placed"), F.col("flat")
    starts = F.array_distinct(F.transform(placed, lambda p: p["p_col"]))
    labels = F.filter(placed, lambda p: (p["role"] == "result")
                      & (flat[p["k"]]["detail"] == "STRING"))
    signatures = F.array_distinct(F.transform(labels, lambda p: F.struct(
        p["p_col"].alias("col"), p["p_colspan"].alias("width"))))
    ready = (judged.where(is_genuine())
             .withColumn("flat", F.flatten("rows"))
             .withColumn("starts", starts)
             .withColumn("last_row", F.array_max(F.transform(placed, lambda p: p["p_row"])))
             .withColumn("signatures", signatures)
             .withColumn("height", F.size("rows"))
             .withColumn("width", F.array_max(F.transform(
                 flat, lambda c: c["col"] + F.greatest(c["colspan"], F.lit(1))))))
    cells = F.transform(placed, lambda p: F.struct(
        p.alias("p"), flat[p["k"]].alias("c"),
        _covers(p, F.col("starts"), F.col("last_row")).alias("covers"),
        _beside(p, F.col("last_row")).alias("beside")))
    whole = ["orientation", "height", "width", "signatures"]
    return (ready.select(*key, *whole, F.explode(cells).alias("x"))
            .select(*key, *whole, F.col("x.p.k").alias("cell_no"),
                    F.coalesce("x.p.role", F.lit("NOT_DEFINE")).alias("role"),
                    F.col("x.c.home_row").alias("row"), F.col("x.c.home_col").alias("col"),
                    "x.c.rowspan", "x.c.colspan", "x.c.tag", "x.c.text", "x.c.tags", "x.c.type",
                    "x.c.detail", "x.c.node", "x.c.gt_id", "x.c.style", "x.c.at", "x.c.at_len",
                    "x.p.p_row", "x.p.p_col", "x.p.p_rowspan", "x.p.p_colspan",
                    "x.covers", "x.beside"))


def unclassified(role_cells: DataFrame) -> DataFrame:
    """Cells the check left without a role: none are expected."""
    return role_cells.where(F.col("role") == "NOT_DEFINE")


def judge(pages: DataFrame) -> DataFrame:
    """Pages straight to judged tables."""
    from ..sources.tables import extract_tables
    return judge_tables(type_tables(extract_tables(pages)))
