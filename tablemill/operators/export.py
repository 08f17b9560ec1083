"""Descriptions, JSON export, sheet layout and painted pages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..sources.tables import TABLE_KEY
from .forest import nested
from .links import header_types, nearest, related, total_contents, total_links
from .store import stored, unsent
from .verdict import is_genuine


def quoted_path(path: str) -> Column:
    """``"a" / "b"``"""
    return F.array_join(F.transform(path, lambda n: F.concat(F.lit('"'), n["text"], F.lit('"'))),
                        " / ")


def path_texts(path: str) -> Column:
    return F.transform(path, lambda n: n["text"])


def hint_lines() -> Column:
    """The lines shown for a cell, by role; needs both paths and ``n_summed``."""
    role = F.col("role")
    noun = None
    for name, text in fixed.ROLE_TEXTS.items():
        noun = F.when(role == name, text) if noun is None else noun.when(role == name, text)

    def line(prefix, path):
        return F.when(F.size(path) > 0, F.concat(F.lit(prefix), quoted_path(path)))

    result = (F.when(F.col("detail") == "STRING", F.array(F.lit(fixed.HINT_TOTAL_LABEL)))
              .when(F.col("n_summed") > 0, F.array(
                  F.concat(F.lit(fixed.HINT_TOTAL_COUNT), F.col("n_summed").cast("string")),
                  F.lit(fixed.HINT_TOTAL)))
              .otherwise(F.array(F.lit(fixed.ROLE_TEXTS["result"]))))
    lines = (F.when(role == "title", F.array(line(fixed.HINT_SUBTITLE, "header_path"), noun))
             .when(role == "sidebar", F.array(line(fixed.HINT_TITLE, "header_path"),
                                              line(fixed.HINT_SUBATTRIBUTE, "sidebar_path"), noun))
             .when(role == "data", F.array(line(fixed.HINT_TITLE, "header_path"),
                                           line(fixed.HINT_ATTRIBUTE, "sidebar_path"), noun))
             .otherwise(result))
    return F.array_compact(lines)


def type_line() -> Column:
    """Own type, or the types inside a header; needs ``types_inside`` for titles."""
    inside = F.coalesce("types_inside", F.array().cast("array<string>"))
    return F.when(F.col("role") == "title", F.concat(
        F.lit(fixed.TYPES_LINE), F.when(F.size(inside) > 0, F.array_join(inside, ", "))
        .otherwise(fixed.TYPES_LINE_EMPTY))) \
        .otherwise(F.concat(F.lit(fixed.TYPE_LINE), F.col("detail")))


def described(pathed: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """Cells with ``summed`` (what a total covers), hint lines and type line.

    Pass a stored table: totals and header types are gathered from it and joined
    back, titles to titles and totals to totals.
    """
    links = total_links(pathed) if links is None else links
    inside = header_types(pathed).select(*TABLE_KEY, F.col("title_no").alias("cell_no"),
                                         F.col("types").alias("types_inside"))
    return (pathed.join(unsent(total_contents(links)), [*TABLE_KEY, "cell_no"], "left")
            .join(unsent(inside), [*TABLE_KEY, "cell_no"], "left")
            .withColumn("n_summed", F.when(F.col("summed").isNull(), 0).otherwise(F.size("summed")))
            .withColumn("lines", hint_lines()).withColumn("types_line", type_line()))


def cell_record() -> Column:
    """One cell as the export states it; totals list what they cover."""
    covered = F.transform("summed", lambda s: F.array(s["row"].cast("bigint"), s["col"]))
    aggregates = F.when(F.col("role") == "result",
                        F.coalesce(covered, F.array().cast("array<array<bigint>>")))
    return F.struct(
        "row", "col", "rowspan", "colspan", "text", "role", "type",
        F.col("detail").alias("detail_type"), path_texts("header_path").alias("header_path"),
        path_texts("sidebar_path").alias("sidebar_path"), aggregates.alias("aggregates"))


def forests(pathed: DataFrame) -> DataFrame:
    """Headers and attributes of each table as nested JSON, by position; tables with neither are left out.

    Only headers and attributes are looked at, a small part of the cells; they
    are written once and put together level by level.
    """
    up = F.when(F.col("role") == "title", nearest("header_path")).otherwise(nearest("sidebar_path"))
    head = F.to_json(F.struct("text", F.array(F.col("row").cast("bigint"), "col").alias("cell")))
    heads = stored(pathed.where(F.col("role").isin("title", "sidebar")).select(
        *TABLE_KEY, "role", F.col("cell_no").alias("no"), up["no"].alias("up"), "row", "col", head.alias("json")), "heads")

    def of(role):
        return F.coalesce(F.max(F.when(F.col("role") == role, F.col("forest"))), F.lit("[]"))
    return (nested(heads, [*TABLE_KEY, "role"], ["row", "col"]).groupBy(*TABLE_KEY)
            .agg(of("title").alias("header"), of("sidebar").alias("sidebar")))


def export_documents(pathed: DataFrame, sources: DataFrame,
                     links: DataFrame | None = None) -> DataFrame:
    """One JSON document per genuine table, which is one record of the result.

    ``sources`` (page_id, url, title) is passed through as it is.
    """
    cells = described(pathed, links)
    per_table = cells.groupBy(*TABLE_KEY).agg(
        F.first("orientation").alias("orientation"),
        F.first("height").alias("rows"), F.first("width").alias("cols"),
        F.array_sort(F.collect_list(F.struct("row", "col", "cell_no", F.to_json(
            cell_record(), {"ignoreNullFields": "true"}).alias("json")))).alias("cells"))
    document = F.concat(
        F.lit('{"format":"' + fixed.EXPORT_FORMAT + '","source":'),
        F.to_json(F.struct("url", "title", F.col("table_idx").alias("index"))),
        F.lit(',"orientation":"'), F.col("orientation"), F.lit('","size":'),
        F.to_json(F.struct("rows", "cols")), F.lit(',"header":'), F.col("header"),
        F.lit(',"sidebar":'), F.col("sidebar"), F.lit(',"cells":['),
        F.array_join(F.transform("cells", lambda c: c["json"]), ","), F.lit("]}"))
    return (per_table.join(unsent(forests(pathed)), TABLE_KEY).join(unsent(sources), "page_id", "left")
            .select(*TABLE_KEY, document.alias("document")))


def page_sources(pages: DataFrame) -> DataFrame:
    """Where a table comes from: address and title of its page."""
    title = F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title", 1)
    return pages.select("page_id", "url", title.alias("title"))


def write_export(documents: DataFrame, path: str) -> None:
    documents.select("document").write.mode("overwrite").text(path)


def _letters(col: Column) -> Column:
    """Spreadsheet letters of a zero-based column: A..Z, AA..ZZ, AAA.."""
    def letter(n):
        return F.chr(F.lit(65) + n.cast("int"))
    two, three = col - 26, col - 702
    return (F.when(col < 26, letter(col))
            .when(col < 702, F.concat(letter(F.floor(two / 26)), letter(two % 26)))
            .otherwise(F.concat(letter(F.floor(three / 676)), letter(F.floor(three / 26) % 26),
                                letter(three % 26))))


def sheet_layout(role_cells: DataFrame, coloured: bool = True) -> DataFrame:
    """Every cell as a spreadsheet takes it: sheet, place, merged range, fill, font.

    One workbook per page, one sheet per table, named by its place on the page.
    """
    fill = F.lit(None).cast("string")
    font = F.lit(None).cast("string")
    if coloured:
        fill = None
        for role, colour in fixed.SHEET_FILL.items():
            if role:
                test = F.col("role") == role
                fill = F.when(test, colour) if fill is None else fill.when(test, colour)
        fill = fill.otherwise(fixed.SHEET_FILL[None])
        font = F.when(F.col("role") == "data", fixed.SHEET_DATA_FONT)

    def address(row, col):
        return F.concat(_letters(col), row.cast("string"))
    last_row = F.col("row") + F.greatest("rowspan", F.lit(1))
    last_col = F.col("col") + F.greatest("colspan", F.lit(1)) - 1
    merged = F.when((F.col("rowspan") > 1) | (F.col("colspan") > 1), F.concat(
        address(F.col("row") + 1, F.col("col")), F.lit(":"), address(last_row, last_col)))
    return role_cells.select(
        *TABLE_KEY, F.concat(F.lit(fixed.SHEET_PREFIX), (F.col("table_idx") + 1).cast("string"))
        .alias("sheet"), (F.col("row") + 1).alias("row"), (F.col("col") + 1).alias("col"),
        F.col("text").alias("value"), merged.alias("merge"), fill.alias("fill"),
        font.alias("font"), F.lit("thin").alias("border"))


def _escaped(value: Column) -> Column:
    """A text as it may stand between double quotes."""
    for sign, name in fixed.ESCAPES.items():
        value = F.replace(value, F.lit(sign), F.lit(name))
    return value


def _with_attribute(tag: Column, name: str, value: Column) -> Column:
    """A start tag with an attribute set: in place of the first of that name, else at its end."""
    written = rf"(?isU)^(.*?\s){name}(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>]+))?(?=[\s/>])"
    new = F.concat(F.lit(f'{name}="'), _escaped(value), F.lit('"'))
    found = F.regexp_extract(tag, written, 0)
    return (F.when(found != "", F.concat(F.regexp_extract(tag, written, 1), new,
                                         tag.substr(F.length(found) + 1, F.length(tag))))
            .when(tag.endswith(">"), F.concat(F.regexp_replace(tag, r"(?U)\s*/?>\z", ""), F.lit(" "), new,
                                              F.regexp_extract(tag, r"/?>\z", 0)))
            .otherwise(tag))


def spliced(text: Column, edits: Column, changed: Callable[[Column, Column], Column]) -> Column:
    """``text`` with some stretches of it put through ``changed(stretch, edit)``.

    ``edits`` are structs that begin with at and at_len, in bytes of UTF-8, and do not
    overlap. The bytes between two edits are taken once each, so the work is
    that of copying the text, however many edits there are.
    """
    raw, order = text.cast("binary"), F.array_sort(edits)

    def part(begin, size):
        return raw.substr(begin + 1, size).cast("string")

    def piece(e, i):
        done = F.when(i == 0, 0).otherwise(order[i - 1]["at"] + order[i - 1]["at_len"])
        return F.concat(part(done, e["at"] - done), changed(part(e["at"], e["at_len"]), e))
    end = F.element_at(order, -1)["at"] + F.element_at(order, -1)["at_len"]
    return F.concat(F.array_join(F.transform(order, piece), ""), part(end, F.octet_length(text)))


def _painted(tag: Column, edit: Column) -> Column:
    """A start tag with its title, if the edit has one, and its style."""
    titled = F.when(edit["title"].isNull(), tag).otherwise(
        _with_attribute(tag, "title", F.coalesce(edit["title"], F.lit(""))))
    return _with_attribute(titled, "style", edit["style"])


def annotate_pages(pages: DataFrame, judged: DataFrame, accepted: Column | None = None) -> DataFrame:
    """Pages with genuine tables outlined and their cells coloured by role, the others
    outlined as rejected with the reason as their title; and the two counts.

    ``accepted`` is the model's answer, a boolean column of ``judged``. Only the
    edits, a few bytes per cell, are brought to their page; pages without tables
    pass through untouched. Pass a stored table: tables and cells are picked from it
    separately.
    """
    from .verdict import roles

    ok = is_genuine() if accepted is None else is_genuine() & accepted
    reason = F.when(ok, fixed.PAGE_GENUINE_TITLE).otherwise(F.concat(
        F.lit(fixed.PAGE_REJECTED_TITLE), F.coalesce("message", F.lit(fixed.MODEL_REJECTED_TEXT))))
    outline = F.when(ok, fixed.PAGE_GENUINE_STYLE).otherwise(fixed.PAGE_REJECTED_STYLE)
    tables = judged.select("page_id", "table_idx", F.lit(-1).alias("nth"), "at", "at_len", "style",
                           outline.alias("added"), reason.alias("title"),
                           ok.cast("int").alias("genuine"))
    paint = None
    for role, style in fixed.PAGE_STYLE.items():
        test = F.col("role") == role
        paint = F.when(test, style) if paint is None else paint.when(test, style)
    cells = roles(judged.where(ok)).select(
        "page_id", "table_idx", F.col("cell_no").alias("nth"), "at", "at_len", "style",
        paint.alias("added"), F.lit(None).cast("string").alias("title"),
        F.lit(None).cast("int").alias("genuine")).where(F.col("added").isNotNull())

    merged = F.aggregate(
        F.array_sort("added"), F.coalesce("style", F.lit("")), lambda old, a: F.regexp_replace(
            F.concat(old, F.lit(";"), a["added"]), "^;+|;+$", ""))
    edits = (tables.unionByName(cells)
             .groupBy("page_id", "at", "at_len")       # an element of several tables, in order
             .agg(F.collect_list(F.struct("table_idx", "nth", "added")).alias("added"),
                  F.first("style").alias("style"), F.max("title").alias("title"),
                  F.count("genuine").alias("n"), F.sum("genuine").alias("g"))
             .select("page_id", "n", "g", F.struct("at", "at_len", merged.alias("style"), "title")
                     .alias("edit")))
    per_page = edits.groupBy("page_id").agg(
        F.collect_list("edit").alias("edits"), F.sum("n").alias("tables"),
        F.sum("g").alias("genuine"))
    out = pages.join(unsent(per_page), "page_id", "left").na.fill(0, ["tables", "genuine"])
    touched = F.when(F.col("edits").isNotNull(), spliced(F.col("html"), F.col("edits"), _painted))
    return out.select("page_id", "url", F.coalesce(touched, F.col("html")).alias("html"),
                      "tables", "genuine")


def without_tables(pages: DataFrame, answers: DataFrame) -> DataFrame:
    """``answers`` with one more for each page that holds no table."""
    empty = (pages.select("page_id").join(unsent(answers.select("page_id").distinct()), "page_id", "left_anti")
             .withColumn("genuine", F.lit(False)).withColumn("reason", F.lit(fixed.NO_TABLE_TEXT)))
    return answers.unionByName(empty, allowMissingColumns=True)


def analyze(judged: DataFrame, cells: DataFrame, documents: DataFrame,
            accepted: DataFrame | None = None) -> DataFrame:
    """The answer on each table: genuine or why not, its numbered cells, its export.

    ``cells`` are ``described`` cells; those with a page number (``gt_id``) are
    listed with role, hint lines, type line and the numbers to highlight.
    ``accepted`` (key, prediction) is the model's answer on tables the rule passed.
    ``without_tables`` adds the answer on pages that hold none.
    """
    lit_ids = F.when(F.col("role") == "result", F.transform("summed", lambda s: s["gt_id"])) \
        .otherwise(F.transform(related(), lambda n: n["gt_id"]))
    entry = F.struct("gt_id", F.struct(
        "role", "lines", F.col("types_line").alias("types"),
        F.coalesce(F.array_compact(lit_ids), F.array().cast("array<string>")).alias("highlight")))
    listed = cells.where(F.col("gt_id").isNotNull()).groupBy(*TABLE_KEY).agg(
        F.map_from_entries(F.collect_list(entry)).alias("cells"))
    rows = judged.select(*TABLE_KEY, "verdict", "message")
    if accepted is None:
        rows = rows.withColumn("genuine", is_genuine())
    else:
        rows = (rows.join(unsent(accepted.select(*TABLE_KEY, "prediction")), TABLE_KEY, "left")
                .withColumn("genuine", is_genuine() & (F.col("prediction") == fixed.GENUINE_LABEL)))
    reason = (F.when(F.col("genuine"), F.lit(None).cast("string"))
              .when(F.col("verdict") == "error", F.concat(F.lit(fixed.PROGRAM_ERROR_TEXT), "message"))
              .otherwise(F.coalesce("message", F.lit(fixed.MODEL_REJECTED_TEXT))))
    return (rows.join(unsent(listed), TABLE_KEY, "left").join(unsent(documents), TABLE_KEY, "left")
            .select(*TABLE_KEY, "genuine", reason.alias("reason"),
                    F.when(F.col("genuine"), F.coalesce("cells", F.create_map().cast(
                        listed.schema["cells"].dataType))).alias("cells"),
                    F.when(F.col("genuine"), F.col("document")).alias("export")))
