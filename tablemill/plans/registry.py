"""Every operator as a query over the test tables, with its expected answer in SQL.

A query takes (spark, sf_dir) and reads whole tables. Where SQL cannot state the
answer (fitted models) there is none.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import fixed
from ..functions import cell_types as ct
from ..operators import audit, export, features, grid, learn, links, verdict
from ..operators.store import stored, unsent
from ..session import prepare, work_folder
from ..sources import rendered, tables
from ..sources.tables import TABLE_KEY
from ..streaming import score as streaming
from . import expected as ex
from . import runs, shown, snapshots

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(prepare(spark), sf_dir)
        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


# ------------------------------------------------------------------ helpers
RENDER = {"document": rendered.document_pages, "order": rendered.order_pages,
          "customer": rendered.customer_pages, "event": rendered.event_pages}


def pages_of(spark, sf, *kinds) -> DataFrame:
    out = None
    for kind in kinds or rendered.KINDS:
        part = RENDER[kind](spark, sf)
        out = part if out is None else out.unionByName(part)
    return out


def tables_of(spark, sf, *kinds) -> DataFrame:
    return tables.extract_tables(pages_of(spark, sf, *kinds))


def typed_of(spark, sf, *kinds) -> DataFrame:
    return tables.type_tables(tables_of(spark, sf, *kinds))


def judged_of(spark, sf, *kinds) -> DataFrame:
    return verdict.judge_tables(typed_of(spark, sf, *kinds))


def roles_of(spark, sf, *kinds) -> DataFrame:
    return verdict.roles(judged_of(spark, sf, *kinds))


def pathed_of(spark, sf, *kinds) -> DataFrame:
    return links.paths(roles_of(spark, sf, *kinds))


def joined(path: str) -> Column:
    return F.array_join(export.path_texts(path), " > ")


def listed(items: Column) -> Column:
    return F.array_join(items, ",")


DOC, ORD, CUS, EV, LAB = ex.DOC, ex.ORD, ex.CUS, ex.EV, ex.LAB
GRIDS = "(SELECT {0} FROM doc_p UNION ALL SELECT {0} FROM ord_c UNION ALL SELECT {0} FROM cus_c) AS g"


def on_grids(columns: str, where: str = "TRUE", select: str | None = None) -> str:
    """SQL over the cells of the document, order and customer tables."""
    needed = ("page_id, row, col, rowspan, colspan, text, role, detail, tag, tags, src_row, "
              "src_idx, header, sidebar")
    return ex.with_(DOC, ORD, CUS, body=f"SELECT {select or columns} FROM "
                    + GRIDS.format(needed) + f" WHERE {where}")


GRID_KINDS = ("document", "order", "customer")


# ------------------------------------------------------------------ sources
@query("read_pages", "SELECT page_id, url, length(html) AS chars FROM pages")
def _(spark, sf):
    return (tables.read_pages(spark, f"{sf}/pages.parquet")
            .select("page_id", "url", F.char_length("html").alias("chars")))


def labelled_folder(spark, sf) -> str:
    """Event pages as labelled records, one document per line, some without markup."""
    rows = (rendered.event_pages(spark, sf)
            .withColumn("event_id", F.expr("(page_id - 3) div 4"))
            .withColumn("html", F.when(F.col("event_id") % 19 == 0, "").otherwise(F.col("html"))))
    record = F.struct(F.concat(F.lit("Record "), F.col("event_id").cast("string")).alias("name"),
                      "url", F.col("html").alias("html_text"),
                      F.expr(ex.LABEL).alias("verification"))
    path = work_folder(spark, "labelled")
    rows.select(F.to_json(F.create_map(F.col("event_id").cast("string"), record))).write.text(path)
    return path


def records_of(spark, sf, **options) -> DataFrame:
    return tables.read_labelled(spark, labelled_folder(spark, sf), **options)


@query("read_labelled", ex.with_(LAB.split("lab_v AS")[0].rstrip().rstrip(","), body="""
SELECT key, name, verification FROM lab WHERE verification <> 'None'"""))
def _(spark, sf):
    return records_of(spark, sf).select("key", "name", "verification")


def _closed(batches):
    """The lines of a task's map and its closing brace."""
    some = False
    for batch in batches:
        some = some or batch.num_rows > 0
        yield batch
    if some:
        yield pa.RecordBatch.from_pydict({"value": ["}"]})


@query("read_labelled_map", ex.with_(LAB.split("lab_v AS")[0].rstrip().rstrip(","), body="""
SELECT key, name, verification FROM lab WHERE verification <> 'None'"""))
def _(spark, sf):
    """All records as pretty-printed maps, one to a file that a task writes, read by as many tasks as files have blocks."""
    lines = spark.read.text(labelled_folder(spark, sf)).select(F.expr("substr(value, 2, length(value) - 2)").alias("entry"))
    path = work_folder(spark, "labelled-map")
    first = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0          # of its task's rows
    body = lines.select(F.concat(F.when(first, "{\n ").otherwise(", "), "entry").alias("value"))
    body.mapInArrow(_closed, body.schema).write.text(path)
    return tables.read_labelled(spark, path, split=True).select("key", "name", "verification")


@query("extract_tables", ex.with_(DOC, EV, body="""
SELECT page_id, 0 AS table_idx, 'ok' AS status, (2 + n + nb)::INT AS n_rows FROM doc_t
UNION ALL SELECT o_orderkey * 4 + 1, 0, 'ok', 5 FROM orders
UNION ALL SELECT c_custkey * 4 + 2, 0, 'ok', 4 FROM customer
UNION ALL SELECT page_id, table_idx, CASE WHEN status = 'error' THEN 'ok' ELSE status END, n_rows FROM ev"""))
def _(spark, sf):
    return tables_of(spark, sf).select(*TABLE_KEY, "status", F.size("rows").alias("n_rows"))


@query("extract_tables_from_pages", "SELECT page_id, len(regexp_extract_all(html, '(?i)<table[ >]')) AS n_tables FROM pages")
def _(spark, sf):
    """Every given page with the number of tables found in it."""
    pages = tables.read_pages(spark, f"{sf}/pages.parquet")
    found = tables.extract_tables(pages).groupBy("page_id").agg(F.count("*").alias("n"))
    return pages.select("page_id").join(found, "page_id", "left").select(
        "page_id", F.coalesce("n", F.lit(0)).alias("n_tables"))


@query("extract_cells", on_grids("page_id, src_row, src_idx, tag, text, rowspan, colspan, row, col"))
def _(spark, sf):
    return tables.extract_cells(tables_of(spark, sf, *GRID_KINDS)).select(
        "page_id", "src_row", "src_idx", "tag", "text", "rowspan", "colspan", "row", "col")


@query("html_cells_in_sql", ex.with_(CUS, body="SELECT page_id, row, col, text, tag FROM cus_c"))
def _(spark, sf):
    spark.udtf.register("html_cells", tables.HtmlCells)
    rendered.customer_pages(spark, sf).createOrReplaceTempView("customer_page_source")
    return spark.sql("SELECT p.page_id, c.row, c.col, c.text, c.tag "
                     "FROM customer_page_source p, LATERAL html_cells(p.html) c")


# ------------------------------------------------------------------ one cell
@query("cell_text", r"SELECT conv_id, turn, array_to_string(list_filter(list_transform("
       r"string_split(text, chr(10)), lambda p: trim(p, ' ')), lambda p: p <> ''), ' ') AS cell_text "
       "FROM conversations")
def _(spark, sf):
    return (rendered.load(spark, sf, "conversations")
            .select("conv_id", "turn", ct.joined_text(F.split("text", "\n")).alias("cell_text")))


@query("tag_set", on_grids("page_id, row, col, tags"))
def _(spark, sf):
    return tables.extract_cells(tables_of(spark, sf, *GRID_KINDS)).select(
        "page_id", "row", "col", listed(ct.tag_set(F.col("tags"))).alias("tags"))


SPANS = ("CASE WHEN p_partkey % 7 = 0 THEN NULL WHEN p_partkey % 5 = 0 THEN p_size || 'px' "
         "WHEN p_partkey % 3 = 0 THEN ' ' || p_size || ' ' ELSE CAST(p_size AS {text}) END")


@query("parse_span", "SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 1 WHEN p_partkey % 5 = 0 "
       "THEN NULL ELSE p_size END AS span FROM part")
def _(spark, sf):
    declared = F.expr(SPANS.format(text="STRING"))
    return rendered.load(spark, sf, "part").select("p_partkey", ct.parse_span(declared).alias("span"))


def tagged_events(spark, sf) -> DataFrame:
    """Events with a set of tags each, cycling through ``TAG_SETS``."""
    n = F.col("event_id") % len(ex.TAG_SETS)
    sets = F.array(*[F.lit(s[0]) for s in ex.TAG_SETS])
    return (rendered.load(spark, sf, "events")
            .withColumn("tags", F.split(sets[n.cast("int")], ",")))


def tag_answer(place: int) -> str:
    values = " ".join(f"WHEN {i} THEN {_sql_bool(s[place])}" for i, s in enumerate(ex.TAG_SETS))
    return f"SELECT event_id, CASE event_id % {len(ex.TAG_SETS)} {values} END AS hit FROM events"


def _sql_bool(x) -> str:
    return "TRUE" if x else "FALSE"


for _name, _place, _fn in [("only_formatting", 1, ct.only_formatting),
                           ("only_formatting_or_link", 2, ct.only_formatting_or_link),
                           ("button_cells", 3, ct.is_button), ("input_cells", 4, ct.is_input_box)]:
    @query(_name, tag_answer(_place))
    def _(spark, sf, fn=_fn):
        return tagged_events(spark, sf).select("event_id", fn(F.col("tags")).alias("hit"))


MEDIA_TEXT = "CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'ab' ELSE event_type END"
_MEDIA_KIND = ("CASE WHEN event_id % 3 = 0 THEN CASE event_id % 17 WHEN 4 THEN 'PHOTO' WHEN 13 THEN "
               "'VIDEO' WHEN 14 THEN 'AUDIO' WHEN 15 THEN 'PHOTO' END END")


@query("media_cells", f"SELECT event_id, {_MEDIA_KIND} AS media FROM events")
def _(spark, sf):
    return tagged_events(spark, sf).select("event_id", ct.media_kind(
        F.col("tags"), F.expr(MEDIA_TEXT)).alias("media"))


@query("mixed_cells", "SELECT event_id, (event_id % 17 IN (4, 13, 14) AND event_id % 3 = 2) "
       "OR event_id % 17 = 15 AS hit FROM events")
def _(spark, sf):
    return tagged_events(spark, sf).select("event_id", ct.is_mixed(
        F.col("tags"), F.expr(MEDIA_TEXT)).alias("hit"))


# Tag sets with their text give every detail type that is not about numbers.
_TAGGED_DETAIL = f"""
CASE WHEN event_id % 3 = 0 AND event_id % 17 IN (0, 1) THEN 'NO_DATA'
     WHEN event_id % 17 IN (0, 1) THEN 'STRING' WHEN event_id % 17 IN (2, 3) THEN 'LINK'
     WHEN event_id % 17 IN (5, 6) THEN 'BUTTON' WHEN event_id % 17 IN (7, 8, 10) THEN 'INPUT_BOX'
     ELSE coalesce({_MEDIA_KIND}, CASE WHEN (event_id % 17 IN (4, 13, 14) AND event_id % 3 = 2)
     OR event_id % 17 = 15 THEN 'MIXED' ELSE 'OTHER' END) END"""


@query("detail_type_of_tagged", f"SELECT event_id, {_TAGGED_DETAIL} AS detail FROM events")
def _(spark, sf):
    return tagged_events(spark, sf).select("event_id", ct.detail_type(
        F.col("tags"), F.expr(MEDIA_TEXT)).alias("detail"))


def cell_texts(spark, sf) -> DataFrame:
    """Texts as a cell may hold them: written by rule from events, all lines of all
    documents, all turns of all conversations."""
    shapes = (rendered.load(spark, sf, "events")
              .select(F.col("event_id").alias("id"),
                      F.round(F.col("value") * 100).cast("long").cast("string").alias("v"))
              .select(F.lit("shape").alias("src"), "id", F.expr(
                  ex.TEXT_CASE.replace("''", "\\'")).alias("text")))
    lines = (rendered.spread(rendered.load(spark, sf, "documents"))
             .select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "text"))
             .select(F.lit("line").alias("src"), (F.col("doc_id") * 100000 + F.col("i")).alias("id"),
                     "text"))
    turns = rendered.load(spark, sf, "conversations").select(
        F.lit("turn").alias("src"), (F.col("conv_id") * 100000 + F.col("turn")).alias("id"), "text")
    return shapes.unionByName(lines).unionByName(turns)


for _name, _fn in [("date", ct.is_date), ("time", ct.is_time), ("money", ct.is_money),
                   ("percent", ct.is_percent), ("measurement", ct.is_measurement),
                   ("dimension", ct.is_dimension)]:
    @query(f"{_name}_texts", ex.with_(ex.TEXTS, body=f"SELECT src, id, {ex.HIT[_name]} AS hit FROM texts"))
    def _(spark, sf, fn=_fn):
        return cell_texts(spark, sf).select("src", "id", fn(F.col("text")).alias("hit"))


@query("no_data_cells", ex.with_(ex.TEXTS, body=f"SELECT src, id, {ex.HIT['no_data']} AS hit FROM texts"))
def _(spark, sf):
    return cell_texts(spark, sf).select(
        "src", "id", ct.is_no_data(F.array(F.lit("td")), F.col("text")).alias("hit"))


def _tags(names) -> Column:
    return F.array(*[F.lit(n) for n in names])


@query("detail_type", ex.with_(ex.TEXTS, body=f"SELECT src, id, {ex.DETAIL} AS detail FROM texts"))
def _(spark, sf):
    return cell_texts(spark, sf).select(
        "src", "id", ct.detail_type(_tags(["td"]), F.col("text")).alias("detail"))


_LINKED = ex.DETAIL.replace("ELSE 'STRING'", "ELSE 'LINK'").replace(
    f"WHEN {ex.HIT['no_data']} THEN 'NO_DATA'", "")


@query("link_cells", ex.with_(ex.TEXTS, body=f"SELECT src, id, {_LINKED} AS detail FROM texts"))
def _(spark, sf):
    """The same texts inside a link: an empty link is no empty cell."""
    return cell_texts(spark, sf).select(
        "src", "id", ct.detail_type(_tags(["td", "a", "b"]), F.col("text")).alias("detail"))


@query("string_and_other_cells", ex.with_(ex.TEXTS, body="SELECT src, id, 'OTHER' AS detail FROM texts"))
def _(spark, sf):
    """The same texts beside a list: whatever they say, the cell has its own structure."""
    return cell_texts(spark, sf).select(
        "src", "id", ct.detail_type(_tags(["td", "ul", "li"]), F.col("text")).alias("detail"))


@query("coarse_type", ex.with_(ex.TEXTS, body=f"SELECT src, id, {ex.coarse('detail')} AS type FROM "
       f"(SELECT src, id, {ex.DETAIL} AS detail FROM texts)"))
def _(spark, sf):
    detail = ct.detail_type(_tags(["td"]), F.col("text"))
    return (cell_texts(spark, sf).withColumn("detail", detail)
            .select("src", "id", ct.coarse_type(F.col("detail")).alias("type")))


_COMPACT = f"regexp_replace(text, '[{ex._S}]+', '', 'g')"
_NUMBER = "CASE " + " ".join(
    f"WHEN {ex.matches([p])} THEN TRY_CAST({reading} AS DOUBLE)" for p, reading in zip(
        fixed.DIMENSION_PATTERNS, [
            _COMPACT, f"replace({_COMPACT}, ',', '.')", _COMPACT, f"replace({_COMPACT}, ',', '.')",
            f"replace({_COMPACT}, ',', '.')", f"replace({_COMPACT}, ',', '')",
            f"replace(replace({_COMPACT}, '.', ''), ',', '.')"])) + " END"


@query("parse_dimension", ex.with_(ex.TEXTS, body=f"SELECT src, id, {_NUMBER} AS number FROM texts"))
def _(spark, sf):
    return cell_texts(spark, sf).select("src", "id", ct.parse_dimension(F.col("text")).alias("number"))


@query("cell_value", ex.with_(ex.TEXTS, body=f"SELECT src, id, CASE WHEN {ex.DETAIL} = 'DIMENSION' THEN "
       f"{_NUMBER} END AS number FROM texts"))
def _(spark, sf):
    detail = ct.detail_type(_tags(["td"]), F.col("text"))
    return (cell_texts(spark, sf).withColumn("detail", detail)
            .select("src", "id", ct.cell_value(F.col("detail"), F.col("text")).alias("number")))


_DETAILS = "['BUTTON','DATE','MONEY','STRING','LINK','NO_DATA','DIMENSION']"


@query("types_compatible", f"""SELECT event_id, a = b OR a = 'NO_DATA' OR b = 'NO_DATA' OR
(a IN ('LINK','STRING') AND b IN ('LINK','STRING')) AS hit FROM (SELECT event_id,
{_DETAILS}[event_id % 7 + 1] AS a, {_DETAILS}[user_id % 7 + 1] AS b FROM events)""")
def _(spark, sf):
    names = F.array(*[F.lit(d) for d in _DETAILS.strip("[]").replace("'", "").split(",")])
    return (rendered.load(spark, sf, "events")
            .withColumn("a", names[(F.col("event_id") % 7).cast("int")])
            .withColumn("b", names[(F.col("user_id") % 7).cast("int")])
            .select("event_id", ct.types_compatible(F.col("a"), F.col("b")).alias("hit")))


@query("summable_types", ex.with_(ex.TEXTS, body=f"SELECT src, id, {ex.DETAIL} IN ('DIMENSION', 'MONEY', "
       "'PERCENT', 'MEASUREMENT') AS hit FROM texts"))
def _(spark, sf):
    detail = ct.detail_type(_tags(["td"]), F.col("text"))
    return (cell_texts(spark, sf).withColumn("detail", detail)
            .select("src", "id", ct.is_summable(F.col("detail")).alias("hit")))


# ------------------------------------------------------------------ grid
def cells_of(spark, sf, *kinds) -> DataFrame:
    return tables.extract_cells(tables_of(spark, sf, *kinds))


@query("place_cells", on_grids("page_id, row, col, rowspan, colspan, text"))
def _(spark, sf):
    return grid.place_cells(cells_of(spark, sf, *GRID_KINDS)).select(
        "page_id", "row", "col", "rowspan", "colspan", "text")


_SLOTS = """(SELECT page_id, row + dr AS row, col + dc AS col, text FROM (
  SELECT *, unnest(range(rowspan)) AS dr FROM {0}), (VALUES (0),(1),(2)) AS w(dc) WHERE dc < colspan)"""


@query("cover", ex.with_(DOC, CUS, body=f"SELECT * FROM {_SLOTS.format('doc_c')} UNION ALL "
                         f"SELECT * FROM {_SLOTS.format('cus_c')}"))
def _(spark, sf):
    return grid.slots(grid.cover(cells_of(spark, sf, "document", "customer"))).select(
        "page_id", "row", "col", "text")


@query("cell_at", ex.with_(CUS, body=f"""SELECT a.page_id, a.row, a.col, s.text FROM (
SELECT c_custkey * 4 + 2 AS page_id, r AS row, k AS col FROM customer, range(5) AS r(r), range(5) AS k(k)) a
LEFT JOIN {_SLOTS.format('cus_c')} s ON s.page_id = a.page_id AND s.row = a.row AND s.col = a.col"""))
def _(spark, sf):
    """Every slot of every customer table, and the slots just outside."""
    asked = (rendered.customer_pages(spark, sf).select("page_id", F.lit(0).alias("table_idx"))
             .withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(4))))
             .withColumn("col", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(4).cast("bigint")))))
    return grid.cell_at(grid.cover(cells_of(spark, sf, "customer")), asked).select(
        "page_id", "row", "col", "text")


@query("table_size", ex.with_(DOC, body="""
SELECT page_id, 2 + n + nb AS height, 5 AS width FROM doc_t
UNION ALL SELECT o_orderkey * 4 + 1, 5, 2 FROM orders
UNION ALL SELECT c_custkey * 4 + 2, 4, 4 FROM customer"""))
def _(spark, sf):
    return grid.table_size(cells_of(spark, sf, *GRID_KINDS)).select("page_id", "height", "width")


@query("column_above", ex.with_(CUS, body="""SELECT a.page_id, a.row, a.src_idx AS idx,
string_agg(b.text, ' > ' ORDER BY b.row) AS above FROM cus_c a JOIN cus_c b ON a.page_id = b.page_id
AND b.row < a.row AND b.col <= a.col AND a.col < b.col + b.colspan GROUP BY ALL"""))
def _(spark, sf):
    cells = stored(cells_of(spark, sf, "customer"), "cells")
    return grid.column_above(cells, grid.cover(cells)).select(
        "page_id", F.col("src_row").alias("row"), F.col("src_idx").alias("idx"),
        F.array_join("texts", " > ").alias("above"))


@query("row_left", ex.with_(CUS, body="""SELECT a.page_id, a.row, a.src_idx AS idx,
string_agg(b.text, ' > ' ORDER BY b.col) AS "left" FROM cus_c a JOIN cus_c b ON a.page_id = b.page_id
AND b.col < a.col AND b.row <= a.row AND a.row < b.row + b.rowspan GROUP BY ALL"""))
def _(spark, sf):
    cells = stored(cells_of(spark, sf, "customer"), "cells")
    return grid.row_left(cells, grid.cover(cells)).select(
        "page_id", F.col("src_row").alias("row"), F.col("src_idx").alias("idx"),
        F.array_join("texts", " > ").alias("left"))


@query("transpose", on_grids("", select="page_id, col AS row, row AS col, colspan AS rowspan, "
                             "rowspan AS colspan, text"))
def _(spark, sf):
    return grid.transpose(cells_of(spark, sf, *GRID_KINDS)).select(
        "page_id", "row", "col", "rowspan", "colspan", "text")


@query("flip", on_grids("", select="page_id, src_row, max(src_idx) OVER (PARTITION BY page_id, src_row) "
                        "- src_idx AS src_idx, text"))
def _(spark, sf):
    return tables.extract_cells(grid.flip(tables_of(spark, sf, *GRID_KINDS))).select(
        "page_id", "src_row", "src_idx", "text")


@query("original_spans", on_grids("page_id, row, col, rowspan, colspan"))
def _(spark, sf):
    """Spans as declared, after the structure check has counted its own copies down."""
    return roles_of(spark, sf, *GRID_KINDS).select("page_id", "row", "col", "rowspan", "colspan")


@query("ordered_rows", ex.with_(DOC, body="SELECT page_id, src_row, string_agg(text, ' | ' ORDER BY src_idx) "
       "AS texts FROM doc_c GROUP BY ALL"))
def _(spark, sf):
    return grid.ordered_rows(cells_of(spark, sf, "document")).select(
        "page_id", "src_row", F.array_join("texts", " | ").alias("texts"))


@query("cells_by_role", on_grids("page_id, row, col, text, role"))
def _(spark, sf):
    cells = roles_of(spark, sf, *GRID_KINDS)
    return cells.select("page_id", "row", "col", "text", "role")


# ------------------------------------------------------------------ structure check
def on_events(select: str, where: str = "TRUE") -> str:
    return ex.with_(EV, body=f"SELECT {select} FROM ev WHERE {where}")


@query("too_small", on_events("page_id, table_idx, v = 10 AS hit", "status <> 'bad_span'"))
def _(spark, sf):
    found = tables_of(spark, sf, "event").where("status = 'ok'")
    return found.select(*TABLE_KEY, verdict.too_small(F.col("rows")).alias("hit"))


def role_counts(spark, sf, *roles) -> DataFrame:
    return (roles_of(spark, sf, "event").groupBy(*TABLE_KEY)
            .agg(*[F.count_if(F.col("role") == r).alias(f"n_{r}") for r in roles]))


@query("head_block", on_events("page_id, table_idx, titles AS n_title", "verdict = 'genuine'"))
def _(spark, sf):
    return role_counts(spark, sf, "title")


@query("head_close", on_events("page_id, table_idx, message", "v IN (9, 11) AND verdict = 'LayoutError'"))
def _(spark, sf):
    """Tables turned down because their first data row does not meet the header."""
    told = verdict.verdicts(judged_of(spark, sf, "event"))
    starts = [fixed.VERDICT_TEXTS[k].split("{")[0] for k in ("close_short", "close_left")]
    test = F.lit(False)
    for start in starts:
        test = test | F.col("message").startswith("LayoutError: " + start)
    return told.where(test).select(*TABLE_KEY, "message")


@query("section_dividers", ex.with_(EV, body="SELECT page_id, table_idx, 'Part one' AS text FROM ev WHERE v = 14"))
def _(spark, sf):
    """Titles as wide as their table that stand below its first row."""
    return roles_of(spark, sf, "event").where(
        "role = 'title' AND p_row > 0 AND p_colspan = width AND orientation = 'top'") \
        .select(*TABLE_KEY, "text")


@query("data_region", on_events("page_id, table_idx, data AS n_data", "verdict = 'genuine'"))
def _(spark, sf):
    return role_counts(spark, sf, "data")


@query("split_parents", ex.with_(EV, body="SELECT page_id, table_idx, 'data' AS role FROM ev WHERE v = 20 "
       "UNION ALL SELECT page_id, table_idx, 'sidebar' FROM ev WHERE v = 20"))
def _(spark, sf):
    """Two cells sharing the width of one cell above them: attribute and data."""
    widest = F.max("colspan").over(Window.partitionBy(*TABLE_KEY))
    return (roles_of(spark, sf, "event").withColumn("widest", widest)
            .where("widest = 2 AND width = 3 AND height = 3 AND row = 2 AND col < 2")
            .select(*TABLE_KEY, "role"))


@query("merged_parents", ex.with_(EV, body="SELECT page_id, table_idx, 'plain' AS text, 'sidebar' AS role FROM ev WHERE v = 21"))
def _(spark, sf):
    """Attributes that cover several columns of attributes above them."""
    return roles_of(spark, sf, "event").where(
        "role = 'sidebar' AND colspan = 2 AND col = 0 AND row > 2").select(*TABLE_KEY, "text", "role")


@query("column_type_check", ex.with_(EV, body="SELECT page_id, table_idx, message FROM ev WHERE verdict = 'DataTypeError'"))
def _(spark, sf):
    return verdict.verdicts(judged_of(spark, sf, "event")).where("verdict = 'DataTypeError'") \
        .select(*TABLE_KEY, "message")


@query("total_rows", ex.with_(DOC, EV, body="""
SELECT page_id, 0 AS table_idx, row, col, text FROM doc_c WHERE role = 'result'
UNION ALL SELECT page_id, table_idx, 3, 0, 'alone' FROM ev WHERE v = 17
UNION ALL SELECT page_id, table_idx, 3, 2, cents::VARCHAR FROM ev WHERE v = 17"""))
def _(spark, sf):
    return grid.by_role(roles_of(spark, sf, "document", "event"), "result").select(
        *TABLE_KEY, "row", "col", "text")


@query("sidebar_block", on_events("page_id, table_idx, sidebars AS n_sidebar", "verdict = 'genuine'"))
def _(spark, sf):
    return role_counts(spark, sf, "sidebar")


@query("bottom_overrun", on_events("page_id, table_idx, message", "v = 8"))
def _(spark, sf):
    told = verdict.verdicts(judged_of(spark, sf, "event"))
    return told.where(F.col("message").contains("выходит за пределы по вертикали")) \
        .select(*TABLE_KEY, "message")


@query("classify_structure", ex.with_(EV, body="""
SELECT page_id, table_idx, verdict, message, orientation, status FROM ev
UNION ALL SELECT doc_id * 4, 0, 'genuine', NULL, 'top', 'ok' FROM documents
UNION ALL SELECT o_orderkey * 4 + 1, 0, 'genuine', NULL, 'left', 'ok' FROM orders
UNION ALL SELECT c_custkey * 4 + 2, 0, 'genuine', NULL, 'top', 'ok' FROM customer"""))
def _(spark, sf):
    return verdict.verdicts(judged_of(spark, sf)).drop("kind")


@query("is_genuine", on_events("page_id, table_idx, verdict = 'genuine' AS genuine"))
def _(spark, sf):
    return judged_of(spark, sf, "event").select(*TABLE_KEY, verdict.is_genuine().alias("genuine"))


@query("simple_grid_verdict", ex.with_(EV, body="""
SELECT page_id, table_idx, verdict, message, orientation FROM ev WHERE plain
UNION ALL SELECT o_orderkey * 4 + 1, 0, 'genuine', NULL, 'left' FROM orders"""))
def _(spark, sf):
    return verdict.simple_grid_verdict(judged_of(spark, sf, "event", "order")).select(
        *TABLE_KEY, "verdict", "message", "orientation")


@query("role_completeness", ex.with_(DOC, ORD, CUS, EV, body="""
SELECT page_id, count(*) AS n_cells, 0 AS n_unclassified FROM (SELECT page_id FROM doc_c UNION ALL
SELECT page_id FROM ord_c UNION ALL SELECT page_id FROM cus_c) GROUP BY page_id UNION ALL
SELECT page_id, (titles + sidebars + data + results)::BIGINT, 0 FROM ev WHERE verdict = 'genuine'"""))
def _(spark, sf):
    """Cells of every genuine table, and how many of them have no role: none may."""
    cells = stored(roles_of(spark, sf).select(*TABLE_KEY, "role"), "roles")
    left = verdict.unclassified(cells).groupBy(*TABLE_KEY).agg(
        F.count("*").alias("n"))
    all_ = cells.groupBy(*TABLE_KEY).agg(F.count("*").alias("n_cells"))
    return all_.join(unsent(left), TABLE_KEY, "left").select(
        "page_id", "n_cells", F.coalesce("n", F.lit(0)).alias("n_unclassified"))


# ------------------------------------------------------------------ paths and links
@query("page_and_parse_places", ex.with_(ORD, CUS, body="""
SELECT page_id, row, col, col AS p_row, row AS p_col FROM ord_c
UNION ALL SELECT page_id, row, col, row, col FROM cus_c"""))
def _(spark, sf):
    return roles_of(spark, sf, "order", "customer").select("page_id", "row", "col", "p_row", "p_col")


@query("header_paths", on_grids("page_id, row, col, header"))
def _(spark, sf):
    return pathed_of(spark, sf, *GRID_KINDS).select(
        "page_id", "row", "col", joined("header_path").alias("header"))


@query("sidebar_paths", on_grids("page_id, row, col, sidebar"))
def _(spark, sf):
    return pathed_of(spark, sf, *GRID_KINDS).select(
        "page_id", "row", "col", joined("sidebar_path").alias("sidebar"))


@query("parent_edges", ex.with_(DOC, CUS, body="""
SELECT page_id, role, row, col, text, 'Block ' || (b + 1) AS parent FROM doc_c WHERE role = 'sidebar' AND col = 1
UNION ALL SELECT page_id, role, row, col, text, 'Account' FROM cus_c WHERE role = 'title' AND row = 1
UNION ALL SELECT page_id, role, row, col, text, sidebar FROM cus_c WHERE role = 'sidebar' AND col = 1"""))
def _(spark, sf):
    found = stored(pathed_of(spark, sf, "document", "customer"), "pathed")
    parent = found.select(*TABLE_KEY, F.col("cell_no").alias("parent_no"), F.col("text").alias("parent"))
    return links.edges(found).join(unsent(parent), [*TABLE_KEY, "parent_no"]).select(
        "page_id", "role", "row", "col", "text", "parent")


@query("title_data", ex.with_(DOC, ORD, CUS, body="""
SELECT page_id, unnest(string_split(header, ' > ')) AS title, row, col FROM (
SELECT page_id, header, row, col, role FROM doc_p UNION ALL SELECT page_id, header, row, col, role FROM ord_c
UNION ALL SELECT page_id, header, row, col, role FROM cus_c) WHERE role = 'data'"""))
def _(spark, sf):
    return links.title_data(pathed_of(spark, sf, *GRID_KINDS)).select("page_id", "title", "row", "col")


@query("total_links", ex.with_(DOC, EV, body="""
SELECT page_id, total_row, total_col, data_row, total_col AS data_col FROM doc_links
UNION ALL SELECT page_id, 3, 2, r, 2 FROM ev, (VALUES (1),(2)) AS x(r) WHERE v = 17"""))
def _(spark, sf):
    found = stored(pathed_of(spark, sf, "document", "event"), "pathed")
    return links.total_links(found).select(
        "page_id", F.col("total.row").alias("total_row"), F.col("total.col").alias("total_col"),
        F.col("data.row").alias("data_row"), F.col("data.col").alias("data_col"))


@query("related_cells", ex.with_(DOC, body="""
SELECT page_id, row, col, header || CASE WHEN sidebar <> '' THEN ' > ' ELSE '' END || sidebar AS related
FROM doc_p WHERE role IN ('sidebar', 'data') UNION ALL
SELECT page_id, row, col, '' FROM doc_p WHERE role = 'title'"""))
def _(spark, sf):
    return (pathed_of(spark, sf, "document").where("role <> 'result'")
            .select("page_id", "row", "col", F.array_join(F.transform(
                links.related(), lambda n: n["text"]), " > ").alias("related")))


@query("related_cells_and_totals", ex.with_(DOC, ORD, body="""
SELECT p.page_id, p.row, p.col, CASE WHEN role = 'title' THEN '' WHEN role = 'result' THEN coalesce(summed, '')
  WHEN role = 'sidebar' AND col = 0 THEN '0:0' ELSE '0:' || col || ' ' || (1 + 6 * b) || ':0' ||
  CASE WHEN col = 1 OR t.n % 5 = 1 THEN '' ELSE ' ' || row || ':1' END END AS related
FROM doc_p p JOIN doc_t t USING (page_id) LEFT JOIN (SELECT page_id, total_row AS row, total_col AS col,
  string_agg(data_row || ':' || total_col, ' ' ORDER BY data_row) AS summed FROM doc_links GROUP BY ALL) s USING (page_id, row, col)
UNION ALL SELECT page_id, row, col, CASE WHEN col = 1 THEN row || ':0' ELSE '' END FROM ord_c"""))
def _(spark, sf):
    """Cells of every role, totals with what they sum."""
    found = stored(pathed_of(spark, sf, "document", "order"), "pathed")
    shown_ = F.transform("related", lambda c: F.concat_ws(":", c["row"].cast("string"), c["col"].cast("string")))
    return links.related_cells(found, links.total_links(found)).select(
        "page_id", "row", "col", F.array_join(shown_, " ").alias("related"))


@query("last_type_above", ex.with_(DOC, body="""
SELECT page_id, row, col, last_value(CASE WHEN detail <> 'NO_DATA' THEN detail END IGNORE NULLS) OVER (
PARTITION BY page_id, col ORDER BY row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS above FROM doc_c"""))
def _(spark, sf):
    cells = tables.extract_cells(typed_of(spark, sf, "document"))
    return cells.select("page_id", "row", "col", links.last_filled_above().alias("above"))


@query("previous_total", ex.with_(DOC, body="""
SELECT page_id, 1 + e + b AS line, CASE WHEN b > 0 THEN 5 * b + b END AS previous FROM doc_b
UNION ALL SELECT page_id, 1 + n + nb, NULL FROM doc_t"""))
def _(spark, sf):
    return links.previous_total(roles_of(spark, sf, "document")).select("page_id", "line", "previous")


# ------------------------------------------------------------------ features and audits
_SHARES = ", ".join(f"{f}::DOUBLE / n_cells AS {f}" for f in fixed.FEATURES)
_DOC_TYPES = """SELECT page_id, count(*) FILTER (detail = 'DIMENSION') / count(*) AS numeric, 0.0 AS form,
count(*) FILTER (detail = 'STRING') / count(*) AS string, 0.0 AS media, 0.0 AS other,
count(*) FILTER (detail = 'NO_DATA') / count(*) AS no_data, 0.0 AS link FROM doc_c GROUP BY page_id"""


@query("type_fractions", ex.with_(DOC, EV, body=f"""
SELECT page_id, table_idx, {_SHARES} FROM ev WHERE status <> 'bad_span'
UNION ALL SELECT page_id, 0, numeric, form, string, media, other, no_data, link FROM ({_DOC_TYPES})"""))
def _(spark, sf):
    found = typed_of(spark, sf, "event", "document").where("status = 'ok'")
    return features.type_fractions(found).select(*TABLE_KEY, *fixed.FEATURES)


@query("consistency", on_events("page_id, table_idx, CASE WHEN verdict = 'genuine' THEN 1 ELSE -1 END "
                                "AS consistency", "status = 'ok'"))
def _(spark, sf):
    return features.features(judged_of(spark, sf, "event")).select(*TABLE_KEY, "consistency")


@query("feature_failures", on_events("page_id, table_idx, message AS failure", "status <> 'ok'"))
def _(spark, sf):
    return features.feature_failures(judged_of(spark, sf, "event")).select(*TABLE_KEY, "failure")


@query("types_under_headers", ex.with_(DOC, body="""
SELECT page_id, header AS title, string_agg(DISTINCT detail, ',' ORDER BY detail) AS types,
bool_and(detail IN ('DIMENSION', 'NO_DATA')) AS summable, count(*) AS n_data
FROM doc_p WHERE role = 'data' GROUP BY ALL"""))
def _(spark, sf):
    return links.header_types(pathed_of(spark, sf, "document")).select(
        "page_id", "title", listed(F.col("types")).alias("types"), "summable", "n_data")


def verdicts_of_records(spark, sf) -> DataFrame:
    records = records_of(spark, sf)
    return audit.record_verdicts(records, verdict.judge(tables.labelled_pages(records)))


@query("label_join", ex.with_(EV, LAB, body="SELECT key, verification, verdict, message FROM lab_v"))
def _(spark, sf):
    return verdicts_of_records(spark, sf).select("key", "verification", "verdict", "message")


_CONFUSION = """SELECT count(*) FILTER (p AND h) AS tp, count(*) FILTER (NOT p AND NOT h) AS tn,
count(*) FILTER (p AND NOT h) AS fp, count(*) FILTER (NOT p AND h) AS fn
FROM (SELECT verdict = 'genuine' AS p, verification = 'genuine' AS h FROM lab_v)"""


@query("confusion_counts", ex.with_(EV, LAB, body=_CONFUSION))
def _(spark, sf):
    return audit.confusion(verdicts_of_records(spark, sf), "verdict")


@query("precision_recall", ex.with_(EV, LAB, body=f"""SELECT tp, tn, fp, fn, round(tp / (tp + fp), 6) AS precision,
round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM ({_CONFUSION})"""))
def _(spark, sf):
    return audit.scores(audit.confusion(verdicts_of_records(spark, sf), "verdict"))


@query("class_balance", ex.with_(EV, LAB, body="""SELECT sum(c)::BIGINT AS n, max(c) AS largest, min(c) AS smallest,
max(c) / min(c) AS ratio, max(c) / sum(c) AS majority_accuracy FROM (
SELECT verification, count(*) AS c FROM lab_v GROUP BY verification)"""))
def _(spark, sf):
    return audit.class_balance(records_of(spark, sf))


@query("matrix_digest", ex.with_(EV, body="""SELECT count(*) FILTER (status = 'ok') + (SELECT count(*) FROM documents)
+ (SELECT count(*) FROM orders) + (SELECT count(*) FROM customer) AS n, TRUE AS same, FALSE AS same_after_change FROM ev"""))
def _(spark, sf):
    """The digest of all features: the same in another order, another one after one change."""
    rows = stored(features.features(judged_of(spark, sf)).where("status = 'ok'"), "features")
    first = features.matrix_digest(rows)
    other = features.matrix_digest(rows.repartition(13, "numeric", "page_id"))
    changed = features.matrix_digest(rows.withColumn("form", F.when(
        F.col("page_id") == rows.agg(F.min("page_id")).first()[0], 0.25).otherwise(F.col("form"))))

    def digest(df, name):
        return df.select("n", F.struct("digest_xor", "digest_sum").alias(name))
    return (digest(first, "a").join(digest(other, "b"), "n").join(digest(changed, "c"), "n")
            .select("n", (F.col("a") == F.col("b")).alias("same"), (F.col("a") == F.col("c")).alias("same_after_change")))


@query("audit_totals", ex.with_(DOC, EV, body="""
SELECT page_id, total_row AS row, total_col AS col, any_value(stated)::DOUBLE AS stated,
sum(CASE WHEN NOT empty THEN value END)::DOUBLE AS summed, count(*) AS n_cells,
any_value(stated)::DOUBLE - sum(CASE WHEN NOT empty THEN value END)::DOUBLE AS diff FROM doc_links GROUP BY ALL
UNION ALL SELECT page_id, 3, 2, cents, 2 * cents, 2, -cents FROM ev WHERE v = 17"""))
def _(spark, sf):
    found = stored(pathed_of(spark, sf, "document", "event"), "pathed")
    return links.audit_totals(links.total_links(found)).drop("table_idx")


@query("page_summary", ex.with_(EV, body="""
SELECT page_id * 4 + 1000000000 AS page_id, 0 AS tables, 0 AS genuine FROM pages UNION ALL
SELECT event_id * 4 + 3, count(s.v), count(*) FILTER (s.verdict = 'genuine')
FROM events LEFT JOIN shapes s ON s.v = event_id % 24 GROUP BY event_id"""))
def _(spark, sf):
    """Rendered pages and the given ones, which hold no tables."""
    given = tables.read_pages(spark, f"{sf}/pages.parquet").select(
        (F.col("page_id") * 4 + 1000000000).alias("page_id"), "url", "html")
    pages = rendered.event_pages(spark, sf).drop("kind").unionByName(given)
    return audit.page_summary(pages, verdict.verdicts(verdict.judge(pages)))


@query("verdict_breakdown", ex.with_(EV, body="""SELECT verdict, sum(n)::BIGINT AS n FROM (
SELECT verdict, count(*) AS n FROM ev GROUP BY verdict UNION ALL
SELECT 'genuine', (SELECT count(*) FROM documents) + (SELECT count(*) FROM orders)
+ (SELECT count(*) FROM customer)) GROUP BY verdict"""))
def _(spark, sf):
    return audit.verdict_breakdown(verdict.verdicts(judged_of(spark, sf)))


_EV_FEATURES = f"feat AS (SELECT page_id, table_idx, verdict, {_SHARES} FROM ev WHERE status = 'ok')"
_PAIRS = [(a, b) for i, a in enumerate(fixed.FEATURES) for b in fixed.FEATURES[i + 1:]]


@query("feature_correlation", ex.with_(EV, _EV_FEATURES, body=" UNION ALL ".join(
    f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, round(CASE WHEN var_pop({a}) > 1e-12 AND "
    f"var_pop({b}) > 1e-12 THEN corr({a}, {b}) END, 9) AS r FROM feat WHERE verdict = 'genuine'"
    for a, b in _PAIRS)))
def _(spark, sf):
    return features.correlations(features.features(judged_of(spark, sf, "event"))) \
        .withColumn("r", F.round("r", 9))


@query("mismatch_audit", ex.with_(EV, LAB, body="""SELECT key, name, CASE WHEN verdict = 'genuine' THEN 'FP' ELSE 'FN'
END AS mismatch, CASE WHEN verdict <> 'genuine' THEN verdict || ': ' || message END AS reason
FROM lab_v WHERE (verdict = 'genuine') <> (verification = 'genuine')"""))
def _(spark, sf):
    return audit.mismatches(verdicts_of_records(spark, sf))


def two_runs(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Verdicts of a corpus before and after: some tables lost their rows, some pages
    their tables, some pages went, some came."""
    pages = rendered.event_pages(spark, sf).withColumn("event_id", F.expr("(page_id - 3) div 4"))
    before = verdict.verdicts(verdict.judge(pages.where("event_id % 10 <> 9")))
    changed = F.when(F.col("event_id") % 5 == 0, "<p>gone</p>") \
        .when(F.col("event_id") % 4 == 1, F.replace("html", F.lit("</tr><tr>"), F.lit(""))) \
        .otherwise(F.col("html"))
    after = verdict.verdicts(verdict.judge(pages.where("event_id % 10 <> 8").withColumn("html", changed)))
    return before, after


_DIFF = f"""SELECT page_id, table_idx, was, now FROM (SELECT page_id, table_idx,
CASE WHEN event_id % 10 = 9 THEN '{fixed.MISSING_RECORD}' ELSE verdict END AS was,
CASE WHEN event_id % 10 = 8 OR event_id % 5 = 0 THEN '{fixed.MISSING_RECORD}' WHEN event_id % 4 = 1 THEN
  CASE WHEN v = 12 THEN 'error' WHEN v = 11 AND table_idx = 0 THEN 'TitleTypeError' ELSE 'LayoutError' END
  ELSE verdict END AS now FROM ev) WHERE was <> now"""


@query("snapshot_diff", ex.with_(EV, body=_DIFF))
def _(spark, sf):
    return audit.snapshot_diff(*two_runs(spark, sf), TABLE_KEY, "verdict")


@query("first_differences", ex.with_(EV, body=_DIFF + " ORDER BY page_id, table_idx LIMIT 25"))
def _(spark, sf):
    diff = audit.snapshot_diff(*two_runs(spark, sf), TABLE_KEY, "verdict")
    return audit.first_differences(diff, TABLE_KEY, 25)


# ------------------------------------------------------------------ order, sets
@query("stratified_folds", ex.with_(EV, LAB, body="""SELECT key, verification, ((row_number() OVER (
PARTITION BY verification ORDER BY md5(key || '/42')) - 1) % 5)::INT AS fold FROM lab_v"""))
def _(spark, sf):
    from ..functions.ranking import stratified_folds
    records = stored(records_of(spark, sf).select("key", "verification"), "records")
    return stratified_folds(records, "verification", "key")


@query("ordered_cells", ex.with_(DOC, body="""SELECT page_id, row, col, row_number() OVER (
PARTITION BY page_id ORDER BY row, col) AS place FROM doc_c"""))
def _(spark, sf):
    return cells_of(spark, sf, "document").orderBy(*TABLE_KEY, "row", "col").select(
        "page_id", "row", "col", F.row_number().over(
            Window.partitionBy(*TABLE_KEY).orderBy("row", "col")).alias("place"))


@query("label_union", ex.with_(EV, LAB, body="""SELECT verification AS label FROM lab_v
UNION SELECT verdict FROM lab_v"""))
def _(spark, sf):
    found = verdicts_of_records(spark, sf)
    return audit.all_labels(found.select(F.col("verification").alias("label")), found.select("verdict"))


@query("distinct_in_order", """SELECT doc_id, string_agg(line, chr(10) ORDER BY place) AS lines FROM (
SELECT doc_id, line, min(place) AS place FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
generate_subscripts(string_split(text, chr(10)), 1) AS place FROM documents) GROUP BY doc_id, line) GROUP BY doc_id""")
def _(spark, sf):
    """Distinct lines of a document, first ones kept in their order, as grids list distinct cells."""
    return rendered.load(spark, sf, "documents").select(
        "doc_id", F.array_join(F.array_distinct(F.split("text", "\n")), "\n").alias("lines"))


@query("type_subset", ex.with_(DOC, body="""SELECT page_id, header AS title,
bool_and(detail IN ('DIMENSION', 'MONEY', 'PERCENT', 'MEASUREMENT', 'NO_DATA')) AS subset
FROM doc_p WHERE role = 'data' GROUP BY ALL"""))
def _(spark, sf):
    allowed = F.array(*[F.lit(t) for t in fixed.SUMMABLE_TYPES + ["NO_DATA"]])
    return links.header_types(pathed_of(spark, sf, "document")).select(
        "page_id", "title", (F.size(F.array_except("types", allowed)) == 0).alias("subset"))


# ------------------------------------------------------------------ descriptions and export
_SAY = fixed.ROLE_TEXTS
_QUOTED = "'\"' || replace({0}, ' > ', '\" / \"') || '\"'"
_HINTS = f"""CASE role WHEN 'title' THEN CASE WHEN header <> '' THEN '{fixed.HINT_SUBTITLE}' || {_QUOTED.format('header')} || ' | ' ELSE '' END || '{_SAY['title']}'
WHEN 'result' THEN CASE WHEN detail = 'STRING' THEN '{fixed.HINT_TOTAL_LABEL}' WHEN detail = 'DIMENSION' THEN
'{fixed.HINT_TOTAL_COUNT}' || k || ' | {fixed.HINT_TOTAL}' ELSE '{_SAY['result']}' END
ELSE '{fixed.HINT_TITLE}' || {_QUOTED.format('header')} || ' | ' || CASE WHEN sidebar <> '' THEN
CASE role WHEN 'sidebar' THEN '{fixed.HINT_SUBATTRIBUTE}' ELSE '{fixed.HINT_ATTRIBUTE}' END || {_QUOTED.format('sidebar')} || ' | ' ELSE '' END
|| CASE role WHEN 'sidebar' THEN '{_SAY['sidebar']}' ELSE '{_SAY['data']}' END END"""
_COUNTED = """SELECT p.*, CASE WHEN p.role = 'result' THEN (CASE WHEN p.b IS NULL THEN t.n ELSE bl.k END) END AS k
FROM doc_p p JOIN doc_t t ON t.page_id = p.page_id LEFT JOIN doc_b bl ON bl.page_id = p.page_id AND bl.b = p.b"""


def described_of(spark, sf, *kinds) -> DataFrame:
    return export.described(stored(pathed_of(spark, sf, *kinds), "pathed"))


@query("quoted_paths", on_grids("", select="page_id, row, col, CASE WHEN header <> '' THEN "
                                + _QUOTED.format("header") + " ELSE '' END AS quoted"))
def _(spark, sf):
    return pathed_of(spark, sf, *GRID_KINDS).select(
        "page_id", "row", "col", export.quoted_path("header_path").alias("quoted"))


@query("hint_lines", ex.with_(DOC, body=f"SELECT page_id, row, col, {_HINTS} AS lines FROM ({_COUNTED})"))
def _(spark, sf):
    return described_of(spark, sf, "document").select(
        "page_id", "row", "col", F.array_join("lines", " | ").alias("lines"))


@query("type_lines", ex.with_(CUS, body=f"""SELECT page_id, row, col, CASE WHEN role <> 'title' THEN
'{fixed.TYPE_LINE}' || detail ELSE '{fixed.TYPES_LINE}' || CASE text WHEN 'Account' THEN 'MONEY, STRING'
WHEN 'Balance' THEN 'MONEY' WHEN 'Segment' THEN 'STRING' ELSE '{fixed.TYPES_LINE_EMPTY}' END END AS line FROM cus_c"""))
def _(spark, sf):
    return described_of(spark, sf, "customer").select(
        "page_id", "row", "col", F.col("types_line").alias("line"))


_RECORD = f"""'{{"row":' || row || ',"col":' || col || ',"rowspan":' || rowspan || ',"colspan":' || colspan ||
',"text":"' || text || '","role":"' || role || '","type":"' || {ex.coarse('detail')} || '","detail_type":"' || detail ||
'","header_path":[' || CASE WHEN header <> '' THEN '"' || replace(header, ' > ', '","') || '"' ELSE '' END ||
'],"sidebar_path":[' || CASE WHEN sidebar <> '' THEN '"' || replace(sidebar, ' > ', '","') || '"' ELSE '' END || ']'"""


@query("cell_records", ex.with_(DOC, body=f"""
SELECT page_id, row, col, {_RECORD} || CASE WHEN role = 'result' THEN ',"aggregates":[' ||
coalesce(cells, '') || ']' ELSE '' END || '}}' AS record
FROM doc_p LEFT JOIN (SELECT page_id AS pid, total_row, total_col,
string_agg('[' || data_row || ',' || total_col || ']', ',' ORDER BY data_row) AS cells
FROM doc_links GROUP BY ALL) ON pid = page_id AND total_row = row AND total_col = col"""))
def _(spark, sf):
    return described_of(spark, sf, "document").select(
        "page_id", "row", "col", F.to_json(export.cell_record()).alias("record"))


@query("header_forests", ex.with_(DOC, ORD, CUS, shown.SUP, shown.FORESTS, body="SELECT page_id, header, sidebar FROM forests"))
def _(spark, sf):
    """Pages of up to three levels of headers and of attributes."""
    pages = pages_of(spark, sf, *GRID_KINDS).unionByName(rendered.supplier_pages(spark, sf))
    return export.forests(stored(links.paths(verdict.roles(verdict.judge(pages))), "pathed")).select(
        "page_id", "header", "sidebar")


@query("page_sources", "SELECT page_id, url, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title', 1) AS title FROM pages")
def _(spark, sf):
    return export.page_sources(tables.read_pages(spark, f"{sf}/pages.parquet"))


_ORDER_DOC = f"""SELECT page_id, '{{"format":"genuine-table/1","source":{{"url":"https://example.org/order/' ||
(page_id - 1) // 4 || '","title":"order","index":0}},"orientation":"left","size":{{"rows":5,"cols":2}},"header":[' ||
string_agg('{{"text":"' || text || '","cell":[' || row || ',0],"children":[]}}', ',' ORDER BY row) FILTER (col = 0) ||
'],"sidebar":[],"cells":[' || string_agg({_RECORD} || '}}', ',' ORDER BY row, col) || ']}}' AS document
FROM ord_c GROUP BY page_id"""


@query("write_export", ex.with_(ORD, body=_ORDER_DOC))
def _(spark, sf):
    """Documents as written to and read back from text files."""
    pages = rendered.order_pages(spark, sf)
    found = stored(links.paths(verdict.roles(verdict.judge(pages))), "pathed")
    made = export.export_documents(found, export.page_sources(pages))
    path = work_folder(spark, "export")
    export.write_export(made, path)
    back = spark.read.text(path)
    order = F.regexp_extract("value", r"/order/(\d+)", 1).cast("long") * 4 + 1
    return back.select(order.alias("page_id"), F.col("value").alias("document"))


@query("export_documents", ex.with_(DOC, ORD, CUS, shown.SUP, shown.FORESTS, shown.CELLS, body=shown.documents(_RECORD)))
def _(spark, sf):
    """Documents with spans, nested headers and attributes, totals and what they sum."""
    pages = pages_of(spark, sf, *GRID_KINDS).unionByName(rendered.supplier_pages(spark, sf))
    found = stored(links.paths(verdict.roles(verdict.judge(pages))), "pathed")
    return export.export_documents(found, export.page_sources(pages)).select("page_id", "document")


_FILL = " ".join(f"WHEN '{r}' THEN '{c}'" for r, c in fixed.SHEET_FILL.items() if r)


@query("sheet_layout", ex.with_(DOC, body=f"""SELECT page_id, 'Таблица_1' AS sheet, row + 1 AS row, col + 1 AS col,
text AS value, CASE WHEN rowspan > 1 OR colspan > 1 THEN chr(65 + col::INT) || (row + 1) || ':' ||
chr(64 + (col + colspan)::INT) || (row + rowspan) END AS merge, CASE role {_FILL} END AS fill,
CASE WHEN role = 'data' THEN 'FFFFFF' END AS font, 'thin' AS border FROM doc_c"""))
def _(spark, sf):
    return export.sheet_layout(roles_of(spark, sf, "document")).drop("table_idx")


@query("sheet_layout_plain", ex.with_(CUS, body="""SELECT page_id, row + 1 AS row, col + 1 AS col, text AS value,
NULL::VARCHAR AS fill FROM cus_c"""))
def _(spark, sf):
    return export.sheet_layout(roles_of(spark, sf, "customer"), coloured=False).select(
        "page_id", "row", "col", "value", "fill")


def _td(i: int, row: int, text: str) -> str:
    style = fixed.PAGE_STYLE["title" if i == 0 else "data"]
    return f"'<td style=\"{style}\">' || {text} || '</td>'"


_CARD = " || ".join(
    f"'<tr>' || {_td(0, r, repr(k))} || {_td(1, r, t)} || '</tr>'" for r, (k, t) in enumerate([
        ("Placed", "strftime(o_orderdate, '%Y-%m-%d')"), ("Customer", "'Customer no ' || o_custkey"),
        ("Status", "'<i>' || o_orderstatus || '</i>'"), ("Price", ex.sql_money("o_totalprice")),
        ("Priority", "o_orderpriority")]))


@query("annotate_pages", f"""SELECT o_orderkey * 4 + 1 AS page_id, 1 AS tables, 1 AS genuine,
'<html><head><title>order</title></head><body><p>order</p><table title="{fixed.PAGE_GENUINE_TITLE}" style="{fixed.PAGE_GENUINE_STYLE}">' ||
{_CARD} || '</table></body></html>' AS html FROM orders""")
def _(spark, sf):
    pages = rendered.order_pages(spark, sf)
    return export.annotate_pages(pages, stored(verdict.judge(pages), "judged")).select(
        "page_id", "tables", "genuine", "html")


@query("annotate_all_pages", ex.with_(DOC, ORD, CUS, EV, body=shown.PAINTED))
def _(spark, sf):
    """Every kind of page, with accepted, rejected, nested and unreadable tables, and pages without any."""
    pages = pages_of(spark, sf)
    return export.annotate_pages(pages, stored(verdict.judge(pages), "judged")).select(
        "page_id", "tables", "genuine", "html")


@query("annotate_counts", ex.with_(EV, body="""SELECT event_id * 4 + 3 AS page_id, count(s.v) AS tables,
count(*) FILTER (s.verdict = 'genuine') AS genuine FROM events LEFT JOIN shapes s ON s.v = event_id % 24 GROUP BY event_id"""))
def _(spark, sf):
    pages = rendered.event_pages(spark, sf)
    return export.annotate_pages(pages, stored(verdict.judge(pages), "judged")).select(
        "page_id", "tables", "genuine")


# ------------------------------------------------------------------ models
def learning_rows(spark, sf) -> DataFrame:
    return runs.labelled_features(records_of(spark, sf))


def answers(model, rows) -> DataFrame:
    return model.predict(rows).groupBy("verification", "consistency", "prediction").count()


@query("label_encoding", ex.with_(EV, LAB, body="""SELECT key, verification,
CASE WHEN verification = 'genuine' THEN 0.0 ELSE 1.0 END::DOUBLE AS target FROM lab_v"""))
def _(spark, sf):
    records = stored(records_of(spark, sf).select("key", "verification"), "records")
    return learn.encoder(records).transform(records)


@query("class_weights", ex.with_(EV, LAB, body="""SELECT verification, c AS n_class,
sum(c) OVER () / (count(*) OVER () * c) AS weight FROM (
SELECT verification, count(*) AS c FROM lab_v GROUP BY verification)"""))
def _(spark, sf):
    return learn.class_weights(records_of(spark, sf))


@query("gated_predict")
def _(spark, sf):
    rows = learning_rows(spark, sf)
    return answers(learn.fit("Logistic Regression", rows), rows)


@query("gated_rejections", ex.with_(EV, LAB, body="""SELECT page_id, 'no genuine' AS prediction FROM (
SELECT event_id AS page_id, verification FROM lab WHERE verification <> 'None') l JOIN (
SELECT event_id, status, verdict, table_idx FROM ev) e ON e.event_id = l.page_id
WHERE table_idx = 0 AND status = 'ok' AND verdict <> 'genuine'"""))
def _(spark, sf):
    """Whatever the model, tables the rule turned down are answered at once."""
    rows = learning_rows(spark, sf)
    model = learn.fit("Logistic Regression", rows)
    return model.predict(rows).where("consistency = -1").select(
        F.col("key").cast("long").alias("page_id"), "prediction")


for _name, _title in [("random_forest", "Random Forest"), ("boosted_trees", "XGBoost"),
                      ("rbf_machine", "SVM (RBF)"), ("logistic_regression", "Logistic Regression")]:
    @query(_name)
    def _(spark, sf, title=_title):
        rows = learning_rows(spark, sf)
        return answers(learn.fit(title, rows), rows)


@query("save_and_load_model", ex.with_(EV, LAB, body="""SELECT count(*) AS n, 0 AS differing FROM lab_v l
JOIN ev ON ev.event_id = l.event_id WHERE ev.table_idx = 0 AND ev.status = 'ok'"""))
def _(spark, sf):
    rows = learning_rows(spark, sf)
    model = learn.fit("Logistic Regression", rows)
    path = work_folder(spark, "model")
    model.save(path)
    again = learn.GatedModel.load(path)
    both = model.predict(rows).join(again.predict(rows).select(
        *TABLE_KEY, F.col("prediction").alias("again")), TABLE_KEY)
    return both.agg(F.count("*").alias("n"),
                    F.count_if(F.col("prediction") != F.col("again")).alias("differing"))


#: Trees of a boosted model in the queries; its preset has 200.
FEW_TREES = 12


def _boosted(name: str):
    def predictions(spark, sf):
        """Every labelled table with the answer of one kind of boosted trees."""
        rows = learning_rows(spark, sf)
        return answers(learn.fit(name, rows, maxIter=FEW_TREES), rows)
    return predictions


for _name, _model in (("boosting_by_level", "XGBoost"), ("boosting_by_leaf", "LightGBM"), ("boosting_symmetric", "CatBoost")):
    query(_name)(_boosted(_model))


#: Fewer trees than the presets have, for ``ranked_models``, so that it ends in minutes.
QUICK = {"Random Forest": {"numTrees": 20, "maxDepth": 6}, **{name: {"maxIter": 4} for name in ("XGBoost", "LightGBM", "CatBoost")}}


@query("cross_validation")
def _(spark, sf):
    """Six models by five folds, each with all the trees of its preset."""
    return learn.cross_validate(learning_rows(spark, sf))


@query("cross_validation_summary")
def _(spark, sf):
    return learn.summary(learn.cross_validate(learning_rows(spark, sf), ["Logistic Regression"]))


@query("ranked_models")
def _(spark, sf):
    """All six by their weighted F1."""
    return learn.ranked(learn.summary(learn.cross_validate(learning_rows(spark, sf), settings=QUICK)))


@query("permutation_importance")
def _(spark, sf):
    return learn.permutation_importance(learning_rows(spark, sf), "Logistic Regression")


@query("train_and_score")
def _(spark, sf):
    model = runs.train(records_of(spark, sf), "Logistic Regression")
    scored = runs.score(pages_of(spark, sf), model)
    return scored.groupBy("kind", "verdict", "prediction").count()


def snapshot_of(spark, records, model, **options) -> dict[str, DataFrame]:
    path = work_folder(spark, "snapshot")
    snapshots.write_snapshot(records, model, path, **options)
    return snapshots.read_snapshot(spark, path)


def records_and_model(spark, sf):
    records = stored(records_of(spark, sf, labelled_only=False), "records")
    return records, runs.train(records.where("verification <> 'None'"), "Logistic Regression")


@query("write_snapshot", ex.with_(EV, LAB, body=f"""SELECT 'rule' AS stage, tp, tn, fp, fn,
round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall,
round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM ({_CONFUSION})"""))
def _(spark, sf):
    """The rule's scores as a snapshot keeps them."""
    return snapshot_of(spark, *records_and_model(spark, sf))["metrics"].where("stage = 'rule'")




def record_key() -> Column:
    """The key of a record, which its page is known by, behind its file's name."""
    return F.regexp_extract("page_id", "#([^#]*)$", 1)


_SHARES = "concat_ws(' ', " + ", ".join(f"round(1000000 * {f}::DOUBLE / n_cells)::BIGINT" for f in fixed.FEATURES) + \
    ", CASE WHEN verdict = 'genuine' THEN 1 ELSE -1 END)"
_HELD = "(SELECT * FROM ev WHERE table_idx = 0 AND event_id % 19 <> 0)"
_GATED = "CASE WHEN {} THEN 'by the model' ELSE 'no genuine' END"


@query("snapshot_parts", ex.with_(EV, LAB, body=f"""
SELECT 'verdicts' AS part, key, verdict || ' ' || coalesce(message, '') AS value FROM lab_v
UNION ALL SELECT 'features', event_id::VARCHAR, {_SHARES} FROM {_HELD} WHERE status = 'ok'
UNION ALL SELECT 'failures', event_id::VARCHAR, message FROM {_HELD} WHERE status <> 'ok'
UNION ALL SELECT 'predictions', event_id::VARCHAR, {_GATED.format("verdict = 'genuine'")} FROM {_HELD} WHERE status = 'ok'
UNION ALL SELECT 'metrics', 'rule', concat_ws(' ', tp, tn, fp, fn) FROM ({_CONFUSION})
UNION ALL SELECT 'metrics', 'rule and model', concat_ws(' ', count(*) FILTER (verification = 'genuine'), count(*))
  FROM lab JOIN {_HELD} h ON h.event_id = lab.event_id WHERE verification <> 'None' AND status = 'ok'
UNION ALL SELECT 'digest', 'records', count(*)::VARCHAR FROM lab
UNION ALL SELECT 'tree', 'verdicts', count(*)::VARCHAR FROM lab_v
UNION ALL SELECT 'tree', 'features', count(*)::VARCHAR FROM {_HELD} WHERE status = 'ok'
UNION ALL SELECT 'tree', 'predictions', count(*)::VARCHAR FROM {_HELD} WHERE status = 'ok'
UNION ALL SELECT 'tree', 'failures', count(*)::VARCHAR FROM {_HELD} WHERE status <> 'ok'"""))
def _(spark, sf):
    """All that a snapshot holds; SQL cannot state the model's own answers, so those are only named as such,
    and of its scores the true and all cases are counted."""
    held = snapshot_of(spark, *records_and_model(spark, sf))
    shares = F.concat_ws(" ", *[F.round(F.col(f) * 1000000).cast("long").cast("string") for f in fixed.FEATURES],
                         F.col("consistency").cast("string"))
    counts = F.when(F.col("stage") == "rule", F.concat_ws(" ", "tp", "tn", "fp", "fn")).otherwise(
        F.concat_ws(" ", F.col("tp") + F.col("fn"), F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")))
    gated = held["predictions"].join(unsent(held["features"].select(*TABLE_KEY, "consistency")), TABLE_KEY, "left").withColumn(
        "value", F.when(F.col("consistency") == 1, "by the model").otherwise(F.col("prediction")))
    shown_ = [("verdicts", held["verdicts"], record_key(), F.concat("verdict", F.lit(" "), F.coalesce("message", F.lit("")))),
              ("features", held["features"], record_key(), shares), ("failures", held["failures"], record_key(), F.col("failure")),
              ("predictions", gated, record_key(), F.col("value")), ("metrics", held["metrics"], F.col("stage"), counts),
              ("digest", held["digest"], F.lit("records"), F.col("records").cast("string")),
              ("tree", held["tree"].where("bucket = -1"), F.col("part"), F.col("n").cast("string"))]
    out = None
    for part, rows, key, value in shown_:
        rows = rows.select(F.lit(part).alias("part"), key.alias("key"), value.alias("value"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("compare_snapshots", "SELECT '' AS part, '' AS key, '' AS was, '' AS now WHERE FALSE")
def _(spark, sf):
    """A run compared with itself, taken twice from the start."""
    records, model = records_and_model(spark, sf)
    return snapshots.compare_snapshots(snapshot_of(spark, records, model), snapshot_of(spark, records, model))


_GONE, _BARE = "event_id % 83 = 5", "event_id % 83 = 11"        # records left out, records that lose their table
_LEFT = f"(SELECT * FROM {_HELD} WHERE {_GONE} OR {_BARE})"


@query("changed_snapshots", ex.with_(EV, LAB, body=f"""
SELECT 'verdicts' AS part, key, verdict AS was, CASE WHEN {_GONE} THEN '{fixed.MISSING_RECORD}' ELSE 'LayoutError' END AS now
FROM lab_v WHERE {_GONE} OR {_BARE} AND verdict <> 'LayoutError'
UNION ALL SELECT 'features', event_id::VARCHAR, '', '{fixed.MISSING_RECORD}' FROM {_LEFT} WHERE status = 'ok'
UNION ALL SELECT 'failures', event_id::VARCHAR, message, '{fixed.MISSING_RECORD}' FROM {_LEFT} WHERE status <> 'ok'
UNION ALL SELECT 'predictions', event_id::VARCHAR, {_GATED.format("verdict = 'genuine'")}, '{fixed.MISSING_PREDICTION}'
FROM {_LEFT} WHERE status = 'ok'"""))
def _(spark, sf):
    """A run compared with one over fewer records, of which some lost their tables, in half as many buckets."""
    records, model = records_and_model(spark, sf)
    event = F.col("key").cast("long") % 83
    fewer = records.where(event != 5).withColumn("html_text", F.when(event == 11, "<p>none</p>").otherwise(F.col("html_text")))
    before = snapshot_of(spark, records, model, buckets=32)
    diff = snapshots.compare_snapshots(before, snapshot_of(spark, fewer, model, buckets=16))
    rule = before["features"].select(F.concat_ws("/", *TABLE_KEY).alias("key"), "consistency")
    was = (F.when(F.col("part") == "features", "").when((F.col("part") == "predictions") & (F.col("consistency") == 1), "by the model")
           .otherwise(F.col("was")))
    return diff.where("part <> 'metrics'").join(unsent(rule), "key", "left").select(
        "part", F.regexp_extract("key", "#([^#/]*)(?:/0)?$", 1).alias("key"), was.alias("was"), "now")


@query("analyze", ex.with_(EV, body=f"""
SELECT page_id, table_idx, verdict = 'genuine' AS passed, CASE WHEN verdict = 'genuine' THEN NULL
WHEN verdict = 'error' THEN '{fixed.PROGRAM_ERROR_TEXT}' || message ELSE message END AS reason,
CASE WHEN verdict = 'genuine' THEN n_cells END AS n_cells FROM ev UNION ALL
SELECT event_id * 4 + 3, NULL, FALSE, '{fixed.NO_TABLE_TEXT}', NULL FROM events WHERE event_id % 24 = 13"""))
def _(spark, sf):
    """Answers on every table and on pages without one, and how many cells the export states."""
    pages = rendered.event_pages(spark, sf)
    judged = stored(verdict.judge(pages), "judged")
    found = stored(links.paths(verdict.roles(judged)), "pathed")
    answered = export.analyze(judged, export.described(found), export.export_documents(
        found, export.page_sources(pages)))
    cells = F.size(F.from_json("export", "cells array<string>")["cells"])
    return export.without_tables(pages, answered).select(
        "page_id", "table_idx", F.col("genuine").alias("passed"), "reason",
        F.when(F.col("export").isNotNull(), cells).alias("n_cells"))


@query("analyze_with_model")
def _(spark, sf):
    """The same with the model's answer on what the rule passed, cells numbered as a browser does."""
    pages = rendered.event_pages(spark, sf)
    numbered = F.array_join(F.transform(F.split("html", "<td>"), lambda part, i: F.concat(
        F.when(i > 0, F.concat(F.lit('<td data-gt-id="'), i.cast("string"), F.lit('">')))
        .otherwise(""), part)), "")
    pages = pages.withColumn("html", numbered)
    judged = stored(verdict.judge(pages), "judged")
    found = stored(links.paths(verdict.roles(judged)), "pathed")
    model = runs.train(records_of(spark, sf), "Logistic Regression")
    accepted = model.predict(features.features(judged))
    return (export.analyze(judged, export.described(found), export.export_documents(
        found, export.page_sources(pages)), accepted)
        .select("page_id", "table_idx", "genuine", "reason", F.size("cells").alias("n_cells"),
                F.char_length("export").alias("chars")))


# ------------------------------------------------------------------ streaming
@query("score_stream", ex.with_(EV, body="SELECT page_id, table_idx, verdict, message, orientation, status, "
                                        "TRUE AS answered FROM ev"))
def _(spark, sf):
    """Pages arrive as files; what leaves must be what the batch run says, with the model's answer on
    every table, which is no for all that the rule turned down."""
    source, out = work_folder(spark, "incoming"), work_folder(spark, "scored")
    rendered.event_pages(spark, sf).drop("kind").write.parquet(source)
    model = runs.train(records_of(spark, sf), "Logistic Regression")
    stream = streaming.read_page_stream(spark, source, files_per_batch=4)
    streaming.score_stream(stream, model, out, work_folder(spark, "stream")).awaitTermination()
    answered = F.when(F.col("verdict") == "genuine", F.col("prediction").isin(
        fixed.GENUINE_LABEL, fixed.NOT_GENUINE_LABEL)).otherwise(F.col("prediction") == fixed.NOT_GENUINE_LABEL)
    return spark.read.parquet(out).select(
        *TABLE_KEY, "verdict", "message", "orientation", "status", answered.alias("answered"))
