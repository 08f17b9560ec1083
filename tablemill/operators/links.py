"""Headers above, attributes beside, totals and the cells they sum.

A table is one record of the source, so its cells can never outgrow a record.
The path windows therefore run with the cells of a table kept together: one
shuffle on the table key serves every window below it (``colocate``). Without
it each window shuffles on its own finer key, which spreads a giant table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cell_types import cell_value, is_summable
from ..sources.tables import TABLE_KEY
from .store import unsent


def _node() -> Column:
    return F.struct(F.col("cell_no").alias("no"), "row", "col", "text", "gt_id")


def _path(cells: DataFrame, role: str, places: Column, at: list[Column], name: str) -> DataFrame:
    """For each cell the ``role`` cells met before it on its line, in order.

    Cells of that role also stand, as ghosts, on every line they cover.
    ``places`` are structs (line, order); ``at`` is the cell's own pair.
    """
    place = "struct<line:bigint,pos:bigint,node:struct<no:int,row:int,col:bigint,text:string,gt_id:string>>"
    own = F.struct(at[0].cast("bigint").alias("line"), at[1].cast("bigint").alias("pos"),
                   F.lit(None).alias("node")).cast(place)
    ghosts = F.when(F.col("role") == role, F.transform(places, lambda s: F.struct(
        s[0].cast("bigint").alias("line"), s[1].cast("bigint").alias("pos"),
        _node().alias("node")).cast(place)))
    before = (Window.partitionBy(*TABLE_KEY, "_at.line").orderBy("_at.pos")
              .rangeBetween(Window.unboundedPreceding, -1))
    stood = F.concat(F.array(own), F.coalesce(ghosts, F.array().cast(f"array<{place}>")))
    return (cells.withColumn("_at", F.explode(stood))
            .withColumn(name, F.collect_list("_at.node").over(before))
            .where(F.col("_at.node").isNull()).drop("_at"))


def paths(role_cells: DataFrame, colocate: bool = True) -> DataFrame:
    """Role cells with ``header_path`` and ``sidebar_path``, outermost first."""
    cells = role_cells.repartition(*TABLE_KEY) if colocate else role_cells
    above = F.transform("covers", lambda s: F.array(s["col"], s["first"].cast("bigint")))
    beside = F.transform("beside", lambda s: F.array(s["line"].cast("bigint"), s["first"]))
    cells = _path(cells, "title", above, [F.col("p_col"), F.col("p_row")], "header_path")
    return _path(cells, "sidebar", beside, [F.col("p_row"), F.col("p_col")], "sidebar_path")


def nearest(path: str) -> Column:
    return F.try_element_at(F.col(path), F.lit(-1))


def edges(pathed: DataFrame) -> DataFrame:
    """(parent, child) among headers and among attributes."""
    parent = F.when(F.col("role") == "title", nearest("header_path")) \
        .when(F.col("role") == "sidebar", nearest("sidebar_path"))
    return (pathed.withColumn("parent", parent).where(F.col("parent").isNotNull())
            .select(*TABLE_KEY, "role", F.col("parent.no").alias("parent_no"),
                    F.col("parent.row").alias("parent_row"),
                    F.col("parent.col").alias("parent_col"),
                    F.col("cell_no").alias("child_no"), "row", "col", "text"))


def title_data(pathed: DataFrame) -> DataFrame:
    """(title, data cell) for every title in a data cell's path."""
    return (pathed.where(F.col("role") == "data")
            .select(*TABLE_KEY, "cell_no", "row", "col", "detail",
                    F.explode("header_path").alias("t"))
            .select(*TABLE_KEY, F.col("t.no").alias("title_no"), F.col("t.row").alias("title_row"),
                    F.col("t.col").alias("title_col"), F.col("t.text").alias("title"),
                    "cell_no", "row", "col", "detail"))


def header_types(pathed: DataFrame) -> DataFrame:
    """Distinct detail types under each title (at most 16 per title)."""
    return (title_data(pathed)
            .groupBy(*TABLE_KEY, "title_no", "title_row", "title_col", "title")
            .agg(F.sort_array(F.collect_set("detail")).alias("types"),
                 F.bool_and(is_summable(F.col("detail")) | (F.col("detail") == "NO_DATA"))
                 .alias("summable"), F.count("*").alias("n_data")))


def total_signatures(role_cells: DataFrame) -> DataFrame:
    """Result cells on each line they cover, with the start and width of that line's label."""
    label = F.when((F.col("detail") == "STRING") & (F.col("line") == F.col("p_row")),
                   F.struct(F.col("p_col").alias("col"), F.col("p_colspan").alias("width")))
    return (role_cells.where(F.col("role") == "result")
            .withColumn("line", F.explode(F.transform("beside", lambda b: b["line"])))
            .withColumn("signature", F.min(label).over(
                Window.partitionBy(*TABLE_KEY, "line"))))


def total_links(pathed: DataFrame) -> DataFrame:
    """(total, summed cell) pairs.

    A total sums the data cells above it in its column, up to a title or to the
    total before it whose label starts and spans alike. Read upwards, each data
    cell belongs, once per kind of label, to the first total met below it; so
    every cell is looked at once per kind, and no pair is formed to be dropped.
    Pass a stored table: titles, totals and data are picked from it separately.
    """
    numbers_only = is_summable(F.col("detail")) | (F.col("detail") == "NO_DATA")
    # data cells with the same titles are put together before these are listed: a row per column, not per cell
    summable = (pathed.where(F.col("role") == "data")
                .groupBy(*TABLE_KEY, F.transform("header_path", lambda t: t["no"]).alias("titles"))
                .agg(F.bool_and(numbers_only).alias("summable"))
                .select(*TABLE_KEY, F.explode("titles").alias("title_no"), "summable")
                .groupBy(*TABLE_KEY, "title_no").agg(F.bool_and("summable").alias("summable")))
    cell = F.struct(F.col("cell_no").alias("no"), "row", "col", "text", "detail", "gt_id",
                    F.col("p_row").alias("line"))
    totals = total_signatures(pathed.withColumn("title_no", nearest("header_path")["no"]))
    counts = ((F.col("type") == "GENUINE") & F.col("title_no").isNotNull()
              & F.coalesce("summable", F.lit(True)))
    nothing = F.struct(F.lit(None).cast("struct<no:int,row:int,col:bigint,text:string,"
                       "detail:string,gt_id:string,line:int>").alias("total"))

    result_events = (
        totals.where(F.col("signature").isNotNull())
        .join(unsent(summable), [*TABLE_KEY, "title_no"], "left")
        .withColumn("counts", counts).withColumn("cell", cell)
        .select(*TABLE_KEY, "cell", "counts", "signature", "p_col", "p_row", "line",
                F.explode("covers").alias("s"))
        .select(*TABLE_KEY, F.col("s.col").alias("column"), "signature", F.col("line").alias("at"),
                F.struct(F.when(F.col("counts") & (F.col("s.col") == F.col("p_col"))
                                & (F.col("line") == F.col("p_row")), F.col("cell"))
                         .alias("total")).alias("event"),
                F.lit(None).alias("data")))
    others = (
        pathed.where(F.col("role").isin("data", "title"))
        .withColumn("cell", cell)
        .select(*TABLE_KEY, "cell", "role", "covers", F.explode("signatures").alias("signature"))
        .select(*TABLE_KEY, "cell", "role", "signature", F.explode("covers").alias("s"))
        .select(*TABLE_KEY, F.col("s.col").alias("column"), "signature",
                F.col("s.last").alias("at"),
                F.when(F.col("role") == "title", nothing).alias("event"),
                F.when(F.col("role") == "data", F.col("cell")).alias("data")))
    below = (Window.partitionBy(*TABLE_KEY, "column", "signature").orderBy(F.desc("at"))
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (others.unionByName(result_events)
            .withColumn("met", F.last("event", ignorenulls=True).over(below))
            .where(F.col("data").isNotNull() & F.col("met.total").isNotNull())
            .select(*TABLE_KEY, F.col("met.total").alias("total"), "data"))


def total_contents(links: DataFrame) -> DataFrame:
    """Each total with the cells it sums, top to bottom as read: part of its export."""
    return (links.groupBy(*TABLE_KEY, F.col("total.no").alias("cell_no"))
            .agg(F.array_sort(F.collect_list(F.struct(
                F.col("data.line").alias("line"), F.col("data.row").alias("row"),
                F.col("data.col").alias("col"), F.col("data.gt_id").alias("gt_id"))))
                .alias("summed")))


def audit_totals(links: DataFrame) -> DataFrame:
    """Stated totals against the sum of what they cover, where both are plain numbers."""
    stated = cell_value(F.col("total.detail"), F.col("total.text"))
    value = cell_value(F.col("data.detail"), F.col("data.text"))
    return (links.withColumn("stated", stated).withColumn("value", value)
            .groupBy(*TABLE_KEY, F.col("total.row").alias("row"), F.col("total.col").alias("col"))
            .agg(F.first("stated").alias("stated"), F.sum("value").alias("summed"),
                 F.count("*").alias("n_cells"))
            .where(F.col("stated").isNotNull())
            .withColumn("diff", F.col("stated") - F.col("summed")))


def last_filled_above() -> Column:
    """The last non-empty type above a cell in its column, as the column check carries it."""
    down = (Window.partitionBy(*TABLE_KEY, "col").orderBy("row")
            .rowsBetween(Window.unboundedPreceding, -1))
    return F.last(F.when(F.col("detail") != "NO_DATA", F.col("detail")), ignorenulls=True).over(down)


def previous_total(role_cells: DataFrame) -> DataFrame:
    """Each total label with the line of the total before it labelled alike."""
    label = (F.col("line") == F.col("p_row")) & (F.col("detail") == "STRING")
    before = Window.partitionBy(*TABLE_KEY, "signature").orderBy("line")
    return (total_signatures(role_cells).where(label)
            .withColumn("previous", F.lag("line").over(before)))


def related_cells(pathed: DataFrame, links: DataFrame) -> DataFrame:
    """Each cell with ``related``, the (row, col) of the cells highlighted with it: its headers and attributes,
    or, for a total, what it sums."""
    def places(cells: Column) -> Column:
        return F.transform(cells, lambda c: F.struct(c["row"].cast("long").alias("row"), c["col"].cast("long").alias("col")))
    nothing = F.array().cast("array<struct<row:bigint,col:bigint>>")
    return (pathed.join(unsent(total_contents(links)), [*TABLE_KEY, "cell_no"], "left")
            .withColumn("related", F.coalesce(F.when(F.col("role") == "result", places(F.col("summed")))
                                              .otherwise(places(related())), nothing)).drop("summed"))


def related() -> Column:
    """Cells highlighted with a cell, by role; totals take theirs from ``total_links``."""
    return (F.when(F.col("role") == "title", F.col("header_path"))
            .when(F.col("role").isin("sidebar", "data"),
                  F.concat("header_path", "sidebar_path")))
