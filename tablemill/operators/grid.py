"""The page grid: which cell covers which slots, kept as intervals, and views of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import TABLE_KEY


def place_cells(cells: DataFrame) -> DataFrame:
    """Top-left slot and effective spans of each cell, clipped at the table's bottom."""
    return cells.select(
        *TABLE_KEY, "src_row", "src_idx", "row", "col",
        F.least(F.greatest("rowspan", F.lit(1)), F.col("height") - F.col("row"))
        .alias("rowspan"),
        F.greatest("colspan", F.lit(1)).alias("colspan"), "text")


#: Slots that one array of ``slots`` holds at most; a wider cell is cut.
CUT = 4096


def cover(cells: DataFrame) -> DataFrame:
    """Every line of every cell, as the interval of columns [col, right] it covers there.

    A cell is at most as high as its table, whose bottom clips it; its width is
    only a number, whatever it is.
    """
    bottom = F.least(F.col("row") + F.greatest("rowspan", F.lit(1)), F.col("height")) - 1
    return cells.select(
        *TABLE_KEY, "overlaps", F.explode(F.sequence("row", bottom.cast("int"))).alias("row"), "col",
        (F.col("col") + F.greatest("colspan", F.lit(1)) - 1).alias("right"), "src_row", "src_idx", "text")


def _last(rows: DataFrame, *place: str) -> DataFrame:
    """Of overlapping cells the later one takes a slot; only tables known to overlap pay for it."""
    names = ["src_row", "src_idx", "text"]
    out = [*TABLE_KEY, *place, *names]
    settled = (rows.where("overlaps").groupBy(*TABLE_KEY, *place)
               .agg(F.max_by(F.struct(*names), F.struct("src_row", "src_idx")).alias("c"))
               .select(*TABLE_KEY, *place, "c.*"))
    return rows.where("NOT overlaps").select(*out).unionByName(settled)


def slots(covered: DataFrame) -> DataFrame:
    """Every slot with its cell. A wide cell is dealt out piece by piece, never as one array."""
    cut = F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(right - col) div {CUT}"))).alias("_cut")
    pieces = covered.select("*", cut)
    first = F.col("col") + F.col("_cut") * CUT
    last = F.least(first + (CUT - 1), F.col("right"))
    return _last(pieces.withColumn("_slot", F.explode(F.sequence(first, last))).drop("col")
                 .withColumnRenamed("_slot", "col"), "row", "col")


def _disjoint(covered: DataFrame) -> DataFrame:
    """Intervals of a line of which no two share a column; of overlapping cells the later one takes it.

    In tables known to overlap, a line is cut wherever a cell begins or ends, and each stretch goes to the
    last of its cells.
    """
    out = [*TABLE_KEY, "row", "col", "right", "cell"]
    rows = covered.withColumn("cell", F.struct("src_row", "src_idx", "text"))
    lapped = rows.where("overlaps")
    borders = lapped.groupBy(*TABLE_KEY, "row").agg(F.array_union(
        F.collect_set("col"), F.collect_set(F.col("right") + 1)).alias("_borders"))
    settled = (lapped.join(borders, [*TABLE_KEY, "row"])
               .withColumn("_at", F.explode(F.filter("_borders", lambda b: (b >= F.col("col")) & (b <= F.col("right")))))
               .groupBy(*TABLE_KEY, "row", F.col("_at"))
               .agg(F.max_by(F.struct("right", "cell"), F.struct("cell.src_row", "cell.src_idx")).alias("c"))
               .select(*TABLE_KEY, "row", F.col("_at").alias("col"), "c.*"))
    return rows.where("NOT overlaps").select(*out).unionByName(settled.select(*out))


def cell_at(covered: DataFrame, asked: DataFrame) -> DataFrame:
    """The cell covering each asked-for slot; null where the row is shorter.

    A line's intervals and the slots asked for there are read in one stream from
    left to right, with the interval that began last: it is the only one that
    can reach a slot. No slot is written out and none meets the other intervals of its line.
    """
    place = [F.col("row").cast("long").alias("_row"), F.col("col").cast("long").alias("_col")]
    begun = _disjoint(covered).select(*TABLE_KEY, *place, F.struct("right", "cell").alias("_begun"),
                                      F.lit(None).alias("_asked"))
    wanted = asked.select(*TABLE_KEY, *place, F.lit(None).alias("_begun"), F.struct(*asked.columns).alias("_asked"))
    # at one place the interval comes first
    across = (Window.partitionBy(*TABLE_KEY, "_row").orderBy("_col", F.col("_asked").isNotNull())
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    met = (begun.unionByName(wanted).withColumn("_met", F.last("_begun", ignorenulls=True).over(across))
           .where(F.col("_asked").isNotNull()))
    cell = F.when(F.col("_met.right") >= F.col("_col"), F.col("_met.cell"))
    return met.select("_asked.*", cell.alias("_c")).select(*asked.columns, "_c.src_row", "_c.src_idx", "_c.text")


def table_size(cells: DataFrame) -> DataFrame:
    """Height and width of each table's grid. Partial sums first: one row per table moves."""
    return cells.groupBy(*TABLE_KEY).agg(
        F.max("height").alias("height"),
        F.max(F.col("col") + F.greatest("colspan", F.lit(1))).alias("width"))


def _seen_from(targets: DataFrame, met: DataFrame, line: str, place: str) -> DataFrame:
    """Cells met on a target's own line before its place; ``met`` has one row for each line and cell.

    Cells and targets are read in one stream along the line, which counts the cells so far; a target then
    takes so many from the front of its line's list. The lists are as long as the lines they come from.
    """
    cells = (met.groupBy(*TABLE_KEY, "_line", "src_row", "src_idx")
             .agg(F.min("place").cast("long").alias("place"), F.first("text").alias("text")))
    wanted = targets.select(*TABLE_KEY, F.col(line).alias("_line"), F.col(place).cast("long").alias("place"),
                            F.struct("src_row", "src_idx").alias("_target"))
    along = Window.partitionBy(*TABLE_KEY, "_line").orderBy("place").rangeBetween(Window.unboundedPreceding, -1)
    stream = cells.select(*TABLE_KEY, "_line", "place", F.lit(None).alias("_target")).unionByName(wanted)
    counted = (stream.withColumn("_n", F.count_if(F.col("_target").isNull()).over(along).cast("int"))
               .where(F.col("_target").isNotNull() & (F.col("_n") > 0)))
    lists = cells.groupBy(*TABLE_KEY, "_line").agg(
        F.array_sort(F.collect_list(F.struct("place", "text"))).alias("found"))
    return (counted.join(lists, [*TABLE_KEY, "_line"])
            .select(*TABLE_KEY, "_target.src_row", "_target.src_idx",
                    F.transform(F.slice("found", F.lit(1), F.col("_n")), lambda x: x["text"]).alias("texts")))


def column_above(targets: DataFrame, covered: DataFrame) -> DataFrame:
    """For each asked-for cell the distinct cells above its left column, top to bottom.

    Cells are dealt to the columns that are asked for, not to all they cover.
    """
    columns = targets.groupBy(*TABLE_KEY).agg(F.collect_set("col").alias("_columns"))
    wide = (covered.join(columns, TABLE_KEY)
            .withColumn("_line", F.explode(F.filter(
                "_columns", lambda c: (c >= F.col("col")) & (c <= F.col("right"))))))
    met = _last(wide, "_line", "row").withColumnRenamed("row", "place")
    return _seen_from(targets, met, "col", "row")


def row_left(targets: DataFrame, covered: DataFrame) -> DataFrame:
    """For each asked-for cell the distinct cells left of it on its top row.

    A cell counts where it begins; where cells overlap, one that shows no slot there is
    still met.
    """
    met = covered.select(*TABLE_KEY, F.col("row").alias("_line"), F.col("col").alias("place"),
                         "src_row", "src_idx", "text")
    return _seen_from(targets, met, "row", "col")


def transpose(cells: DataFrame) -> DataFrame:
    """Swap the axes. What lies past the first row's width is lost, and so is a cell that shows in
    no slot: without height or width, or covered by later ones."""
    return (cells.where(F.col("shown_col").isNotNull() & (F.col("shown_col") < F.col("first_width")))
            .select(*TABLE_KEY, F.col("shown_col").alias("row"),
                    F.col("shown_row").cast("bigint").alias("col"), F.col("colspan").alias("rowspan"),
                    F.col("rowspan").alias("colspan"), "text"))


def flip(tables: DataFrame) -> DataFrame:
    """Reverse the order of the cells in every row."""
    return tables.withColumn("rows", F.transform("rows", lambda r: F.reverse(r)))


def ordered_rows(cells: DataFrame) -> DataFrame:
    """The texts of each source row in order. A row's cells come from one record."""
    return (cells.groupBy(*TABLE_KEY, "src_row")
            .agg(F.array_sort(F.collect_list(F.struct("src_idx", "text"))).alias("r"))
            .select(*TABLE_KEY, "src_row", F.transform("r", lambda c: c["text"]).alias("texts")))


def by_role(role_cells: DataFrame, role: str) -> DataFrame:
    return role_cells.where(F.col("role") == role)
