"""Sources: saved pages, labelled records, and the tables and cells in them."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_type

from .. import fixed
from ..functions import cell_types
from . import columns, json_map

TABLE_KEY = ["page_id", "table_idx"]


@F.arrow_udf(from_arrow_type(columns.ARROW_TABLES))
def html_tables(html: pa.Array) -> pa.Array:
    """Tables of each page; the only place where markup is read."""
    return columns.batch_tables(html)


# One run per page: a copy pushed into a filter would read the markup twice.
html_tables = html_tables.asNondeterministic()


def read_pages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Saved pages as (page_id, url, html); ``fmt`` "text" reads one page per file, known by its path."""
    if fmt == "text":
        return (spark.read.text(path, wholetext=True)
                .select(F.input_file_name().alias("page_id"),
                        F.input_file_name().alias("url"), F.col("value").alias("html")))
    return spark.read.format(fmt).load(path).select("page_id", "url", "html")


RECORDS = "map<string,struct<name:string,url:string,html_text:string,verification:string>>"


def read_labelled(spark: SparkSession, path: str, wholetext: bool = False,
                  labelled_only: bool = True, split: bool = False) -> DataFrame:
    """Records of ``{key: {name, url, html_text, verification}}`` documents.

    Each line is one such document, holding one record or many; ``wholetext``
    reads a file as one document, for pretty-printed files; ``split`` does so
    by many tasks, for files that no row should hold. Records without
    markup are always skipped, unlabelled ones when ``labelled_only``.
    """
    record = F.col("record")
    source = (json_map.entries(spark, path).select("file", F.col("json").alias("value")) if split else
              spark.read.text(path, wholetext=wholetext).select(F.input_file_name().alias("file"), "value"))
    rows = (source
            .select("file", F.explode(F.from_json("value", RECORDS)).alias("key", "record"))
            .select("file", "key", record["name"].alias("name"), record["url"].alias("url"),
                    record["html_text"].alias("html_text"),
                    F.coalesce(record["verification"], F.lit(fixed.UNLABELLED))
                    .alias("verification"))
            .where(F.coalesce(F.col("html_text"), F.lit("")) != ""))
    return rows.where(F.col("verification") != fixed.UNLABELLED) if labelled_only else rows


def record_id(records: DataFrame) -> Column:
    """What tells a record from all others: its key as it is, behind its file's name if known."""
    if "file" in records.columns:
        return F.concat(F.col("file"), F.lit("#"), F.col("key"))
    return F.col("key").cast("string")


def labelled_pages(records: DataFrame) -> DataFrame:
    """Labelled records in the shape of pages; ``page_id`` is ``record_id``, a text."""
    return records.select(record_id(records).alias("page_id"), "url", F.col("html_text").alias("html"))


def extract_tables(pages: DataFrame, html: str = "html") -> DataFrame:
    """One row per table: key, position of its start tag, and its rows of cells.

    The markup of pages without a table is not sent to Python, and no markup goes
    any further. (A filter would do the same, but Catalyst pushes it below the
    projection that makes ``html``, and a page made by an expression is made twice.)
    """
    keep = [c for c in pages.columns if c != html]
    sent = F.when(F.col(html).rlike("(?i)<table"), F.col(html))
    return (pages.select(*keep, F.explode(html_tables(sent)).alias("t"))
            .select(*keep, "t.*"))


def typed_rows(rows: Column) -> Column:
    """Rows with each cell's ``detail`` and coarse ``type`` filled in, in place."""
    def typed(c):
        detail = cell_types.detail_type(c["tags"], c["text"])         # bound, so that it is worked out once
        return F.transform(F.array(detail), lambda d: c.withField("detail", d).withField("type", cell_types.coarse_type(d)))[0]
    return F.transform(rows, lambda row: F.transform(row, typed))


def type_tables(tables: DataFrame) -> DataFrame:
    return tables.withColumn("rows", typed_rows(F.col("rows")))


def extract_cells(tables: DataFrame) -> DataFrame:
    """One row per cell: table key, place in the source rows, cell fields."""
    key = [c for c in tables.columns if c in TABLE_KEY + ["kind", "overlaps"]]
    width = F.aggregate(F.col("rows")[0], F.lit(0).cast("bigint"),
                        lambda w, c: w + c["colspan"])
    return (tables.where(F.col("status") == "ok")
            .withColumn("height", F.size("rows")).withColumn("first_width", width)
            .select(*key, "height", "first_width",
                    F.posexplode("rows").alias("src_row", "cells"))
            .select(*key, "height", "first_width", "src_row", F.posexplode("cells").alias("src_idx", "c"))
            .select(*key, "height", "first_width", "src_row", "src_idx", "c.*"))


_UDTF_ROW = T.StructType([
    T.StructField(name, kind) for name, kind in [
        ("table_idx", T.IntegerType()), ("src_row", T.IntegerType()),
        ("src_idx", T.IntegerType()), ("tag", T.StringType()), ("text", T.StringType()),
        ("tags", T.ArrayType(T.StringType())), ("rowspan", T.LongType()),
        ("colspan", T.LongType()), ("row", T.IntegerType()), ("col", T.LongType())]])


@F.udtf(returnType=_UDTF_ROW)
class HtmlCells:
    """``SELECT .. FROM pages, LATERAL html_cells(html)`` for SQL users."""

    def eval(self, html: str):
        from .markup import page_tables
        for table in page_tables(html or ""):
            for r, cells in enumerate(table["rows"]):
                for i, c in enumerate(cells):
                    yield (table["table_idx"], r, i, c["tag"], c["text"], c["tags"],
                           c["rowspan"], c["colspan"], c["row"], c["col"])
