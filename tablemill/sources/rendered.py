"""Pages with tables, rendered from the relational test tables.

Each page comes from one row, so rendering is a projection: no grouping, no
shuffle, no key that could grow hot. All return (page_id, url, html, kind).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ["document", "order", "customer", "event"]
BLOCK = 5              # lines of a document between two subtotals
VARIANTS = 24          # shapes that events cycle through


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """Use all cores on an input of fewer splits than cores, such as one small file.

    Large inputs come in more splits than cores and are left as they are.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


#: Pages that a task renders, reads and judges.
TASK_PAGES = 25_000


def dealt(rows: DataFrame) -> DataFrame:
    """Narrow rows that a page is made of each, dealt evenly to as many tasks as their number needs.

    A page is many times the size of its row, so splits of a file by size, or by its row groups, would
    make few tasks, and long ones.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(max(cores, -(-rows.count() // TASK_PAGES)))


def _pages(rows: DataFrame, kind: str, key: str, body: Column) -> DataFrame:
    page_id = F.col(key) * len(KINDS) + (KINDS.index(kind) if kind in KINDS else 0)
    return rows.select(
        page_id.alias("page_id"),
        F.concat(F.lit(f"https://example.org/{kind}/"), F.col(key).cast("string")).alias("url"),
        F.concat(F.lit("<html><head><title>"), F.lit(kind), F.lit("</title></head><body><p>"),
                 F.lit(kind), F.lit("</p>"), body, F.lit("</body></html>")).alias("html"),
        F.lit(kind).alias("kind"))


def _row(*cells, tag: str = "td") -> Column:
    """A row of cells; a text that begins with a cell tag is taken as it is."""
    parts = [F.lit("<tr>")]
    for cell in cells:
        if isinstance(cell, str) and cell.startswith("<t"):
            parts.append(F.lit(cell))
        else:
            value = F.lit(cell) if isinstance(cell, str) else cell
            parts += [F.lit(f"<{tag}>"), value, F.lit(f"</{tag}>")]
    return F.concat(*parts, F.lit("</tr>"))


def _cell(attrs: str, value: Column, tag: str = "td") -> Column:
    return F.concat(F.lit(f"<{tag} {attrs}>"), value, F.lit(f"</{tag}>"))


def _table(*rows: Column) -> Column:
    return F.concat(F.lit("<table>"), *rows, F.lit("</table>"))


def n_words(line: Column) -> Column:
    return F.size(F.filter(F.split(line, " "), lambda w: w != ""))


def document_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document its lines in blocks of five, with subtotals and a total.

    Every third document states a total of characters that is one too high.
    """
    lines = F.split("text", "\n")
    facts = F.transform(lines, lambda l, i: F.struct(
        i.alias("i"), n_words(l).cast("long").alias("words"),
        F.char_length(l).cast("long").alias("chars")))

    def total(rows, field):
        return F.aggregate(rows, F.lit(0).cast("long"), lambda s, x: s + x[field])

    def block_rows(b):
        part = F.slice("facts", b * BLOCK + 1, BLOCK)

        def line_row(x, i):
            block = F.when(i == 0, F.concat(
                F.lit("<td rowspan="), F.size(part).cast("string"), F.lit(">Block "),
                (b + 1).cast("string"), F.lit("</td>"))).otherwise("")
            words = F.when(x["words"] == 0, "-").otherwise(x["words"].cast("string"))
            return F.concat(
                F.lit("<tr>"), block, F.lit("<td>Line "), (x["i"] + 1).cast("string"),
                F.lit("</td><td>"), F.when(x["words"] > 50, "long").otherwise("short"),
                F.lit("</td><td>"), words, F.lit("</td><td>"), x["chars"].cast("string"),
                F.lit("</td></tr>"))
        return F.concat(
            F.array_join(F.transform(part, line_row), ""),
            F.lit("<tr><td></td><td colspan=2><b>Subtotal</b></td><td>"),
            total(part, "words").cast("string"), F.lit("</td><td>"),
            total(part, "chars").cast("string"), F.lit("</td></tr>"))

    blocks = F.transform(F.sequence(
        F.lit(0), F.ceil(F.size("facts") / BLOCK).cast("int") - 1), block_rows)
    stated = total(F.col("facts"), "chars") + F.when(F.col("doc_id") % 3 == 0, 1).otherwise(0)
    body = _table(
        _row("Block", "Line", "Kind", "Words", "Chars", tag="th"),
        F.array_join(blocks, ""),
        F.concat(F.lit("<tr><td colspan=3>Total</td><td>"),
                 total(F.col("facts"), "words").cast("string"), F.lit("</td><td>"),
                 stated.cast("string"), F.lit("</td></tr>")))
    docs = (spread(load(spark, sf_dir, "documents").select("doc_id", "text"))
            .select("doc_id", facts.alias("facts")))
    return _pages(docs, "document", "doc_id", body)


def money(value: Column) -> Column:
    cents = F.round(value * 100).cast("long")
    return F.concat(F.when(cents < 0, "-").otherwise(""), F.lit("$"),
                    (F.abs(cents) / 100).cast("decimal(18,2)").cast("string"))


def order_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per order a card of keys and values, keys on the left."""
    body = _table(
        _row("Placed", F.date_format("o_orderdate", "yyyy-MM-dd")),
        _row("Customer", F.concat(F.lit("Customer no "), F.col("o_custkey").cast("string"))),
        _row("Status", F.concat(F.lit("<i>"), F.col("o_orderstatus"), F.lit("</i>"))),
        _row("Price", money(F.col("o_totalprice"))),
        _row("Priority", F.col("o_orderpriority")))
    return _pages(dealt(load(spark, sf_dir, "orders").select(
        "o_orderkey", "o_orderdate", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")), "order", "o_orderkey", body)


def customer_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per customer a table with two levels of headers and of row attributes.

    ``nation`` and ``region`` are dimension tables; the engine decides by their
    size whether to broadcast them.
    """
    rows = (dealt(load(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_name", "c_acctbal", "c_mktsegment"))
            .join(load(spark, sf_dir, "nation"), F.expr("c_nationkey = n_nationkey"))
            .join(load(spark, sf_dir, "region"), F.expr("n_regionkey = r_regionkey")))
    body = _table(
        F.concat(F.lit("<tr><th rowspan=2>Region</th><th rowspan=2>Owner</th>"
                       "<th colspan=2>Account</th></tr>")),
        _row("Balance", "Segment", tag="th"),
        F.concat(F.lit("<tr>"), _cell("rowspan=2", F.col("r_name")),
                 F.lit("<td>"), F.col("c_name"), F.lit("</td><td>"), money(F.col("c_acctbal")),
                 F.lit("</td><td>"), F.col("c_mktsegment"), F.lit("</td></tr>")),
        _row(F.col("n_name"), money(F.col("c_acctbal") * 2), F.col("c_mktsegment")))
    return _pages(rows, "customer", "c_custkey", body)


def event_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per event a table in one of 24 shapes: good ones and every way to fail."""
    v = F.round(F.col("value") * 100).cast("long").cast("string")
    kind = F.col("event_type")
    link = F.concat(F.lit('<a href="#">'), kind, F.lit("</a>"))
    img, head = '<td><img src="a.png"></td>', _row("Name", "Value", tag="th")
    noted = _row("Name", "Value", "Note", tag="th")
    shapes = [
        _table(head, _row("first", v), _row("second", v)),                           # 0 genuine
        _table(head, _row("first", "n/a"), _row("second", v), _row("third", v)),     # 1 genuine
        _table(head, _row("first", link), _row("second", kind)),                     # 2 genuine
        _table(head, _row("first", img), _row("second", img)),                       # 3 genuine
        _table(noted, _row("first", v, kind), _row("second", img, kind)),            # 4 DataType
        _table(_row("<td><button>Go</button></td>", "Value"), _row("first", v),
               _row("second", v)),                                                   # 5 TitleType
        _table(noted, _row("first", F.concat(v, F.lit("%")), kind),
               _row("second", F.concat(F.lit("$"), v), kind)),                       # 6 DataType
        _table(head, _row("first", "12:30"), _row("second", "14:05:10")),            # 7 genuine
        _table(head, _row("first", v), _row("second", '<td rowspan=4>7</td>'),
               _row("third")),                                                       # 8 Layout
        _table(noted, _row("first", v), _row("second", v)),                          # 9 Layout
        _table(_row("first", v, "second", v)),                                       # 10 too small
        _table(_row("Menu", "Page"), _row(_table(head, _row("first", v),
               _row("second", v)), link)),                                           # 11 nested
        _table(head, _row("first", '<td colspan="wide">1</td>'), _row("second", v)),  # 12 error
        F.concat(F.lit("<p>"), kind, F.lit("</p>")),                                 # 13 no table
        _table(head, _row("<td colspan=2>Part one</td>"), _row("first", v),
               _row("second", v)),                                                   # 14 section
        _table(_row("Group", "Case", "Value", tag="th"),
               F.concat(F.lit("<tr><td rowspan=2>A</td><td>one</td><td>"), v, F.lit("</td></tr>")),
               _row("two", v), _row("<td colspan=2>plain</td>", link)),              # 15 DataType
        _table(head, _row("first", v), _row("", v), _row("third", kind)),            # 16 genuine, left
        _table(_row("Group", "Case", "Value", tag="th"),
               F.concat(F.lit("<tr><td rowspan=2>A</td><td>one</td><td>"), v, F.lit("</td></tr>")),
               _row("two", v),
               F.concat(F.lit("<tr><td colspan=2>alone</td><td>"), v, F.lit("</td></tr>")),
               _row("B", "three", v)),                                               # 17 genuine
        _table(noted, _row("first", v, '<td><input type="text"></td>'),
               _row("second", v, "<td><select></select></td>")),                     # 18 genuine
        _table(_row("Name", "<td>2024</td>"), _row("first", kind),
               _row("<td><video></video></td>", kind)),                              # 19 TitleType
        _table(_row('<th colspan="2">Name</th>', "Value", tag="th"),
               _row('<td colspan="2">first</td>', v), _row("one", "two", v)),        # 20 genuine
        _table(_row("Group", "Case", "Value", tag="th"),
               _row('<td rowspan="2">A</td>', "one", kind), _row("two", kind),
               _row('<td colspan="2">plain</td>', link)),                            # 21 genuine
        _table(head, _row('<td rowspan="3">first</td>', v), _row(v), _row(v)),       # 22 Layout
        _table(head, F.concat(F.lit('<tr><td>first</td><td rowspan="0">'), v, F.lit("</td></tr>")),
               _row("second", v), _row("third", v)),                                 # 23 error
    ]
    body = None
    for n, shape in enumerate(shapes):
        test = F.col("event_id") % VARIANTS == n
        body = F.when(test, shape) if body is None else body.when(test, shape)
    return _pages(dealt(load(spark, sf_dir, "events").select("event_id", "event_type", "value")), "event", "event_id", body)


def supplier_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per supplier a table with three levels of headers and of row attributes; not part of ``corpus``.

    Its page numbers are negative, so they meet none of the other kinds.
    """
    rows = (dealt(load(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_name", "s_acctbal"))
            .join(load(spark, sf_dir, "nation"), F.expr("s_nationkey = n_nationkey"))
            .join(load(spark, sf_dir, "region"), F.expr("n_regionkey = r_regionkey")))
    sums = [money(F.col("s_acctbal") * k) for k in (1, 2, 3, 4)]

    def firm(name):
        return F.concat(F.col("s_name"), F.lit(name))
    body = _table(
        F.lit("<tr><th rowspan=3>Region</th><th rowspan=3>Nation</th><th rowspan=3>Firm</th><th colspan=4>Account</th></tr>"),
        F.lit("<tr><th colspan=2>Balance</th><th colspan=2>Limit</th></tr>"),
        _row("Now", "Then", "Now", "Then", tag="th"),
        F.concat(F.lit("<tr>"), _cell("rowspan=4", F.col("r_name")), _cell("rowspan=2", F.col("n_name")), F.lit("<td>"),
                 F.col("s_name"), F.lit("</td>"), *[F.concat(F.lit("<td>"), x, F.lit("</td>")) for x in sums], F.lit("</tr>")),
        _row(firm(" office"), *sums),
        F.concat(F.lit("<tr>"), _cell("rowspan=2", F.concat("n_name", F.lit(" abroad"))), F.lit("<td>"), firm(" depot"),
                 F.lit("</td>"), *[F.concat(F.lit("<td>"), x, F.lit("</td>")) for x in sums], F.lit("</tr>")),
        _row(firm(" store"), *sums))
    return _pages(rows.withColumn("number", -1 - F.col("s_suppkey")), "supplier", "number", body)


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rendered pages; ``page_id`` is unique across the kinds."""
    parts = [document_pages, order_pages, customer_pages, event_pages]
    out = parts[0](spark, sf_dir)
    for part in parts[1:]:
        out = out.unionByName(part(spark, sf_dir))
    return out
