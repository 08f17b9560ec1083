"""One JSON map of any size, cut at its keys by many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.store import stored, unsent


def _brackets(text: Column, inside: bool) -> Column:
    """Opening braces outside strings, if ``text``, freed of escapes, begins inside a string or not."""
    whole = F.concat(F.lit('"'), text) if inside else text
    plain = F.regexp_replace(whole, '(?s)"[^"]*(?:"|$)', "")
    return F.length(plain) - F.length(F.replace(plain, F.lit("{"), F.lit("")))


def fragments(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, seq, text, quotes, opens, opens_inside): the stretches between closing braces, as read, in order.

    Files are read in blocks by as many tasks as they have. Each closing brace ends a stretch, so none is
    longer than a record. What a stretch does to the state of reading depends only on whether it begins
    inside a string, which is known later; so both cases are worked out. An escape never reaches over a brace.
    """
    raw = (spark.read.option("lineSep", "}").text(path)
           .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                   F.monotonically_increasing_id().alias("seq"), F.col("value").alias("text")))
    bare = F.regexp_replace("text", r"(?s)\\.", "")
    return (raw.withColumn("bare", bare)
            .withColumn("quotes", F.length("bare") - F.length(F.replace("bare", F.lit('"'), F.lit(""))))
            .withColumn("opens", _brackets(F.col("bare"), False))
            .withColumn("opens_inside", _brackets(F.col("bare"), True)).drop("bare"))


def _before(order: str, *keys: str):
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def _change(inside: Column) -> Column:
    """How much deeper a stretch and the brace behind it lead, if it begins inside a string or not."""
    closes = (inside.cast("int") + F.col("quotes")) % 2 == 0
    return F.when(inside, F.col("opens_inside")).otherwise(F.col("opens")) - closes.cast("int")


def entry_numbers(marks: DataFrame) -> DataFrame:
    """(seq, entry, ends): the entry of its file that each stretch belongs to, and whether it ends it.

    ``marks`` is ``fragments`` without texts, stored. State is carried in two steps: over the stretches of a block
    from an unknown beginning, and over the blocks of a file, of which there is one small row each. First
    whether a string is open, then the depth, then the count of entries, as each needs the one before.
    """
    def carried(rows: DataFrame, value: Column, name: str) -> DataFrame:
        """The sum of ``value`` over all earlier stretches of the file."""
        here = rows.withColumn("value", value)
        blocks = here.groupBy("file", "block").agg(F.sum("value").alias("sum"))
        starts = blocks.select("file", "block", F.coalesce(F.sum("sum").over(_before("block", "file")), F.lit(0)).alias("start"))
        inside = F.coalesce(F.sum("value").over(_before("seq", "file", "block")), F.lit(0))
        return (here.withColumn("inside", inside).join(starts, ["file", "block"])
                .withColumn(name, F.col("start") + F.col("inside")).drop("value", "start", "inside"))

    quoted = stored(carried(marks, F.col("quotes"), "quotes_before"), "quoted")
    change = _change(F.col("quotes_before") % 2 == 1)
    deep = stored(carried(quoted.withColumn("change", change), F.col("change"), "depth"), "deep")
    shut = (F.col("quotes_before") + F.col("quotes")) % 2 == 0
    ends = shut & (F.col("depth") + F.col("change") == 1)
    numbered = carried(deep.withColumn("ends", ends), F.col("ends").cast("int"), "entry")
    return numbered.select("seq", "entry", "ends")


def entries(spark: SparkSession, path: str) -> DataFrame:
    """(file, entry, json): every entry of the maps in the files of ``path`` as a map of its own.

    A file may hold one map or several behind each other, on one line or many. Values are objects; braces,
    quotes and escapes in their strings and objects inside them are no matter. What is not closed at the end of a file
    is left out. An empty file has no entries, an empty map neither.
    """
    cut = stored(fragments(spark, path), "fragments")
    numbers = entry_numbers(cut.drop("text"))
    texts = (cut.select("file", "block", "seq", "text").join(unsent(numbers), "seq").groupBy("file", "entry")
             .agg(F.array_sort(F.collect_list(F.struct("block", "seq", "text"))).alias("parts"), F.max("ends").alias("whole"))
             .where("whole"))
    joined = F.concat(F.array_join(F.transform("parts", lambda p: p["text"]), "}"), F.lit("}"))
    # before an entry stand blanks, a comma, and the brace of its map; after it, that of the map before it
    return texts.select("file", "entry", F.concat(F.lit("{"), F.regexp_replace(joined, r'^[^"]*', ""), F.lit("}")).alias("json"))
