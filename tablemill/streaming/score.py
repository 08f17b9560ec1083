"""Pages arriving as files, verdicts leaving as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.learn import GatedModel
from ..plans.runs import score

PAGE_SCHEMA = "page_id long, url string, html string"


def read_page_stream(spark: SparkSession, path: str, schema: str = PAGE_SCHEMA,
                     files_per_batch: int = 1000) -> DataFrame:
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
            .parquet(path))


def score_stream(pages: DataFrame, model: GatedModel, out: str, checkpoint: str,
                 once: bool = True) -> StreamingQuery:
    """Score every table of a stream of pages.

    Nothing is kept between batches, and a table that cannot be read only gets a
    status. The verdict's long expressions are built and resolved once, not for each batch. Each
    batch writes its own folder, so a batch repeated after a failure
    replaces what it had written: results are exactly once, keyed by table.
    """
    def write(scored: DataFrame, batch_id: int) -> None:
        scored.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    writer = (score(pages, model).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
              .queryName("table scores"))
    return (writer.trigger(availableNow=True) if once else writer).start()
