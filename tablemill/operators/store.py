"""Writing intermediate and final results to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..session import work_folder


def stored(rows: DataFrame, name: str) -> DataFrame:
    """Write once and read back: lineage ends here and survives the loss of executors."""
    path = work_folder(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def unsent(rows: DataFrame) -> DataFrame:
    """A side of a join that grows with the input: it is shuffled, never sent whole through the driver.

    The engine would guess its size from the files behind it, and what is rendered, exploded or read back from
    well-packed files can be a hundred times as large.
    """
    return rows.hint("merge")
