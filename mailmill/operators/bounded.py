"""Small tables, proven small before anything is built on that; tables kept for several readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..session import work_dir

# At most this many rows are taken to the driver or sent to every executor.
MOST_ROWS = 10_000


def small_rows(df: DataFrame, most: int = MOST_ROWS) -> list[Row] | None:
    """All rows of a table of at most `most` rows, else None. Reads no more than that."""
    rows = df.limit(most + 1).collect()
    return rows if len(rows) <= most else None


def broadcast_if_small(df: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """The table marked for broadcast if it was found small, else as it is.

    Left as it is, the join is a shuffle join, whose hot keys AQE splits.
    """
    rows = small_rows(df, most)
    if rows is None:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


def kept(df: DataFrame, purpose: str) -> DataFrame:
    """The rows written to the work folder and read again, so that they are made once."""
    path = work_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
