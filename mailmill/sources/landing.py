"""Landing folder of exported message records, one JSON object per line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.payload import NO_LIMITS
from ..schemas import LABEL_DIM, RAW

ARRIVED = "arrived"


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """Only the four fields of RAW are read; the payload comes as its JSON text.

    A line that is no record is a row of nulls here; `sources.ingest` puts it aside.
    """
    return spark.read.schema(RAW).options(**NO_LIMITS).json(path)


def stream_raw(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """The same records as a stream of new files, with the time each file came."""
    reader = spark.readStream.schema(RAW).options(**NO_LIMITS)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(path).select("*", F.col("_metadata.file_modification_time").alias(ARRIVED))


def read_label_dim(spark: SparkSession, path: str) -> DataFrame:
    """Label ids and names with the order they were scanned in."""
    return spark.read.schema(LABEL_DIM).json(path)
