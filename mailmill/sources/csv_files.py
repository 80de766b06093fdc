"""CSV import and export.

A CSV file with line breaks inside its cells cannot be split, so CSV is for
exchange; tables the jobs work on are Parquet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from ..functions.labels import parse_label_text

_FORMAT = {
    "header": True,
    "escape": '"',
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}

# A cell with nothing in it is null, a quoted empty one is ''. Spark tells them
# apart only if null has a name of its own on reading, which no cell holds.
_NULL = "\x01null\x01"


def read_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Never infers a type: an id of digits stays text. The header is checked against the schema."""
    reader = spark.read.schema(schema).options(
        **_FORMAT, multiLine=True, enforceSchema=False, nullValue=_NULL
    )
    return reader.csv(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Arrays and records are written as JSON text, which CSV can hold."""
    flat = [
        F.to_json(f"`{f.name}`").alias(f.name)
        if isinstance(f.dataType, (ArrayType, MapType, StructType))
        else F.col(f"`{f.name}`")
        for f in df.schema.fields
    ]
    df.select(*flat).write.options(**_FORMAT).mode(mode).csv(path)


def with_label_lists(df: DataFrame, column: str = "labels") -> DataFrame:
    """Label text of a CSV file, JSON or a printed Python list, as an array."""
    return df.withColumn(column, parse_label_text(F.col(column)))
