"""Python over the rows of a partition, in Arrow batches, with exact types."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame

_ARROW = {
    "bigint": pa.int64(), "long": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8(),
    "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(),
    "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string()),
}
_OUT = 1000


def named_type(df: DataFrame, column: str) -> str:
    """`column type` of a column that goes through unchanged."""
    return f"{column} {df.schema[column].dataType.simpleString()}"


def streamed(df: DataFrame, rows_of: Callable[[Iterator[tuple]], Iterable[tuple]], schema: str) -> DataFrame:
    """`rows_of` applied to the rows of each partition in their order; it holds what it keeps itself."""
    fields = pa.schema([(n, _ARROW[t]) for n, t in (part.strip().split(" ", 1) for part in schema.split(","))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*[c.to_pylist() for c in batch.columns]))
        made = iter(rows_of(rows))
        while some := list(islice(made, _OUT)):
            columns = [pa.array(values, kind) for values, kind in zip(zip(*some), fields.types)]
            yield pa.RecordBatch.from_arrays(columns, schema=fields)

    return df.mapInArrow(run, schema)


def mapped(df: DataFrame, rows_of: Callable[..., Iterable[tuple]], schema: str) -> DataFrame:
    """`rows_of` applied to each row, given as its fields."""
    return streamed(df, lambda rows: (out for row in rows for out in rows_of(*row)), schema)
