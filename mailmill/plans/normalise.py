"""Raw records to flat messages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.payload import (
    DEFAULT_DEPTH, headers_of, join_text_parts, payload_error, read_payload, text_parts,
)
from ..functions.text import header_value, or_empty, squeeze_line_ends
from ..functions.times import DEFAULT_ZONE, epoch_millis, local_iso
from ..operators.lookups import name_labels
from ..schemas import MESSAGE


def normalise_messages(
    raw: DataFrame,
    label_dim: DataFrame,
    zone: str = DEFAULT_ZONE,
    depth: int = DEFAULT_DEPTH,
    prefer_plain: bool = False,
    with_errors: bool = False,
) -> DataFrame:
    """One flat row per raw record, in the columns of MESSAGE.

    With `with_errors` a column `payload_error` says which payloads could not be read.
    Row filters belong on `raw`, before this: the body is by far the dearest part.
    """
    read = raw.withColumn("_read", read_payload(F.col("payload"), depth))
    payload = (F.col("_read"), F.col("payload"), depth)
    headers, millis = headers_of(*payload), epoch_millis(F.col("internalDate"))
    parts = text_parts(*payload)
    more = {"payload_error": payload_error(*payload)} if with_errors else {}
    flat = read.select(
        "id",
        local_iso(millis, zone).alias("date"),
        F.timestamp_millis(millis).alias("internal_ts"),
        or_empty(header_value(headers, "From")).alias("from"),
        or_empty(header_value(headers, "Subject")).alias("subject"),
        squeeze_line_ends(join_text_parts(parts, prefer_plain)).alias("body_text"),
        "labelIds",
        *[column.alias(name) for name, column in more.items()],
    )
    return name_labels(flat, label_dim, ids="labelIds").select(*MESSAGE.names, *more)
