"""Explicit schemas of every table the jobs read or write. Nothing is inferred."""

from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

STRINGS = ArrayType(StringType())


def _strings(*names: str, required: tuple[str, ...] = ()) -> list[StructField]:
    return [StructField(n, StringType(), n not in required) for n in names]


# Landing record. `payload` is a recursive record, which no StructType can
# describe, so it stays JSON text until `functions.payload` reads it.
RAW = StructType(
    [
        StructField("id", StringType(), False),
        StructField("labelIds", STRINGS),
        StructField("internalDate", StringType()),
        StructField("payload", StringType()),
    ]
)

MESSAGE = StructType(
    _strings("id", "date", required=("id",))
    + [StructField("internal_ts", TimestampType())]
    + _strings("from", "subject", "body_text")
    + [StructField("labels", STRINGS)]
)

SCORE_FIELDS = _strings("category", "reason", "error")
SCORED = StructType(MESSAGE.fields + SCORE_FIELDS)

LABEL_DIM = StructType(
    _strings("label_id", "label_name") + [StructField("scan_order", LongType())]
)
CATEGORY_DIM = StructType(
    [StructField("rank", IntegerType(), False), StructField("category", StringType(), False)]
)

SAMPLE_COLUMNS = ("id", "date", "from", "subject", "body_text", "category", "reason")
TRUTH = StructType(_strings("id", "main_label", "reason"))
EXAMPLE = StructType(_strings("id", "subject", "body_text", "category", "split"))
ACTION = StructType(_strings("id", "category", "label_id", "outcome", "skip_reason", "error"))

# CSV keeps labels as JSON text: the format has no arrays.
MESSAGE_CSV = StructType(_strings("id", "date", "from", "subject", "body_text", "labels"))
SCORED_CSV = StructType(MESSAGE_CSV.fields + _strings("category", "reason"))

# What a run tells: one row for each line of each section.
REPORT = StructType(
    _strings("section") + [StructField("position", IntegerType())] + _strings("name")
    + [StructField("n", LongType()), StructField("share_pct", DoubleType())] + _strings("detail")
)
EXAMPLE_SCORE = StructType(
    _strings("candidate_id", "id", "truth", "guess") + [StructField("is_right", BooleanType())]
)
CANDIDATE_RESULT = StructType(
    _strings("candidate_id")
    + [StructField("n", LongType()), StructField("n_correct", LongType())]
    + [StructField("accuracy_pct", DoubleType())]
)


CANDIDATE = StructType(
    _strings("candidate_id", "kind", "settings")
    + [StructField("n", LongType()), StructField("n_correct", LongType())]
    + [StructField("accuracy_pct", DoubleType())]
)


def extended(schema: StructType, **columns: str) -> StructType:
    """A copy with more columns, given by type name; `add` alone would change the original."""
    copy = StructType(list(schema.fields))
    for name, kind in columns.items():
        copy.add(name, kind)
    return copy
