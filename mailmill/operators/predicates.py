"""Row filters and column choices."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..categories import CUSTOM_LABEL_PREFIX
from ..functions.labels import holds_all, holds_any, or_no_labels
from .bounded import MOST_ROWS, small_rows

ANYWHERE, INBOX, UNREAD, UNREAD_PRIMARY = "anywhere", "inbox", "unread", "unread_primary"
SCOPES = (ANYWHERE, INBOX, UNREAD, UNREAD_PRIMARY)

# The tabs of an inbox next to the primary one.
_OTHER_TABS = (
    "CATEGORY_PROMOTIONS", "CATEGORY_SOCIAL", "CATEGORY_UPDATES", "CATEGORY_FORUMS",
)


def scope_flags(label_ids: Column) -> dict[str, Column]:
    """What a scope tests, as booleans.

    A test on an array does not reach a Parquet scan, one on a boolean column
    does. Tables that are filtered by scope often store these at ingest.
    """
    ids = or_no_labels(label_ids)
    return {
        "is_inbox": F.array_contains(ids, "INBOX"),
        "is_unread": F.array_contains(ids, "UNREAD"),
        "is_primary": F.array_contains(ids, "CATEGORY_PERSONAL") | ~holds_any(ids, _OTHER_TABS),
    }


def with_scope_flags(df: DataFrame, ids: str = "label_ids") -> DataFrame:
    return df.withColumns(scope_flags(F.col(ids)))


def in_scope(df: DataFrame, scope: str, ids: str = "label_ids") -> DataFrame:
    """Rows of a scope; uses stored flags where the table has them."""
    if scope not in SCOPES:
        raise ValueError(f"unknown scope {scope!r}, expected one of {SCOPES}")
    tests = {
        ANYWHERE: (),
        INBOX: ("is_inbox",),
        UNREAD: ("is_inbox", "is_unread"),
        UNREAD_PRIMARY: ("is_inbox", "is_unread", "is_primary"),
    }[scope]
    stored = set(df.columns)
    computed = {} if stored.issuperset(tests) else scope_flags(F.col(ids))
    for test in tests:
        df = df.where(F.col(test) if test in stored else computed[test])
    return df


def with_all_labels(df: DataFrame, wanted: Iterable[str], ids: str = "label_ids") -> DataFrame:
    return df.where(holds_all(F.col(ids), wanted))


def custom_labels(label_dim: DataFrame) -> DataFrame:
    """Labels made by a user."""
    return label_dim.where(F.col("label_id").startswith(CUSTOM_LABEL_PREFIX))


def with_custom_label(
    df: DataFrame, label_dim: DataFrame, ids: str = "label_ids", key: str = "id"
) -> DataFrame:
    """Rows holding a label made by a user.

    A label list found small becomes a constant of the filter, so the test runs
    in the scan stage. A larger one is matched by a semi join on single labels.
    """
    custom = custom_labels(label_dim).select("label_id").distinct()
    rows = small_rows(custom, MOST_ROWS)
    if rows is not None:
        return df.where(holds_any(F.col(ids), [r.label_id for r in rows]))
    held = df.select(key, F.explode(F.array_distinct(ids)).alias("label_id"))
    # Only custom ids can match: the labels nearly every message holds stay out
    # of the shuffle. Copies of one pair are merged before it.
    held = held.where(F.col("label_id").startswith(CUSTOM_LABEL_PREFIX)).distinct()
    keys = held.join(custom, "label_id", "left_semi").select(key).distinct()
    return df.join(keys, key, "left_semi")


def matching(df: DataFrame, column: str, pattern: str) -> DataFrame:
    """Rows whose text contains a match, letter case counted; missing text never does."""
    return df.where(F.col(column).rlike(pattern))


def require_columns(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """The wanted columns in order, or an error that says what is missing and what there is."""
    missing = [c for c in wanted if c not in df.columns]
    if missing:
        raise ValueError(f"no columns {missing} among {df.columns}")
    return df.select(*[F.col(f"`{c}`") for c in wanted])


def existing_columns(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """Those of the wanted columns that exist."""
    return df.select(*[F.col(f"`{c}`") for c in wanted if c in df.columns])


def tidy_columns(
    df: DataFrame, rename: dict[str, str] | None = None, drop: Sequence[str] = ()
) -> DataFrame:
    """Column names stripped, some columns dropped if present, some renamed if present."""
    stripped = df.toDF(*[c.strip() for c in df.columns])
    return stripped.drop(*drop).withColumnsRenamed(rename or {})


def labels_differ(old: Column, new: Column) -> Column:
    """Whether a row goes to review. A missing label agrees with nothing, not even another."""
    return F.coalesce(old != new, F.lit(True))
