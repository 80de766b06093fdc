"""Sets of labels."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..categories import IGNORED_LABELS
from .predicates import custom_labels


def all_labels(df: DataFrame, labels: str = "labels") -> DataFrame:
    """Every label in use, once."""
    return df.select(F.explode(labels).alias("label")).distinct()


def tag_label_set(
    df: DataFrame, labels: str = "labels", ignored: Iterable[str] = IGNORED_LABELS
) -> DataFrame:
    """Labels in use without the ignored ones."""
    names = df.sparkSession.createDataFrame([(n,) for n in ignored], "label string")
    return all_labels(df, labels).join(F.broadcast(names), "label", "left_anti")


def custom_labels_in_use(df: DataFrame, label_dim: DataFrame, ids: str = "label_ids") -> DataFrame:
    """Labels made by a user that some message holds."""
    custom = custom_labels(label_dim).select(F.col("label_id").alias("label"))
    return all_labels(df, ids).intersect(custom)


def union_of_values(first: DataFrame, second: DataFrame, column: str) -> DataFrame:
    return first.select(column).union(second.select(column)).distinct()
