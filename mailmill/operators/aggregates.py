"""Counts and reports."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..categories import IGNORED_LABELS
from ..functions.labels import or_no_labels, tag_labels

BAR_CHARS = 60


def category_counts(df: DataFrame, column: str = "category", keep_null: bool = False) -> DataFrame:
    """Rows per value, most first, ties by name; rows without one count only if asked."""
    rows = df if keep_null else df.where(F.col(column).isNotNull())
    counts = rows.groupBy(column).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), F.col(column).asc_nulls_last())


def category_report(df: DataFrame, width: int = BAR_CHARS) -> DataFrame:
    """Counts with share and text bar; the longest bar has `width` blocks, the others their part of it."""
    counts = df.where(F.col("category").isNotNull()).groupBy("category").agg(F.count("*").alias("n"))
    # A window over the counts, one row per category, so that the table is read once.
    all_counts = Window.partitionBy()
    most, everything = F.max("n").over(all_counts), F.sum("n").over(all_counts)
    blocks = F.ceil(F.col("n") * F.lit(width).cast("double") / most)
    return counts.select(
        "category",
        "n",
        (F.lit(100.0) * F.col("n") / everything).alias("share_pct"),
        F.repeat(F.lit("█"), blocks.cast("int")).alias("bar"),
    ).orderBy(F.desc("n"), "category")


def distinct_values(df: DataFrame, *columns: str, approximate: bool = False) -> DataFrame:
    """Number of different values per column, missing ones not counted."""
    count = F.approx_count_distinct if approximate else F.count_distinct
    return df.agg(*[count(F.col(c)).alias(c) for c in columns])


def stage_counts(df: DataFrame, stages: dict[str, Column]) -> DataFrame:
    """(stage, n): rows that meet each condition, all counted in one pass."""
    counts = df.agg(*[F.count_if(test).alias(name) for name, test in stages.items()])
    return counts.unpivot([], list(stages), "stage", "n")


def label_counts(df: DataFrame, labels: str = "labels", only: Iterable[str] | None = None) -> DataFrame:
    """(label, n): messages per label; a message that repeats one counts once."""
    single = df.select(F.explode(F.array_distinct(labels)).alias("label"))
    if only is not None:
        single = single.where(F.col("label").isin(list(only)))
    return single.groupBy("label").agg(F.count("*").alias("n"))


def tag_label_counts(
    df: DataFrame, labels: str = "labels", ignored: Sequence[str] = IGNORED_LABELS
) -> DataFrame:
    tags = df.select(tag_labels(F.col(labels), ignored).alias("labels"))
    return label_counts(tags).orderBy("label")


def listed_label_counts(
    df: DataFrame, labels: str = "labels", listed: Sequence[str] = IGNORED_LABELS
) -> DataFrame:
    """Counts of a fixed list of labels, those never used with 0, most first."""
    names = df.sparkSession.createDataFrame([(name,) for name in listed], "label string")
    found = label_counts(df, labels, only=listed)
    counts = names.join(F.broadcast(found), "label", "left")
    return counts.select("label", F.coalesce("n", F.lit(0)).alias("n")).orderBy(F.desc("n"), "label")


def tags_per_message(
    df: DataFrame, labels: str = "labels", ignored: Sequence[str] = IGNORED_LABELS
) -> DataFrame:
    """(tags, n): how many messages hold how many labels outside the ignore list."""
    size = F.size(tag_labels(or_no_labels(F.col(labels)), ignored))
    return df.groupBy(size.alias("tags")).agg(F.count("*").alias("n")).orderBy("tags")


def confusion(df: DataFrame, old: str, new: str) -> DataFrame:
    """Rows per pair of labels."""
    return df.groupBy(old, new).agg(F.count("*").alias("n"))
