"""The labelled set as files: exported, studied, sampled for review, compared after it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.labels import main_label, tag_labels
from ..operators import aggregates as agg
from ..operators.evaluation import compare_labels, label_mismatches
from ..operators.predicates import require_columns, tidy_columns
from ..operators.reports import section
from ..operators.sampling import stratified_sample
from ..schemas import MESSAGE_CSV, SAMPLE_COLUMNS, SCORED_CSV, TRUTH
from ..session import work_dir
from ..sources.csv_files import read_csv, with_label_lists, write_csv
from .jobs import Job, labelled_set

TAGS, IGNORED, PER_MESSAGE, MAIN, CATEGORIES = "tags", "ignored", "tags_per_message", "main_labels", "categories"


def with_main_label(messages: DataFrame) -> DataFrame:
    """Adds `main_label`: the first label that is no system label, or ''."""
    return messages.withColumn("main_label", main_label(tag_labels(F.col("labels"))))


def export_labelled(
    spark: SparkSession, job: Job, path: str, max_messages: int | None = 5000, anywhere: bool = False
) -> None:
    """Messages that hold a label made by a user, newest first, as CSV."""
    write_csv(labelled_set(spark, job, max_messages, anywhere).select(*MESSAGE_CSV.names), path)


def read_scored(spark: SparkSession, path: str) -> DataFrame:
    """Scored messages of a CSV file with their labels as lists.

    A CSV file with line breaks in its cells is read by one task; the rows are written
    to the work folder once, and read from there by as many tasks as there are parts.
    """
    stored = work_dir(spark, "scored-csv")
    with_label_lists(read_csv(spark, path, SCORED_CSV)).write.parquet(stored)
    return spark.read.parquet(stored)


def study(messages: DataFrame) -> DataFrame:
    """Labels outside the ignore list, ignored ones, labels per message, main labels, categories.

    Every section counts before it sorts; windows run over counts.
    """
    def placed(counts: DataFrame, name: str, *order: Column) -> DataFrame:
        place = F.row_number().over(Window.partitionBy().orderBy(*order))
        rows = counts.withColumn("_place", place)
        return rows.withColumn("_name", F.col(name).cast("string"))

    most = F.desc("n")
    parts = (
        (TAGS, agg.tag_label_counts(messages), "label", (F.asc("label"),)),
        (IGNORED, agg.listed_label_counts(messages), "label", (most, F.asc("label"))),
        (PER_MESSAGE, agg.tags_per_message(messages), "tags", (F.asc("tags"),)),
        (MAIN, agg.category_counts(with_main_label(messages), "main_label"), "main_label", (most, F.asc("main_label"))),
        (CATEGORIES, agg.category_counts(messages, keep_null=True), "category", (most, F.asc_nulls_last("category"))),
    )
    return reduce(DataFrame.unionByName, [
        section(placed(counts, name, *order), kind, F.col("_place"), name=F.col("_name"), n=F.col("n"))
        for kind, counts, name, order in parts
    ])


def sample_for_review(spark: SparkSession, path: str, out: str, n: int = 20, seed: int = 42) -> None:
    """Up to n messages of each category of a CSV file, as CSV for reviewers."""
    tagged = require_columns(read_scored(spark, path), SAMPLE_COLUMNS)
    write_csv(stratified_sample(tagged, n, seed), out)


def compare_reviews(spark: SparkSession, old: str, new: str) -> tuple[DataFrame, DataFrame]:
    """Rows on which two reviewed files differ, and how many rows and labels there are."""
    before, after = (tidy_columns(read_csv(spark, path, TRUTH)) for path in (old, new))
    compared = compare_labels(before, after)
    counts = compared.agg(
        F.count("*").alias("n_both"), F.count_distinct("old_label").alias("old_labels"),
        F.count_distinct("new_label").alias("new_labels"),
        F.count_if(F.coalesce(F.col("old_label") != F.col("new_label"), F.lit(True))).alias("n_mismatch"))
    return label_mismatches(compared), counts
