"""Lookups between labels, categories and messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..categories import category_dim
from ..functions.labels import or_no_labels
from .bounded import small_rows
from .skewed import lookup

# A map literal is searched key by key; a mailbox has tens of labels.
MOST_MAPPED_LABELS = 500


def name_labels(
    df: DataFrame,
    label_dim: DataFrame,
    ids: str = "label_ids",
    out: str = "labels",
    key: str = "id",
    most: int = MOST_MAPPED_LABELS,
) -> DataFrame:
    """Label ids to names inside the array, order kept; an unknown id stays as it is."""
    names = label_dim.where(F.col("label_id").isNotNull()).groupBy("label_id").agg(
        F.max_by("label_name", "scan_order").alias("label_name")
    )
    rows = small_rows(names, most)
    if rows is None:
        return _name_labels_by_join(df, names, ids, out, key)
    if not rows:
        return df.withColumn(out, or_no_labels(F.col(ids)))
    mapping = F.create_map(*[F.lit(v) for r in rows for v in (r.label_id, r.label_name)])
    named = F.transform(
        or_no_labels(F.col(ids)), lambda i: F.coalesce(F.try_element_at(mapping, i), i)
    )
    return df.withColumn(out, named)


def _name_labels_by_join(
    df: DataFrame, names: DataFrame, ids: str, out: str, key: str
) -> DataFrame:
    """For label tables too large for a map.

    What an array maps to depends on the array alone, so the distinct arrays are
    mapped, which are few however many messages share them. Finding them counts
    them: arrays that many messages hold, and labels that many arrays hold, are
    looked up by broadcast, all others by a shuffle.
    """
    rows = df.withColumn("_ids", or_no_labels(F.col(ids)))
    arrays = rows.groupBy("_ids").agg(F.count("*").alias("n"))
    single = arrays.select("_ids", F.posexplode("_ids").alias("_pos", "label_id"))
    in_arrays = single.groupBy("label_id").agg(F.count("*").alias("n"))
    named = lookup(single, names, ["label_id"], in_arrays, spread="_ids")
    mapped = named.groupBy("_ids").agg(
        F.array_sort(
            F.collect_list(F.struct("_pos", F.coalesce("label_name", "label_id").alias("name")))
        ).alias("_named")
    )
    mapped = mapped.select("_ids", F.col("_named")["name"].alias("_names"))
    joined = lookup(rows, mapped, ["_ids"], arrays, spread=key)
    return joined.withColumn(out, or_no_labels(F.col("_names"))).select(*df.columns, out)


def label_id_of_category(label_dim: DataFrame, categories: DataFrame | None = None) -> DataFrame:
    """(category, label_id): the label named like a category; the last scanned of one name wins.

    At most one row per category, sixteen unless other categories are given.
    """
    if categories is None:
        categories = F.broadcast(category_dim(label_dim.sparkSession))
    named = label_dim.withColumnRenamed("label_name", "category").join(
        categories, "category", "left_semi"
    )
    return named.groupBy("category").agg(F.max_by("label_id", "scan_order").alias("label_id"))


def label_coverage(label_dim: DataFrame) -> DataFrame:
    """(rank, category, present, covered): which categories have a label, and how many of all."""
    categories = category_dim(label_dim.sparkSession)
    labelled = categories.join(
        F.broadcast(label_id_of_category(label_dim)), "category", "left"
    ).withColumn("present", F.col("label_id").isNotNull())
    # One window over the sixteen categories.
    everything = Window.partitionBy()
    covered = F.concat_ws(
        "/", F.count_if("present").over(everything), F.count("*").over(everything)
    )
    return labelled.select("rank", "category", "present", covered.alias("covered"))


def not_done_before(actions: DataFrame, earlier: DataFrame) -> DataFrame:
    """Actions whose (id, category) is not among the earlier ones."""
    done = earlier.select("id", "category").distinct()
    return actions.join(done, ["id", "category"], "left_anti")
