"""What a run tells about itself, as one small table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import REPORT
from .actions import ERROR, action_summary
from .aggregates import category_report, stage_counts
from .lookups import label_coverage

LABELS, STAGES, CATEGORIES, ACTIONS, ERRORS = "labels", "stages", "categories", "actions", "errors"
SHOWN_ERRORS = 5


def section(df: DataFrame, kind: str, position: Column, **columns: Column) -> DataFrame:
    """Rows of a report; columns that are not given are null."""
    given = {"section": F.lit(kind), "position": position, **columns}
    return df.select(*[
        given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in REPORT.fields
    ])


def run_report(scored: DataFrame, label_dim: DataFrame, actions: DataFrame | None = None) -> DataFrame:
    """Labels there are, rows per stage, rows per category, outcomes of actions, first faults.

    Every section is made of counts or of a bounded list, so the report stays small
    whatever the run.
    """
    # Windows run over categories, outcomes or a handful of faults.
    every = Window.partitionBy()
    parts = [section(
        label_coverage(label_dim), LABELS, F.col("rank"), name=F.col("category"),
        n=F.col("present").cast("int"), detail=F.col("covered"))]
    done = F.col("category").isNotNull()
    stages = {"fetched": F.lit(True), "classified": done, "failed": ~done}
    place = F.array_position(F.array(*map(F.lit, stages)), F.col("stage"))
    parts.append(section(stage_counts(scored, stages), STAGES, place, name=F.col("stage"), n=F.col("n")))
    by_size = Window.partitionBy().orderBy(F.desc("n"), "category")
    parts.append(section(
        category_report(scored).withColumn("place", F.row_number().over(by_size)), CATEGORIES, F.col("place"),
        name=F.col("category"), n=F.col("n"), share_pct=F.col("share_pct"), detail=F.col("bar")))
    if actions is not None:
        by_name = Window.partitionBy().orderBy("outcome", "skip_reason")
        counts = action_summary(actions).withColumn("place", F.row_number().over(by_name))
        share = F.lit(100.0) * F.col("n") / F.sum("n").over(every)
        parts.append(section(
            counts.withColumn("share", share), ACTIONS, F.col("place"), name=F.col("outcome"), n=F.col("n"),
            share_pct=F.col("share"), detail=F.col("skip_reason")))
        first = actions.where(F.col("outcome") == ERROR).orderBy("id", "category").limit(SHOWN_ERRORS)
        placed = first.withColumn("place", F.row_number().over(Window.partitionBy().orderBy("id", "category")))
        parts.append(section(placed, ERRORS, F.col("place"), name=F.col("id"), detail=F.col("error")))
    return reduce(DataFrame.unionByName, parts)
