"""Label actions: planned, carried out through a plug-in, counted."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import ACTION
from .bounded import broadcast_if_small
from .lookups import label_id_of_category, not_done_before

SKIPPED, PENDING, APPLIED, ERROR = "skipped", "pending", "applied", "error"


def plan_actions(
    scored: DataFrame, label_dim: DataFrame, categories: DataFrame | None = None
) -> DataFrame:
    """One row per scored message: add a label, or skip and why."""
    label_ids = label_id_of_category(label_dim, categories)
    # At most sixteen rows, unless other categories are given.
    label_ids = F.broadcast(label_ids) if categories is None else broadcast_if_small(label_ids)
    named = F.nullif(F.col("category"), F.lit(""))
    planned = scored.select("id", named.alias("category")).join(label_ids, "category", "left")
    reason = F.when(F.col("category").isNull(), "no category").when(
        F.col("label_id").isNull(), "no label"
    )
    return planned.select(
        "id",
        "category",
        "label_id",
        F.when(reason.isNull(), PENDING).otherwise(SKIPPED).alias("outcome"),
        reason.alias("skip_reason"),
        F.lit(None).cast("string").alias("error"),
    )


def new_actions(actions: DataFrame, earlier: DataFrame) -> DataFrame:
    """Pending actions not carried out by an earlier run; a failed one is tried again."""
    done = earlier.where(F.col("outcome").isin(PENDING, APPLIED))
    return not_done_before(actions.where(F.col("outcome") == PENDING), done)


# Given message id and label id, adds the label or raises.
AddLabel = Callable[[str, str], None]


def apply_actions(actions: DataFrame, connect: Callable[[], AddLabel]) -> DataFrame:
    """Carries out the pending actions; skipped rows pass through.

    Adding a label twice changes nothing, so a task that is run again does no
    harm. Write the result once and read it from there: every evaluation of it
    calls the plug-in again.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        add = None
        for batch in batches:
            outcomes, errors = [], []
            for row in batch.itertuples(index=False):
                outcome, error = row.outcome, row.error
                if outcome == PENDING:
                    add = add or connect()
                    try:
                        add(row.id, row.label_id)
                        outcome = APPLIED
                    except Exception as fault:  # noqa: BLE001 - a fault is the row's outcome
                        outcome, error = ERROR, f"{type(fault).__name__}: {fault}"
                outcomes.append(outcome)
                errors.append(error)
            yield batch.assign(outcome=outcomes, error=errors)

    return actions.select(*ACTION.names).mapInPandas(run, ACTION)


def action_summary(actions: DataFrame) -> DataFrame:
    """Rows per outcome and reason."""
    return actions.groupBy("outcome", "skip_reason").agg(F.count("*").alias("n"))
