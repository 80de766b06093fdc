"""The tables a run writes: the raw cache, scored messages, actions, reports, candidate results.

All are published in versions (`sources.published`): a run or a batch that is repeated
replaces its own rows by one commit, also by none, and one that stops leaves the rows of
before. The partitions of a run are named by scope, date and cap, so that runs of other
caps keep theirs.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.times import day_stamp
from ..schemas import ACTION, CANDIDATE_RESULT, EXAMPLE, EXAMPLE_SCORE, MESSAGE, REPORT, SCORED
from .published import PublishedTable

RUN = ("scope", "run_date", "cap")


def run_stamp(day: date):
    """Run date as the stamp used in partition names, 19Mar2026."""
    return day_stamp(F.lit(day))


def _cap_name(max_messages: int | None) -> str:
    return "all" if max_messages is None else str(max_messages)


def run_of(scope: str, day: date, max_messages: int | None = None) -> dict[str, str]:
    """The partition of a run."""
    return {"scope": scope, "run_date": day.strftime("%d%b%Y"), "cap": _cap_name(max_messages)}


def raw_table(root: str) -> PublishedTable:
    return PublishedTable(f"{root}/messages", MESSAGE, RUN)


def scored_table(root: str) -> PublishedTable:
    return PublishedTable(f"{root}/scored", SCORED, RUN)


def action_table(root: str) -> PublishedTable:
    return PublishedTable(f"{root}/label_actions", ACTION, ("run_id",))


def report_table(root: str) -> PublishedTable:
    return PublishedTable(f"{root}/reports", REPORT, RUN)


def example_table(root: str) -> PublishedTable:
    return PublishedTable(f"{root}/examples", EXAMPLE, ("run_id",))


def score_table(root: str) -> PublishedTable:
    return PublishedTable(f"{root}/example_scores", EXAMPLE_SCORE, ("run_id",))


def candidate_table(root: str) -> PublishedTable:
    return PublishedTable(f"{root}/candidate_results", CANDIDATE_RESULT, ("run_id",))


def read_manifest(spark: SparkSession, root: str) -> DataFrame:
    """Finished raw partitions with their row counts; no rows before the first run."""
    return raw_table(root).valid(spark).select(
        "scope", "run_date", F.col("cap").try_cast("bigint").alias("max_messages"), "row_count")


def read_through(
    spark: SparkSession,
    root: str,
    scope: str,
    day: date,
    build: Callable[[], DataFrame],
    max_messages: int | None = None,
    reuse: bool = True,
) -> DataFrame:
    """The raw table of a scope, day and cap: as published, or built and published."""
    table, run = raw_table(root), run_of(scope, day, max_messages)
    if not (reuse and table.is_published(spark, **run)):
        table.publish(build(), **run)
    return table.read(spark, **run).select(*MESSAGE.names)


def write_scored(scored: DataFrame, root: str, scope: str, day: date, max_messages: int | None = None) -> None:
    """Scored messages of a run, apart from the raw ones they came from."""
    scored_table(root).publish(scored, **run_of(scope, day, max_messages))


def write_actions(actions: DataFrame, root: str, run_id: str) -> None:
    action_table(root).publish(actions, run_id=run_id)


def read_actions(spark: SparkSession, root: str, schema: StructType = ACTION) -> DataFrame:
    """The actions of all runs, as last published; none before the first run."""
    return action_table(root).read(spark).select(*schema.names)


def write_candidate_results(results: DataFrame, root: str, run_id: str) -> None:
    candidate_table(root).publish(results, run_id=run_id)
