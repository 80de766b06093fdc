"""The batch jobs end to end: daily run, backfill, labelled set, sample, evaluation."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.times import DEFAULT_ZONE
from ..operators import actions as act
from ..operators.bayes import BayesScorer, train_bayes
from ..operators.evaluation import accuracy_of, build_examples, compare_paired, evaluate_scorers, score_examples
from ..operators.ordering import most_recent, newest_first
from ..operators.predicates import (
    ANYWHERE, INBOX, UNREAD, UNREAD_PRIMARY, require_columns, with_custom_label,
)
from ..operators.reports import run_report
from ..operators.sampling import TRAIN, VAL, stratified_sample
from ..operators.scoring import Scorer, score_messages
from ..schemas import ACTION, EXAMPLE, RAW, REPORT, SAMPLE_COLUMNS, SCORED
from ..sources.ingest import MessageStore
from ..sources.landing import read_label_dim
from ..sources.ledger import BUCKETS, Ledger
from ..sources.tables import (
    action_table, candidate_table, example_table, read_through, report_table, run_of, score_table,
    scored_table, write_candidate_results, write_scored,
)
from .normalise import normalise_messages


@dataclass(frozen=True)
class Job:
    """Where a run reads and writes, and for which day.

    `ledger_buckets` splits the history of done actions; see `sources.ledger`.
    """

    landing: str
    labels: str
    root: str
    day: date
    zone: str = DEFAULT_ZONE
    ledger_buckets: int = BUCKETS


def ingest(spark: SparkSession, job: Job) -> MessageStore:
    """The store of the job with all that has come to the landing folder."""
    store = MessageStore(spark, job.root)
    store.ingest(job.landing, job.day)
    return store


def _newest_raw(store: MessageStore, scope: str, max_messages: int | None) -> DataFrame:
    rows = store.messages(scope)
    newest = rows if max_messages is None else most_recent(rows, max_messages)
    return newest.select(*RAW.names)


def act_on(
    spark: SparkSession, job: Job, scored: DataFrame, run_id: str, connect: Callable[[], act.AddLabel] | None
) -> DataFrame:
    """Plans and carries out what no run has done yet; gives the actions of this run.

    A run that is repeated keeps what it did before and does the rest.
    """
    labels, table = read_label_dim(spark, job.labels), action_table(job.root)
    done = (act.PENDING, act.APPLIED)
    ledger = Ledger(spark, f"{job.root}/done_actions", job.ledger_buckets).take_in(table, done)
    own = table.read(spark, run_id=run_id).where(F.col("outcome").isin(*done)).select(*ACTION.names)
    planned = act.plan_actions(scored, labels)
    fresh = ledger.without_done(planned.where(F.col("outcome") == act.PENDING)).select(*ACTION.names)
    skipped = planned.where(F.col("outcome") == act.SKIPPED).join(own.select("id"), "id", "left_anti")
    due = skipped.select(*ACTION.names).unionByName(fresh)
    if connect is not None:
        due = act.apply_actions(due, connect)
    table.publish(own.unionByName(due), run_id=run_id)
    return table.read(spark, run_id=run_id).select(*ACTION.names)


def _tag(
    spark: SparkSession, job: Job, scope: str, scorer: Scorer, max_messages: int | None,
    reuse: bool, dry_run: bool, connect: Callable[[], act.AddLabel] | None,
) -> DataFrame:
    labels = read_label_dim(spark, job.labels)

    def build() -> DataFrame:
        return normalise_messages(_newest_raw(ingest(spark, job), scope, max_messages), labels, job.zone)

    messages = read_through(spark, job.root, scope, job.day, build, max_messages, reuse)
    write_scored(score_messages(messages, scorer), job.root, scope, job.day, max_messages)
    run = run_of(scope, job.day, max_messages)
    scored = scored_table(job.root).read(spark, **run).select(*SCORED.names)
    run_id = f"{scope}-{run['cap']}-{job.day.isoformat()}"
    actions = None if dry_run else act_on(spark, job, scored, run_id, connect)
    report_table(job.root).publish(run_report(scored, labels, actions), **run)
    return scored


def read_report(spark: SparkSession, job: Job, scope: str, max_messages: int | None = None) -> DataFrame:
    """What a run told: sections in order, lines in order."""
    return report_table(job.root).read(spark, **run_of(scope, job.day, max_messages)).select(*REPORT.names)


def daily_run(
    spark: SparkSession, job: Job, scorer: Scorer, all_tabs: bool = False,
    max_messages: int | None = None, cache: bool = False, dry_run: bool = False,
    connect: Callable[[], act.AddLabel] | None = None,
) -> DataFrame:
    """Unread mail of the inbox, or of its primary tab: stored, scored, labels planned or applied."""
    scope = UNREAD if all_tabs else UNREAD_PRIMARY
    return _tag(spark, job, scope, scorer, max_messages, cache, dry_run, connect)


def tag_recent(
    spark: SparkSession, job: Job, scorer: Scorer, max_messages: int = 1000,
    dry_run: bool = False, connect: Callable[[], act.AddLabel] | None = None,
) -> DataFrame:
    """The newest inbox mail, read or not. A stored table of the day is always used again."""
    return _tag(spark, job, INBOX, scorer, max_messages, True, dry_run, connect)


def labelled_set(
    spark: SparkSession, job: Job, max_messages: int | None = 5000, anywhere: bool = False
) -> DataFrame:
    """Messages among the newest that hold a label made by a user, newest first.

    The label test comes before the bodies are read.
    """
    labels = read_label_dim(spark, job.labels)
    newest = _newest_raw(ingest(spark, job), ANYWHERE if anywhere else INBOX, max_messages)
    chosen = with_custom_label(newest, labels, ids="labelIds")
    return newest_first(normalise_messages(chosen, labels, job.zone))


def sample_labelled(tagged: DataFrame, n: int = 20, seed: int = 42) -> DataFrame:
    """Up to n messages of each category, in the columns reviewers get."""
    return stratified_sample(require_columns(tagged, SAMPLE_COLUMNS), n, seed)


def evaluate(
    sample: DataFrame, truth: DataFrame, scorers: Mapping[str, Scorer], root: str, run_id: str
) -> DataFrame:
    """Accuracy of every candidate on the validation rows, kept under `run_id`."""
    val = build_examples(sample, truth).where(F.col("split") == VAL)
    write_candidate_results(evaluate_scorers(val, scorers), root, run_id)
    return candidate_table(root).read(sample.sparkSession, run_id=run_id)


def evaluate_run(
    sample: DataFrame, truth: DataFrame, scorers: Mapping[str, Scorer], root: str, run_id: str,
    baseline: str, learn: str | None = None,
) -> DataFrame:
    """Examples, their scores and the accuracy of every candidate, each published once, then compared.

    `learn` names a further candidate, a Bayes model of the training examples. Gives
    each candidate against the baseline, with the counts of examples that decide.
    """
    spark = sample.sparkSession
    table = example_table(root)
    table.publish(build_examples(sample, truth), run_id=run_id)
    examples = table.read(spark, run_id=run_id).select(*EXAMPLE.names)
    if learn is not None:
        model = train_bayes(examples.where(F.col("split") == TRAIN))
        scorers = {**scorers, learn: BayesScorer(model)}
    scores = score_table(root)
    scores.publish(score_examples(examples.where(F.col("split") == VAL), scorers), run_id=run_id)
    results = scores.read(spark, run_id=run_id)
    write_candidate_results(accuracy_of(results), root, run_id)
    return compare_paired(results, baseline)
