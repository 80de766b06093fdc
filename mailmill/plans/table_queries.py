"""Every job on the given tables, by name. Each returns whole results."""

from __future__ import annotations

import json
from datetime import date
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..categories import IGNORED_LABELS
from ..functions import prompts
from ..functions.html import html_to_text
from ..functions.labels import main_label, parse_label_text, tag_labels
from ..functions.times import day_stamp, local_iso, utc_moment
from ..operators import actions as act
from ..operators import aggregates as agg
from ..operators import bayes
from ..operators import evaluation as ev
from ..operators import label_sets, lookups, ordering, reports, sampling, scoring, sketches
from ..operators import predicates as pred
from ..schemas import ACTION, REPORT, SAMPLE_COLUMNS, SCORED_CSV
from ..session import work_dir
from ..sources import csv_files, tables
from ..sources.ingest import MessageStore
from ..sources.ledger import Ledger
from ..sources.published import VERSION
from ..sources.registry import Registry
from ..streaming import incremental
from . import jobs, study
from . import table_views as views
from .normalise import normalise_messages

DAY = date(2026, 3, 19)
_BUCKETS = 8


def _joined(labels) -> Column:
    return F.array_join(labels, ",")


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.name_labels(views.mail(spark, sf_dir), views.label_dim(spark, sf_dir))


# Scopes and filters


def scope(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = pred.in_scope(views.mail(spark, sf_dir), name)
    return rows.select("id", "date", F.col("from").alias("sender"), "subject")


def scope_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pred.with_scope_flags(views.mail(spark, sf_dir)).select(
        "id", *[F.col(f).cast("int").alias(f) for f in ("is_inbox", "is_unread", "is_primary")]
    )


def required_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pred.with_all_labels(views.mail(spark, sf_dir), ["INBOX", "Label_q1"]).select("id", "date")


def custom_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A label list without the language labels, which every message holds.
    dim = views.label_dim(spark, sf_dir).where(~F.col("label_name").startswith("LANG_"))
    rows = pred.with_custom_label(views.mail(spark, sf_dir), dim)
    return ordering.newest_first(rows).select("id", "date")


def recent_top_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.most_recent(views.mail(spark, sf_dir), 100).select("id", "date", "subject")


def recent_in_one_second(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same where all messages came within four milliseconds of each other."""
    at = F.timestamp_millis(F.lit(1_704_067_200_000) + F.col("doc_id") % 4)
    rows = views.mail(spark, sf_dir).withColumn("internal_ts", at)
    return ordering.most_recent(rows, 300).select("id", "subject")


def first_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.mail(spark, sf_dir).select("id", F.col("from").alias("sender"))
    return ordering.first_rows(rows, 20, "sender", "id")


def sender_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pred.matching(views.mail(spark, sf_dir), "from", "rc1[0-4]?$")
    return rows.select("id", F.col("from").alias("sender"))


def latest_per_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages with later copies of those that were reviewed."""
    rows = views.mail(spark, sf_dir)
    first = rows.select("id", "subject", F.lit(1).alias("came"))
    copies = rows.where(F.col("quality").isNotNull()).select(
        "id", F.concat(F.lit("Re: "), "subject").alias("subject"), (F.lit(2) + F.col("quality")).alias("came")
    )
    return sampling.latest_per_id(first.unionByName(copies), "came")


def sample_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pred.require_columns(views.scored(spark, sf_dir), SAMPLE_COLUMNS)
    wanted = pred.existing_columns(rows, ("sender", "id", "subject", "category", "reason"))
    return wanted.where(F.col("category").isNotNull())


def tidied_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pred.tidy_columns(
        views.truth(spark, sf_dir), rename={"main_label": "category"}, drop=("reason", "not there")
    )


# Labels


def label_names_mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(spark, sf_dir).select("id", _joined("labels").alias("labels"))


def label_names_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through the join made for label tables too large for a map."""
    named = lookups.name_labels(views.mail(spark, sf_dir), views.label_dim(spark, sf_dir), most=0)
    return named.select("id", _joined("labels").alias("labels"))


def label_names_skewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The join where nine messages in ten hold one and the same list, and the rest one of their own."""
    rows = views.mail(spark, sf_dir)
    same = F.array(F.lit("INBOX"), F.lit("Label_en"), F.lit("Label_c1"))
    own = F.concat("label_ids", F.array(F.concat(F.lit("own_"), "id"), F.lit("INBOX")))
    skewed = rows.withColumn("label_ids", F.when(F.col("doc_id") % 10 == 0, own).otherwise(same))
    named = lookups.name_labels(skewed, views.label_dim(spark, sf_dir), most=0)
    return named.select("id", _joined("labels").alias("labels"))


def label_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    covered = lookups.label_coverage(views.label_dim(spark, sf_dir))
    return covered.withColumn("present", F.col("present").cast("int"))


def label_message_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.tag_label_counts(_named(spark, sf_dir))


def ignored_label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.listed_label_counts(_named(spark, sf_dir))


def distinct_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_sets.all_labels(_named(spark, sf_dir)).orderBy("label")


def tag_label_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_sets.tag_label_set(_named(spark, sf_dir)).orderBy("label")


def custom_labels_in_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_sets.custom_labels_in_use(
        views.mail(spark, sf_dir), views.label_dim(spark, sf_dir)
    )


def categories_of_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    truth = pred.tidy_columns(views.truth(spark, sf_dir))
    return label_sets.union_of_values(truth, views.predicted(spark, sf_dir), "main_label")


def labels_per_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.tags_per_message(_named(spark, sf_dir))


def main_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = tag_labels(F.col("label_ids"), (*IGNORED_LABELS, "Label_en", "Label_fr"))
    return views.mail(spark, sf_dir).select(
        "id", _joined(tags).alias("tags"), main_label(tags).alias("main_label")
    )


def main_label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = _named(spark, sf_dir).select(main_label(tag_labels(F.col("labels"))).alias("main_label"))
    return agg.category_counts(labelled, "main_label")


def parsed_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels written the way Python prints a list, read back; some cells are broken."""
    printed = F.concat(F.lit("['"), F.array_join("label_ids", "', '"), F.lit("']"))
    cell = F.when(F.col("toxic") == 1, "not a list").otherwise(printed)
    rows = views.mail(spark, sf_dir).select("id", cell.alias("cell"))
    parsed = parse_label_text(F.col("cell"))
    return rows.select("id", F.size(parsed).alias("n"), _joined(parsed).alias("labels"))


# Normalisation


def normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = normalise_messages(views.raw(spark, sf_dir), views.label_dim(spark, sf_dir))
    return rows.select(
        "id", "date", F.col("from").alias("sender"), "subject", "body_text",
        _joined("labels").alias("labels"),
    )


def deep_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads up to 3,000 levels deep, cut short, of another type, or with fields of another type."""
    rows = views.raw(spark, sf_dir).withColumn("n", F.col("id").cast("long"))
    levels = (F.col("n") % 4 * 1000).cast("int")
    wrapped = F.concat(
        F.lit('{"headers":[{"name":"subject","value":"deep"}],"parts":['), F.repeat(F.lit('{"parts":['), levels),
        "payload", F.repeat(F.lit("]}"), levels), F.lit("]}"))
    payload = (
        F.when(F.col("n") % 10 == 7, F.left("payload", F.length("payload") - 1))
        .when(F.col("n") % 10 == 8, F.concat(F.lit("["), "payload", F.lit("]")))
        .when(F.col("n") % 10 == 9, F.concat(F.lit('{"body":5,'), F.substr("payload", F.lit(2))))
        .otherwise(wrapped)
    )
    read = normalise_messages(rows.withColumn("payload", payload), views.label_dim(spark, sf_dir), with_errors=True)
    return read.select("id", "subject", "body_text", "payload_error")


def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = views.table(spark, sf_dir, "pages")
    return pages.select("page_id", html_to_text(F.col("html")).alias("page_text"))


def local_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = utc_moment(F.col("millis")).cast("date")
    return views.event_millis(spark, sf_dir).select(
        "event_id", local_iso(F.col("millis")).alias("local_time"), day_stamp(day).alias("stamp")
    )


# Scorer inputs and answers


def prompt_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    prompt = prompts.prompt_text(F.col("subject"), F.col("body_text"))
    with_sender = prompts.prompt_text(F.col("subject"), F.lit(""), F.col("from"))
    return views.mail(spark, sf_dir).select(
        "id", prompt.alias("prompt"), with_sender.alias("head")
    )


def evaluation_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What candidates are shown in an evaluation, whose body limit is a setting of it."""
    body = prompts.cut_body(F.col("body_text"), prompts.EVALUATION_BODY_CHARS)
    return views.mail(spark, sf_dir).select("id", body.alias("body"))


def chat_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = views.table(spark, sf_dir, "conversations")
    instruction = F.concat(F.lit("Answer the "), "role")
    chat = prompts.chat_messages(instruction, prompts.prompt_text(F.col("role"), F.col("text")))
    said = turns.select("conv_id", "turn", F.posexplode(chat).alias("place", "message"))
    return said.select("conv_id", "turn", "place", "message.role", "message.content")


def parsed_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = prompts.parse_response(F.col("response")).alias("answer")
    return views.responses(spark, sf_dir).select("id", parsed).select("id", "answer.*")


# Words that occur in the given texts.
TABLE_RULES = (
    ("OTP_AND_VERIFICATION", ("token", "password")),
    ("UPDATES_NEWSLETTERS", ("apache license", "licensed under")),
    ("TRAVEL_AND_EVENTS", ("pour", "dans")),
    ("SOCIAL_AND_PERSONAL", ("und", "der")),
    ("ADS", ("los", "que")),
)


def rule_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scoring.score_messages(
        views.mail(spark, sf_dir).drop("category", "reason"), scoring.RuleScorer(TABLE_RULES)
    )
    return rows.select("id", "category", "reason")


def default_rule_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scoring.score_messages(
        views.mail(spark, sf_dir).drop("category", "reason"), scoring.RuleScorer()
    )
    return rows.select("id", "category", "reason")


def unread_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily run as one query: unread inbox mail, scored, counted by category."""
    unread = pred.in_scope(views.mail(spark, sf_dir), pred.UNREAD).drop("category", "reason")
    scored = scoring.score_messages(unread, scoring.RuleScorer(TABLE_RULES))
    return agg.category_report(scored)


def _size_client():
    """Answers by the length of the prompt; fails on long ones."""

    def respond(instruction: str, prompt: str) -> str:
        if len(prompt) > 6000:
            raise ValueError("too long")
        name = "ADS" if len(prompt) < 1000 else "OTHERS" if len(prompt) < 4000 else "NO_SUCH"
        return json.dumps({"category": name, "reason_short": f"{len(prompt)} characters"})

    return respond


def client_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scoring.score_messages(
        views.mail(spark, sf_dir).drop("category", "reason"), scoring.ResponseScorer(_size_client)
    )
    return rows.select("id", "category", "reason", "error")


def _bayes_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages learnt from the train rows, predicted for the others."""
    examples = _kept(sampling.train_val_split(views.by_language(spark, sf_dir)), "split")
    model = bayes.train_bayes(examples.where(F.col("split") == sampling.TRAIN))
    val = examples.where(F.col("split") == sampling.VAL).withColumnRenamed("category", "truth")
    return scoring.score_messages(val, bayes.BayesScorer(model))


def bayes_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bayes_scored(spark, sf_dir).select("id", "truth", "category", "reason")


def ml_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.accuracy(_bayes_scored(spark, sf_dir), "truth", "category", "truth")


# Counts and reports


def category_counts(spark: SparkSession, sf_dir: str, keep_null: bool) -> DataFrame:
    return agg.category_counts(views.scored(spark, sf_dir), keep_null=keep_null)


def category_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.category_report(views.scored(spark, sf_dir))


def distinct_over_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimates over ranges of days from states of each day, beside exact counts.

    `is_close` says that an estimate is within four standard errors.
    """
    rows = views.mail(spark, sf_dir).withColumn("day", F.to_date("internal_ts")).withColumn("size", F.col("n_chars"))
    columns = ("id", "from", "size")
    states = sketches.day_states(rows, F.col("day"), *columns)
    root = work_dir(spark, "states")
    states.write.parquet(root)
    kept = spark.read.schema(states.schema).parquet(root)
    parts = []
    for name, first, last in (("first", "2024-01-01", "2024-01-01"), ("all", "2024-01-01", "2100-01-01")):
        inside = F.col("day").between(F.lit(first).cast("date"), F.lit(last).cast("date"))
        told = sketches.estimates(kept.where(inside))
        exact = rows.where(inside).agg(*[F.count_distinct(c).alias(c) for c in columns]).unpivot([], list(columns), "column", "exact")
        close = F.abs(F.col("estimate") - F.col("exact")) <= 4 * sketches.relative_error() * F.col("exact") + 1
        both = told.join(F.broadcast(exact), "column")
        parts.append(both.select(F.lit(name).alias("days"), "column", "exact", "row_count", close.cast("int").alias("is_close")))
    return parts[0].unionByName(parts[1])


def distinct_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.distinct_values(views.scored(spark, sf_dir), "category", "from", "id").withColumnRenamed(
        "from", "senders"
    )


def stage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pred.with_scope_flags(views.scored(spark, sf_dir))
    unread = F.col("is_inbox") & F.col("is_unread")
    return agg.stage_counts(
        rows,
        {
            "fetched": F.lit(True),
            "in_scope": unread,
            "classified": unread & F.col("category").isNotNull(),
            "failed": unread & F.col("category").isNull(),
        },
    )


# Samples and splits


def _kept(df: DataFrame, purpose: str) -> DataFrame:
    """The rows written once, for what reads them several times."""
    path = work_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stratified_sample(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    return sampling.stratified_sample(views.by_language(spark, sf_dir), n).select("id", "category")


def sampled_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without a category are in no group."""
    sampled = sampling.stratified_sample(views.scored(spark, sf_dir), 20)
    return sampled.select("id", "category", "subject")


def train_val_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.train_val_split(views.by_language(spark, sf_dir)).select("id", "category", "split")


def fold_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folds of the whole table, and of seven rows of it."""
    rows = views.by_language(spark, sf_dir)
    parts = []
    for name, some, folds in (("all", rows, 7), ("one language", rows.where(F.col("category") == "es"), 3)):
        split = sampling.fold_split(some, folds)
        parts.append(split.groupBy("fold").agg(F.count("*").alias("n"), F.min("id").alias("first_id")).withColumn("rows", F.lit(name)))
    return parts[0].unionByName(parts[1])


def split_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = sampling.train_val_split(views.by_language(spark, sf_dir))
    counts = ev.split_distribution(split)
    return counts.withColumn("missing_from_train", F.col("missing_from_train").cast("int"))


def few_shot_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    examples = _kept(sampling.train_val_split(views.by_language(spark, sf_dir)), "split")
    sets = sampling.few_shot_sets(examples, {"two each": 2, "five each": 5})
    shown = sets.select("candidate_id", F.posexplode("demonstrations").alias("place", "demo"))
    return shown.select("candidate_id", "place", "demo.id", "demo.category", "demo.body_text")


def few_shot_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    examples = _kept(sampling.train_val_split(views.by_language(spark, sf_dir)), "split")
    rows = sampling.few_shot_rows(examples, {"two hundred each": 200, "five each": 5})
    return rows.select("candidate_id", "place", "id", "category", "body_text")


# Truth, comparison, evaluation


def _sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.scored(spark, sf_dir)


def truth_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.join_truth(_sample(spark, sf_dir), views.truth(spark, sf_dir))


def examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = ev.build_examples(_sample(spark, sf_dir), views.truth(spark, sf_dir))
    return built.select("id", "subject", "category", "split")


def _compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    corrected = pred.tidy_columns(views.truth(spark, sf_dir))
    return ev.compare_labels(views.predicted(spark, sf_dir), corrected)


def label_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.label_mismatches(_compared(spark, sf_dir))


def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.confusion(_compared(spark, sf_dir), "old_label", "new_label")


def accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.accuracy(_compared(spark, sf_dir), "new_label", "old_label", "new_label")


_LIMITS = {"over 500": 500, "over 1500": 1500, "over 3000": 3000}
_BASELINE = "over 1500"


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = ev.join_truth(
        views.mail(spark, sf_dir), views.truth(spark, sf_dir)
    ).where(F.col("category").isNotNull())
    return joined.withColumn("n_chars", F.length("body_text"))


def _candidate_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    guesses = {
        name: F.when(F.col("n_chars") > limit, "Good").otherwise(" bad")
        for name, limit in _LIMITS.items()
    }
    return ev.evaluate_expressions(_judged(spark, sf_dir), guesses)


def candidate_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidate_results(spark, sf_dir)


class _LimitScorer:
    """Reads the limit of its candidate from the row."""

    def __call__(self, inputs: DataFrame) -> DataFrame:
        long = F.length("scored_body") > F.col("over").cast("int")
        none = F.lit(None).cast("string")
        return inputs.withColumns(
            {"category": F.when(long, "GOOD").otherwise("BAD"), "reason": none, "error": none}
        )


def candidate_accuracy_by_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same candidates as settings of one scorer, which sees whole bodies."""
    candidates = [{"candidate_id": name, "over": str(limit)} for name, limit in _LIMITS.items()]
    return ev.evaluate_scorer_by_settings(
        _judged(spark, sf_dir), candidates, _LimitScorer(), max_body_chars=None
    )


def scorer_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rule sets on the languages as classes."""
    rows = views.by_language(spark, sf_dir)
    short = scoring.RuleScorer((("de", ("und",)), ("fr", ("dans",))))
    long = scoring.RuleScorer((("de", ("und", "der")), ("fr", ("dans", "pour")), ("es", ("los", "del"))))
    return ev.evaluate_scorers(rows, {"few words": short, "more words": long}, max_body_chars=None)


def best_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.best_candidate(_candidate_results(spark, sf_dir))


def baseline_and_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.baseline_and_best(_candidate_results(spark, sf_dir), _BASELINE)


def cross_validated_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models of four folds on the fifth, learnt from subjects or from whole messages."""
    rows = _kept(views.by_language(spark, sf_dir), "examples")
    texts = {"subject": F.col("subject"), "whole": bayes.message_text()}
    results = ev.cross_validate(rows, texts)
    return results.groupBy("candidate_id", "fold").agg(F.count("*").alias("n"), F.count_if("is_right").alias("n_correct"))


def evaluation_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Examples written once, three candidates scored on them once, each compared with the first."""
    root = work_dir(spark, "evaluation")
    few = scoring.RuleScorer((("GOOD", ("the",)), ("BAD", ("der", "les"))))
    many = scoring.RuleScorer((("GOOD", ("the", "and", "del")), ("BAD", ("der", "les", "die"))))
    compared = jobs.evaluate_run(
        _sample(spark, sf_dir), views.truth(spark, sf_dir), {"few words": few, "more words": many}, root, "run",
        baseline="few words", learn="bayes")
    return compared


def registered_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The better of two saved candidates, read back and applied to all messages."""
    root = work_dir(spark, "saved")
    few = scoring.RuleScorer((("de", ("und",)), ("fr", ("dans",))))
    many = scoring.RuleScorer((("de", ("und", "der")), ("fr", ("dans", "pour")), ("es", ("los", "del"))))
    rows, scorers = views.by_language(spark, sf_dir), {"few words": few, "more words": many}
    saved = Registry(spark, root)
    saved.save("run", scorers, ev.evaluate_scorers(rows, scorers, max_body_chars=None))
    again = Registry(spark, root)
    best = again.best()
    scored = scoring.score_messages(rows.drop("category"), again.scorer(best))
    return scored.select(F.lit(best.candidate_id).alias("candidate_id"), "id", "category")


def candidate_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = work_dir(spark, "registry")
    results = _candidate_results(spark, sf_dir)
    for run_id in ("first", "second", "second"):
        tables.write_candidate_results(results, root, run_id)
    return tables.candidate_table(root).read(spark).select("run_id", "candidate_id", "n", "n_correct")


# Actions


def _actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return act.plan_actions(views.scored(spark, sf_dir), views.label_dim(spark, sf_dir))


def label_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _actions(spark, sf_dir).select("id", "category", "label_id", "outcome", "skip_reason")


def action_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return act.action_summary(_actions(spark, sf_dir))


def new_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actions left where reviewed mail was done earlier, except for failures."""
    actions = _actions(spark, sf_dir)
    reviewed = views.mail(spark, sf_dir).where(F.col("quality").isNotNull())
    earlier = reviewed.select(
        "id", "category", F.when(F.col("quality") == 1, act.APPLIED).otherwise(act.ERROR).alias("outcome")
    )
    return act.new_actions(actions, earlier).select("id", "category", "label_id")


def _mailbox():
    """Takes any label but those of one message in ten, by the last digit of its id."""

    def add(message_id: str, label_id: str) -> None:
        if message_id.endswith("7"):
            raise PermissionError("read only")

    return add


def applied_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = work_dir(spark, "actions")
    tables.write_actions(act.apply_actions(_actions(spark, sf_dir), _mailbox), root, "run")
    return tables.read_actions(spark, root, ACTION).select("id", "category", "outcome", "error")


def ledger_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows as `new_actions`, from published actions and the ledger made of them."""
    root = work_dir(spark, "ledger")
    reviewed = views.mail(spark, sf_dir).where(F.col("quality").isNotNull())
    outcome = F.when(F.col("quality") == 1, act.APPLIED).otherwise(act.ERROR)
    none = F.lit(None).cast("string")
    earlier = reviewed.select(
        "id", "category", none.alias("label_id"), outcome.alias("outcome"), none.alias("skip_reason"), none.alias("error"))
    table = tables.action_table(root)
    # Two runs of which one is empty.
    table.publish(earlier, run_id="first")
    table.publish(earlier.limit(0), run_id="second")
    done = Ledger(spark, f"{root}/done_actions", _BUCKETS).take_in(table, (act.PENDING, act.APPLIED))
    due = _actions(spark, sf_dir).where(F.col("outcome") == act.PENDING)
    return done.without_done(due).select("id", "category", "label_id")


def rerun_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs repeated with other rows or none, one that stopped before its commit, two caps of a day."""
    root = work_dir(spark, "reruns")
    table, actions = tables.action_table(root), _actions(spark, sf_dir)
    skipped = F.col("outcome") == act.SKIPPED
    for run_id, rows in (
        ("inbox-all", actions), ("inbox-100", actions.where(skipped)), ("emptied", actions),
        ("inbox-all", actions.where(~skipped)), ("emptied", actions.limit(0)),
    ):
        table.publish(rows, run_id=run_id)
    stopped = {"run_id": F.lit("inbox-all"), VERSION: F.lit("stopped")}
    actions.withColumns(stopped).write.mode("append").partitionBy(*stopped).parquet(f"{table.path}/data")
    return table.read(spark).select("run_id", "id", "category", "outcome", "skip_reason")


def scored_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored mail of two caps of one day, the larger one scored twice, read by scope and date."""
    root = work_dir(spark, "scored")
    unread = _fetch(spark, sf_dir)
    for rules, cap in ((TABLE_RULES[:1], None), (TABLE_RULES, 50), (TABLE_RULES, None)):
        scored = scoring.score_messages(ordering.most_recent(unread, cap), scoring.RuleScorer(rules))
        tables.write_scored(scored, root, pred.UNREAD, DAY, cap)
    kept = tables.scored_table(root).read(spark, scope=pred.UNREAD, run_date="19Mar2026")
    return kept.select("scope", "run_date", "cap", "id", "subject", "category", "reason")


def run_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = act.apply_actions(_actions(spark, sf_dir), _mailbox)
    root = work_dir(spark, "report")
    tables.write_actions(done, root, "run")
    kept = tables.read_actions(spark, root)
    told = reports.run_report(views.scored(spark, sf_dir), views.label_dim(spark, sf_dir), kept)
    tables.report_table(root).publish(told, **tables.run_of(pred.INBOX, DAY))
    return tables.report_table(root).read(spark).select(*REPORT.names)


# Files, tables, streams


def _records(raw: DataFrame) -> DataFrame:
    """Landing lines, which carry the payload as an object, not as text."""
    line = F.concat(
        F.lit('{"id":'), _quoted("id"), F.lit(',"labelIds":'), F.to_json("labelIds"),
        F.lit(',"internalDate":'), _quoted("internalDate"), F.lit(',"payload":'), "payload", F.lit("}"),
    )
    return raw.select("id", line.alias("value"))


def landing_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two deliveries, some lines of them cut short, some without an id, taken into the store."""
    root = work_dir(spark, "landing")
    toxic = views.mail(spark, sf_dir).where(F.col("toxic") == 1).select("id", F.lit(True).alias("cut"))
    lines = _records(views.raw(spark, sf_dir)).join(toxic, "id", "left")
    number = F.col("id").cast("long")
    value = (
        F.when(F.col("cut"), F.left("value", F.length("value") - 1))
        .when(number % 10 == 3, F.replace("value", F.lit('{"id":'), F.lit('{"uid":')))
        .otherwise(F.col("value"))
    )
    store = MessageStore(spark, root)
    for part in (0, 1):
        lines.where(number % 2 == part).select(value.alias("value")).write.mode("append").text(f"{root}/landing")
        store.ingest(f"{root}/landing", DAY)
    kept = store.rows.read(spark)
    flags = [F.col(f).cast("int").alias(f) for f in ("is_inbox", "is_unread", "is_primary")]
    return kept.select(
        "kind", "id", F.col("internal_ts").cast("string").alias("sent"), *flags, "reject_reason",
        (F.col("line").isNotNull()).cast("int").alias("has_line"))


def ingested_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unread mail of the store, where a later copy says what was read."""
    root = work_dir(spark, "ingested")
    raw = views.raw(spark, sf_dir)
    unread = raw.withColumn("labelIds", F.array(F.lit("INBOX"), F.lit("UNREAD")))
    reviewed = views.table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("id"))
    store = MessageStore(spark, root)
    for delivery in (unread, raw.join(reviewed, "id", "left_semi")):
        _records(delivery).select("value").write.mode("append").text(f"{root}/landing")
        store.ingest(f"{root}/landing", DAY)
    rows = normalise_messages(store.raw(pred.UNREAD), views.label_dim(spark, sf_dir))
    return rows.select("id", "date", F.col("from").alias("sender"), "subject")


def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored mail to CSV and back, with line breaks and quotes inside cells."""
    path = f"{work_dir(spark, 'csv')}/scored"
    rows = views.scored(spark, sf_dir).select(
        "id", "date", "from", "subject", "body_text", F.col("label_ids").alias("labels"), "category", "reason"
    )
    csv_files.write_csv(rows, path)
    back = csv_files.with_label_lists(csv_files.read_csv(spark, path, SCORED_CSV))
    return back.select(
        "id", "date", F.col("from").alias("sender"), "subject", "body_text",
        _joined("labels").alias("labels"), "category", "reason",
    )


def _scored_csv(spark: SparkSession, sf_dir: str) -> str:
    path = f"{work_dir(spark, 'csv')}/scored"
    rows = views.scored(spark, sf_dir).withColumn("labels", F.col("label_ids"))
    csv_files.write_csv(rows.select(*SCORED_CSV.names), path)
    return path


def label_study(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything that is counted of a labelled CSV file."""
    return study.study(study.read_scored(spark, _scored_csv(spark, sf_dir))).select("section", "position", "name", "n")


def reviewed_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten messages of each category taken from one CSV file into another."""
    path = _scored_csv(spark, sf_dir)
    study.sample_for_review(spark, path, f"{path}-sample", 10)
    schema = StructType([StructField(c, StringType()) for c in SAMPLE_COLUMNS])
    return csv_files.read_csv(spark, f"{path}-sample", schema).select("id", "category", "reason", "body_text")


def compared_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two reviewed files, and what became of their labels."""
    root = work_dir(spark, "reviews")
    reason = F.lit("reviewed").alias("reason")
    for name, rows in (("old", views.predicted(spark, sf_dir)), ("new", pred.tidy_columns(views.truth(spark, sf_dir)))):
        csv_files.write_csv(rows.select("id", "main_label", reason), f"{root}/{name}")
    mismatches, counts = study.compare_reviews(spark, f"{root}/old", f"{root}/new")
    told = counts.select(F.lit("all").alias("id"), *[F.col(c).cast("string").alias(c) for c in counts.columns])
    rows = mismatches.select("id", F.lit(None).cast("string").alias("n_both"), F.col("old_label").alias("old_labels"),
                             F.col("new_label").alias("new_labels"), F.lit(None).cast("string").alias("n_mismatch"))
    return told.unionByName(rows)


def _job(spark: SparkSession, sf_dir: str, purpose: str) -> jobs.Job:
    root = work_dir(spark, purpose)
    _records(views.raw(spark, sf_dir)).select("value").write.text(f"{root}/landing")
    views.label_dim(spark, sf_dir).write.json(f"{root}/labels")
    return jobs.Job(f"{root}/landing", f"{root}/labels", f"{root}/root", DAY, ledger_buckets=_BUCKETS)


_JOB_RULES = (("ADS", ("und", "der")), ("BANK_STATEMENTS", ("pour", "dans")))


def daily_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily run from landing files to applied labels, and once more on the same day."""
    job = _job(spark, sf_dir, "daily")
    for _ in range(2):
        jobs.daily_run(spark, job, scoring.RuleScorer(_JOB_RULES), all_tabs=True, connect=_mailbox)
    return tables.read_actions(spark, job.root).select("id", "category", "label_id", "outcome", "skip_reason", "error")


def dry_run_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same without actions: what was scored, and that nothing was done."""
    job = _job(spark, sf_dir, "dry")
    scored = jobs.daily_run(spark, job, scoring.RuleScorer(_JOB_RULES), dry_run=True)
    done = tables.read_actions(spark, job.root)
    return scored.select("id", "category").unionByName(done.select("id", F.concat(F.lit("done: "), "category").alias("category")))


def _fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    unread = pred.in_scope(views.mail(spark, sf_dir), pred.UNREAD)
    return unread.select("id", "date", "internal_ts", "from", "subject", "body_text", F.col("label_ids").alias("labels"))


def bronze_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second read finds the stored table and never builds."""
    root = work_dir(spark, "bronze")
    tables.read_through(spark, root, pred.UNREAD, DAY, partial(_fetch, spark, sf_dir))

    def never():
        raise AssertionError("built although stored")

    stored = tables.read_through(spark, root, pred.UNREAD, DAY, never)
    return stored.select("id", "date", "subject", "body_text", _joined("labels").alias("labels"))


def run_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = work_dir(spark, "manifest")
    for name in (pred.UNREAD, pred.INBOX):
        fetch = partial(_scope_messages, spark, sf_dir, name)
        tables.read_through(spark, root, name, DAY, fetch)
    return tables.read_manifest(spark, root).select("scope", "run_date", "row_count")


def _scope_messages(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = pred.in_scope(views.mail(spark, sf_dir), name)
    return rows.select(
        "id", "date", "internal_ts", "from", "subject", "body_text", F.col("label_ids").alias("labels")
    )


def incremental_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw records as a stream, in two deliveries of which the second repeats the first.

    Ids leave the state of the stream after a second, so it is the ledger that knows the repeats.
    """
    root = work_dir(spark, "stream")
    raw = views.raw(spark, sf_dir)
    labels = views.label_dim(spark, sf_dir)
    scorer = scoring.RuleScorer(_JOB_RULES)
    records = _records(raw)
    old = records.join(
        views.mail(spark, sf_dir).where(F.col("n_chars") < 2000).select("id"), "id", "left_semi"
    )
    for delivery in (old, records):
        delivery.select("value").write.mode("append").text(f"{root}/landing")
        incremental.start_incremental(
            spark, f"{root}/landing", labels, scorer, root, f"{root}/checkpoint", within="1 second",
            buckets=_BUCKETS,
        ).awaitTermination()
    actions = incremental.read_stream_table(spark, f"{root}/label_actions", ACTION)
    return actions.select("id", "category", "label_id", "outcome", "skip_reason")


def _quoted(column: str) -> Column:
    return F.concat(F.lit('"'), column, F.lit('"'))


QUERIES = {
    "unread_report": unread_report,
    **{f"scope_{name}": partial(scope, name=name) for name in pred.SCOPES},
    "scope_flags": scope_flags,
    "required_labels": required_labels,
    "custom_labelled": custom_labelled,
    "recent_top_n": recent_top_n,
    "recent_in_one_second": recent_in_one_second,
    "first_rows": first_rows,
    "sender_contains": sender_contains,
    "latest_per_id": latest_per_id,
    "sample_columns": sample_columns,
    "tidied_truth": tidied_truth,
    "label_names_mapped": label_names_mapped,
    "label_names_joined": label_names_joined,
    "label_names_skewed": label_names_skewed,
    "label_coverage": label_coverage,
    "label_message_counts": label_message_counts,
    "ignored_label_counts": ignored_label_counts,
    "distinct_labels": distinct_labels,
    "tag_label_set": tag_label_set,
    "custom_labels_in_use": custom_labels_in_use,
    "categories_of_both": categories_of_both,
    "labels_per_message": labels_per_message,
    "main_labels": main_labels,
    "main_label_counts": main_label_counts,
    "parsed_labels": parsed_labels,
    "normalised_messages": normalised,
    "deep_payloads": deep_payloads,
    "page_text": page_text,
    "local_times": local_times,
    "prompt_texts": prompt_texts,
    "evaluation_bodies": evaluation_bodies,
    "chat_messages": chat_messages,
    "parsed_responses": parsed_responses,
    "rule_scores": rule_scores,
    "default_rule_scores": default_rule_scores,
    "client_scores": client_scores,
    "ml_scores": ml_scores,
    "bayes_scores": bayes_scores,
    "fold_sizes": fold_sizes,
    "cross_validated_accuracy": cross_validated_accuracy,
    "evaluation_run": evaluation_run,
    "category_counts": partial(category_counts, keep_null=False),
    "category_counts_with_null": partial(category_counts, keep_null=True),
    "category_report": category_report,
    "distinct_categories": distinct_categories,
    "stage_counts": stage_counts,
    "stratified_sample": partial(stratified_sample, n=20),
    "stratified_sample_large": partial(stratified_sample, n=130),
    "sampled_scored": sampled_scored,
    "train_val_split": train_val_split,
    "split_distribution": split_distribution,
    "few_shot_sets": few_shot_sets,
    "few_shot_rows": few_shot_rows,
    "registered_best": registered_best,
    "distinct_over_days": distinct_over_days,
    "truth_join": truth_join,
    "examples": examples,
    "label_mismatch": label_mismatch,
    "confusion": confusion,
    "accuracy": accuracy,
    "candidate_accuracy": candidate_accuracy,
    "candidate_accuracy_by_settings": candidate_accuracy_by_settings,
    "scorer_accuracy": scorer_accuracy,
    "best_candidate": best_candidate,
    "baseline_and_best": baseline_and_best,
    "candidate_registry": candidate_registry,
    "label_actions": label_actions,
    "action_summary": action_summary,
    "new_actions": new_actions,
    "applied_actions": applied_actions,
    "ledger_actions": ledger_actions,
    "rerun_actions": rerun_actions,
    "scored_table": scored_table,
    "run_report": run_report,
    "landing_messages": landing_messages,
    "ingested_scope": ingested_scope,
    "csv_round_trip": csv_round_trip,
    "label_study": label_study,
    "reviewed_sample": reviewed_sample,
    "compared_reviews": compared_reviews,
    "daily_job": daily_job,
    "dry_run_job": dry_run_job,
    "bronze_cache": bronze_cache,
    "run_manifest": run_manifest,
    "incremental_actions": incremental_actions,
}
