"""Labelled examples, accuracy of candidates, comparison of labels."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.prompts import EVALUATION_BODY_CHARS
from ..functions.text import comparable, or_empty, strip
from .bayes import predict_bayes, train_folds
from .predicates import labels_differ, tidy_columns
from .sampling import TRAIN, VAL, fold_split, train_val_split
from .scoring import Scorer, score_messages


def join_truth(sample: DataFrame, truth: DataFrame) -> DataFrame:
    """Sample features with the corrected label; any label the sample came with is not used."""
    features = sample.select("id", "subject", "body_text")
    corrected = tidy_columns(truth).select(
        "id", F.col("main_label").alias("category"), F.col("reason").alias("truth_reason")
    )
    return features.join(corrected, "id")


def build_examples(
    sample: DataFrame, truth: DataFrame, ratio: float = 0.75, seed: int = 42
) -> DataFrame:
    """Examples with their split. Rows whose truth is missing are no examples."""
    joined = join_truth(sample, truth).where(F.col("category").isNotNull())
    examples = joined.select(
        "id",
        or_empty(F.col("subject")).alias("subject"),
        or_empty(F.col("body_text")).alias("body_text"),
        strip(F.col("category")).alias("category"),
    )
    return train_val_split(examples, ratio, seed)


def split_distribution(examples: DataFrame) -> DataFrame:
    """Train and val rows per category with a total, and a flag for classes never trained on."""
    counts = examples.groupBy("category").agg(
        F.count_if(F.col("split") == TRAIN).alias("train"),
        F.count_if(F.col("split") == VAL).alias("val"),
    )
    # The roll-up expands the counts of categories, not the examples.
    rolled = counts.rollup("category").agg(
        F.grouping("category").cast("int").alias("is_total"),
        F.sum("train").alias("train"),
        F.sum("val").alias("val"),
    )
    total = F.col("is_total") == 1
    return rolled.select(
        F.when(total, "TOTAL").otherwise(F.col("category")).alias("category"),
        "is_total",
        F.coalesce("train", F.lit(0)).alias("train"),
        F.coalesce("val", F.lit(0)).alias("val"),
        (~total & (F.col("train") == 0)).alias("missing_from_train"),
    ).orderBy("is_total", "category")


def compare_labels(old: DataFrame, new: DataFrame, label: str = "main_label") -> DataFrame:
    """(id, old_label, new_label) of the ids in both."""
    before = old.select("id", F.col(label).alias("old_label"))
    after = new.select("id", F.col(label).alias("new_label"))
    return before.join(after, "id")


def label_mismatches(compared: DataFrame) -> DataFrame:
    return compared.where(labels_differ(F.col("old_label"), F.col("new_label")))


def is_right(truth: Column, prediction: Column) -> Column:
    """Exact match up to letter case and outer white space; no prediction is wrong."""
    return F.coalesce(comparable(truth) == comparable(prediction), F.lit(False))


def _percent(right: Column, n: Column) -> Column:
    return F.lit(100.0) * right / n


def accuracy(df: DataFrame, truth: str, prediction: str, *by: str) -> DataFrame:
    """Rows, right ones and their share in percent, per group if asked."""
    return (
        df.groupBy(*by)
        .agg(
            F.count("*").alias("n"),
            F.count_if(is_right(F.col(truth), F.col(prediction))).alias("n_correct"),
        )
        .withColumn("accuracy_pct", _percent(F.col("n_correct"), F.col("n")))
    )


def evaluate_expressions(
    val: DataFrame, candidates: Mapping[str, Column], truth: str = "category"
) -> DataFrame:
    """Accuracy of candidates that are column expressions, all in one pass.

    Each candidate is one more counter of the same aggregation; rows are not
    multiplied.
    """
    counters = [
        F.count_if(is_right(F.col(truth), prediction)).alias(name)
        for name, prediction in candidates.items()
    ]
    counted = val.agg(F.count("*").alias("_n"), *counters)
    long = counted.unpivot("_n", list(candidates), "candidate_id", "n_correct")
    return long.select(
        "candidate_id",
        F.col("_n").alias("n"),
        "n_correct",
        _percent(F.col("n_correct"), F.col("_n")).alias("accuracy_pct"),
    )


def expand_candidates(val: DataFrame, candidates: list[dict[str, str]]) -> DataFrame:
    """Every validation row once per candidate, its settings beside it.

    The candidates are a constant array, so this is a projection: nothing is
    joined or shuffled, and the repeated bodies go no further than the scorer.
    """
    items = F.array(
        *[F.struct(*[F.lit(v).alias(k) for k, v in c.items()]) for c in candidates]
    )
    return val.select("*", F.inline(items))


def evaluate_scorer_by_settings(
    val: DataFrame, candidates: list[dict[str, str]], scorer: Scorer, truth: str = "category",
    max_body_chars: int | None = EVALUATION_BODY_CHARS,
) -> DataFrame:
    """Accuracy per candidate of one scorer that reads its settings from columns.

    Each candidate has a `candidate_id`.
    """
    rows = expand_candidates(val.withColumnRenamed(truth, "truth"), candidates)
    scored = score_messages(rows, scorer, max_body_chars)
    return accuracy(scored.select("candidate_id", "truth", "category"), "truth", "category", "candidate_id")


def evaluate_scorers(
    val: DataFrame, scorers: Mapping[str, Scorer], truth: str = "category",
    max_body_chars: int | None = EVALUATION_BODY_CHARS,
) -> DataFrame:
    """Accuracy per candidate where each candidate is a scorer of its own."""
    rows = val.withColumnRenamed(truth, "truth")
    results = None
    for name, scorer in scorers.items():
        scored = score_messages(rows, scorer, max_body_chars).select("truth", "category")
        one = accuracy(scored, "truth", "category").select(F.lit(name).alias("candidate_id"), "*")
        results = one if results is None else results.unionByName(one)
    return results


def score_examples(
    val: DataFrame, scorers: Mapping[str, Scorer], truth: str = "category",
    max_body_chars: int | None = EVALUATION_BODY_CHARS,
) -> DataFrame:
    """(candidate_id, id, truth, guess, is_right): every example under every candidate, scored once."""
    rows = val.withColumnRenamed(truth, "truth")
    results = None
    for name, scorer in scorers.items():
        scored = score_messages(rows, scorer, max_body_chars)
        one = scored.select(
            F.lit(name).alias("candidate_id"), "id", "truth", F.col("category").alias("guess"),
            is_right(F.col("truth"), F.col("category")).alias("is_right"),
        )
        results = one if results is None else results.unionByName(one)
    return results


def accuracy_of(results: DataFrame) -> DataFrame:
    """Accuracy per candidate of `score_examples`."""
    counted = results.groupBy("candidate_id").agg(F.count("*").alias("n"), F.count_if("is_right").alias("n_correct"))
    return counted.withColumn("accuracy_pct", _percent(F.col("n_correct"), F.col("n")))


def compare_paired(results: DataFrame, baseline: str) -> DataFrame:
    """Each candidate against the baseline, example by example.

    `only_candidate` and `only_baseline` are what decides; `deviation` is their
    difference in standard deviations if both were equally likely, 0 without any.
    """
    own = results.where(F.col("candidate_id") == baseline).select("id", F.col("is_right").alias("_base"))
    both = results.where(F.col("candidate_id") != baseline).join(own, "id")
    right, base = F.col("is_right"), F.col("_base")
    counted = both.groupBy("candidate_id").agg(
        F.count("*").alias("n"), F.count_if(right & base).alias("both"), F.count_if(right & ~base).alias("only_candidate"),
        F.count_if(~right & base).alias("only_baseline"), F.count_if(~right & ~base).alias("neither"))
    difference = F.col("only_candidate") - F.col("only_baseline")
    decided = F.col("only_candidate") + F.col("only_baseline")
    return counted.withColumns({
        "gain_pct": _percent(difference, F.col("n")),
        "deviation": F.when(decided > 0, difference / F.sqrt(decided.cast("double"))).otherwise(F.lit(0.0)),
    })


def cross_validate(
    examples: DataFrame, texts: Mapping[str, Column], folds: int = 5, seed: int = 42
) -> DataFrame:
    """(candidate_id, id, fold, truth, guess, is_right) of Bayes models that never saw the example.

    Candidates are the texts that models learn from. Each example is scored once
    per candidate, by the model of the folds it is not in.
    """
    rows = fold_split(examples.where(F.col("category").isNotNull()), folds, seed)
    results = None
    for name, text in texts.items():
        model = train_folds(rows, folds, text)
        guesses = predict_bayes(rows.drop("category"), model, text, met=model.met())
        one = rows.select("id", "fold", F.col("category").alias("truth")).join(
            guesses.withColumnRenamed("category", "guess"), "id")
        one = one.select(
            F.lit(name).alias("candidate_id"), "id", "fold", "truth", "guess",
            is_right(F.col("truth"), F.col("guess")).alias("is_right"))
        results = one if results is None else results.unionByName(one)
    return results


def best_candidate(results: DataFrame) -> DataFrame:
    """The most accurate candidate; of equals the first by id."""
    return results.orderBy(F.desc("accuracy_pct"), "candidate_id").limit(1)


def baseline_and_best(results: DataFrame, baseline: str) -> DataFrame:
    """One row: accuracy of the baseline, the best candidate, its accuracy, the difference."""
    base = F.max(F.when(F.col("candidate_id") == baseline, F.col("accuracy_pct")))
    # Negated accuracy first, so that the smallest is the most accurate, first by id.
    first = F.min(F.struct((-F.col("accuracy_pct")).alias("below"), "candidate_id"))
    return results.agg(base.alias("baseline_pct"), first.alias("first")).select(
        "baseline_pct",
        F.col("first")["candidate_id"].alias("best_id"),
        (-F.col("first")["below"]).alias("best_pct"),
        (-F.col("first")["below"] - F.col("baseline_pct")).alias("gain_pct"),
    )
