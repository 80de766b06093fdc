"""Scorers: anything that adds `category`, `reason` and `error` to a table of messages.

A scorer gets a DataFrame with at least the columns of `INPUTS` and returns the
same rows with the three columns added. A row it cannot score has null category
and reason.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from operator import or_
from typing import Protocol

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import NaiveBayes
from pyspark.ml.feature import HashingTF, IndexToString, RegexTokenizer, StringIndexer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..categories import CATEGORIES, FALLBACK_CATEGORY, MEANINGS
from ..functions.prompts import (
    cut_body,
    default_instruction,
    parse_response,
    prompt_text,
)
from ..functions.text import or_empty

INPUTS = ("subject", "scored_body")


class Scorer(Protocol):
    def __call__(self, inputs: DataFrame) -> DataFrame: ...


def score_messages(
    messages: DataFrame, scorer: Scorer, max_body_chars: int | None = None, body: str = "body_text"
) -> DataFrame:
    """All rows and columns of `messages`, plus category, reason and error."""
    inputs = messages.withColumn("scored_body", cut_body(F.col(body), max_body_chars))
    scored = scorer(inputs)
    return scored.select(*messages.columns, "category", "reason", "error")


# Words of each category, first match wins. A narrower category stands before
# the wider one that would also match.
DEFAULT_RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("OTP_AND_VERIFICATION", ("otp", "one-time password", "verification code", "sign-in code", "passcode")),
    ("SECURITY_ALERTS", ("new login", "new sign-in", "new device", "password was changed", "security alert", "data archive")),
    ("AMAZON_PAY", ("amazon pay",)),
    ("AUTO_DEBIT_REMINDERS", ("e-mandate", "auto debit", "auto-debit", "upcoming payment", "scheduled payment")),
    ("BANK_STATEMENTS", ("e-statement", "account statement", "card statement", "monthly statement")),
    ("INVESTMENTS_FINANCIAL_UPDATES", ("mutual fund", "demat", "dividend", "postal ballot", "stock market")),
    ("BANKING_FINANCIAL_OFFERS", ("pre-approved", "personal loan", "credit card offer", "card upgrade")),
    ("REFUNDS_REWARDS", ("refund", "cashback", "reward points", "loyalty points")),
    ("TRANSACTION_ALERT", ("was credited", "was debited", "upi", "imps", "neft")),
    ("JOB_OPPORTUNITIES", ("recruiter", "job alert", "your application", "we are hiring")),
    ("TRAVEL_AND_EVENTS", ("itinerary", "boarding pass", "hotel booking", "booking id", "your trip", "movie ticket")),
    ("ORDERS_SUBSCRIPTIONS", ("your order", "out for delivery", "delivered", "subscription renewal")),
    ("UPDATES_NEWSLETTERS", ("newsletter", "privacy policy", "terms of service", "scheduled maintenance", "welcome to")),
    ("SOCIAL_AND_PERSONAL", ("invitation", "connection request", "shared a photo", "calendar invite")),
    ("ADS", ("sale", "percent off", "discount", "limited time offer")),
)


def _escape(word: str) -> str:
    return re.sub(r"([^\w \-%])", r"\\\1", word)


def word_pattern(words: tuple[str, ...]) -> str:
    """Matches any of the words, standing alone, in lower-case text."""
    return "(?:^|[^a-z0-9])(?:" + "|".join(map(_escape, words)) + ")(?:[^a-z0-9]|$)"


def holds_word(text: Column, words: tuple[str, ...]) -> Column:
    """Whether lower-case text has any of the words, standing alone.

    A plain search for the letters is many times faster than the pattern, and
    finds nothing in most texts; only its hits are looked at again.
    """
    letters = reduce(or_, [text.contains(w) for w in words])
    return letters & text.rlike(word_pattern(words))


def any_word_pattern(words: Iterable[str]) -> str:
    """One pattern for many words, grouped by first letter so that most places fail at one look."""
    by_letter: dict[str, list[str]] = {}
    for word in sorted(set(words)):
        by_letter.setdefault(word[0], []).append(_escape(word[1:]))
    groups = "|".join(f"{letter}(?:{'|'.join(rest)})" for letter, rest in by_letter.items())
    return f"(?<![a-z0-9])(?:{groups})(?![a-z0-9])"


class RuleScorer:
    """Words decide; the first rule that matches wins.

    Texts without any word of any rule leave after one search.
    """

    def __init__(self, rules: tuple[tuple[str, tuple[str, ...]], ...] = DEFAULT_RULES):
        self.rules = rules

    def category(self, text: Column) -> Column:
        """Category of lower-case text."""
        every_word = any_word_pattern(w for _, words in self.rules for w in words)
        category = F.when(~text.rlike(every_word), FALLBACK_CATEGORY)
        for name, words in self.rules:
            category = category.when(holds_word(text, words), name)
        return category.otherwise(FALLBACK_CATEGORY)

    def reason(self, category: Column) -> Column:
        return F.when(category == FALLBACK_CATEGORY, "no rule matched").otherwise(
            F.concat(F.lit("words of "), category)
        )

    def __call__(self, inputs: DataFrame) -> DataFrame:
        text = F.lower(F.concat(or_empty(F.col("subject")), F.lit("\n"), F.col("scored_body")))
        # A column of its own, so that it is made once for all rules.
        scored = inputs.withColumn("_text", text).withColumn("category", self.category(F.col("_text")))
        return scored.withColumns(
            {"reason": self.reason(F.col("category")), "error": F.lit(None).cast("string")}
        ).drop("_text")


_ANSWER = StructType(
    [StructField("response", StringType()), StructField("error", StringType())]
)

# Given an instruction and a prompt, the JSON text of an answer.
Respond = Callable[[str, str], str]


class ResponseScorer:
    """A Python client answers each prompt with JSON, which is checked in the JVM.

    `connect` runs once per task. Only the prompt goes to Python and only the
    answer comes back; the other columns of the row stay in the JVM. A fault
    leaves the row without a category and says why.
    """

    def __init__(
        self,
        connect: Callable[[], Respond],
        instruction: str | None = None,
        send_sender: bool = False,
        categories: tuple[str, ...] = CATEGORIES,
    ):
        self.connect = connect
        self.instruction = default_instruction(categories, MEANINGS) if instruction is None else instruction
        self.send_sender = send_sender
        self.categories = categories

    def __call__(self, inputs: DataFrame) -> DataFrame:
        connect, instruction = self.connect, self.instruction

        @F.pandas_udf(_ANSWER)
        def answer(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            respond = connect()

            def one(prompt: str) -> tuple[str | None, str | None]:
                try:
                    return respond(instruction, prompt), None
                except Exception as fault:  # noqa: BLE001 - any fault of a client is a row's error
                    return None, f"{type(fault).__name__}: {fault}"

            for prompts in batches:
                yield pd.DataFrame(
                    [one(p) for p in prompts], columns=["response", "error"], dtype=object
                )

        sender = F.col("from") if self.send_sender else None
        prompt = prompt_text(F.col("subject"), F.col("scored_body"), sender)
        # Not deterministic for the planner: a filter on the answer must not ask a second time.
        answered = inputs.withColumn("_answer", answer.asNondeterministic()(prompt))
        parsed = parse_response(F.col("_answer")["response"], self.categories)
        checked = answered.withColumn("_parsed", parsed)
        fault = F.coalesce(
            F.col("_answer")["error"],
            F.when(F.col("_parsed")["category"].isNull(), F.lit("invalid answer")),
        )
        return checked.withColumns(
            {
                "category": F.col("_parsed")["category"],
                "reason": F.col("_parsed")["reason"],
                "error": fault,
            }
        ).drop("_answer", "_parsed")


def train_model(
    examples: DataFrame, text: Column | None = None, label: str = "category", features: int = 1 << 16
) -> PipelineModel:
    """Naive Bayes on hashed word counts. What reaches the driver is one row of sums per category."""
    text = _subject_and_body("body_text") if text is None else text
    rows = examples.where(F.col(label).isNotNull()).select(text.alias("_text"), F.col(label))
    stages = [
        StringIndexer(inputCol=label, outputCol="_label", stringOrderType="alphabetAsc"),
        RegexTokenizer(inputCol="_text", outputCol="_words", pattern=r"[^\p{L}\p{N}]+"),
        HashingTF(inputCol="_words", outputCol="_features", numFeatures=features),
        NaiveBayes(
            featuresCol="_features", labelCol="_label", predictionCol="_prediction",
            probabilityCol="_probability", rawPredictionCol="_raw",
        ),
    ]
    fitted = Pipeline(stages=stages).fit(rows)
    names = IndexToString(
        inputCol="_prediction", outputCol="_category", labels=fitted.stages[0].labels
    )
    # Scoring needs no label, so the indexer is left out.
    return PipelineModel(stages=[*fitted.stages[1:], names])


def _subject_and_body(body: str) -> Column:
    return F.concat(or_empty(F.col("subject")), F.lit("\n"), or_empty(F.col(body)))


class ModelScorer:
    """A fitted pipeline of `train_model`."""

    def __init__(self, model: PipelineModel):
        self.model = model

    def __call__(self, inputs: DataFrame) -> DataFrame:
        scored = self.model.transform(inputs.withColumn("_text", _subject_and_body("scored_body")))
        return scored.withColumns(
            {
                "category": F.col("_category"),
                "reason": F.lit("trained on labelled messages"),
                "error": F.lit(None).cast("string"),
            }
        ).drop("_text", "_words", "_features", "_raw", "_probability", "_prediction", "_category")
