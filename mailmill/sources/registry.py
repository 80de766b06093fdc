"""Candidates kept with their settings and their score, and read back as scorers.

A run's candidates are published together. Settings are one JSON document each; what is
too large for one, the counts of a model or the demonstrations of a prompt, lies in
tables beside it, which the document names.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from itertools import starmap

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions.prompts import default_instruction
from ..operators.bayes import BayesScorer, load_bayes, save_bayes
from ..operators.scoring import Respond, ResponseScorer, RuleScorer, Scorer
from ..schemas import CANDIDATE
from .published import PublishedTable

RULES, BAYES, RESPONSES = "rules", "bayes", "responses"
_PROMPT = "Subject: {}\nBody: {}"


class Registry:
    """Candidates under `root`."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self.table = PublishedTable(f"{root}/registry", CANDIDATE, ("run_id",))

    def _document(self, version: str, name: str, scorer: Scorer) -> tuple[str, dict]:
        if isinstance(scorer, RuleScorer):
            return RULES, {"rules": scorer.rules}
        if isinstance(scorer, BayesScorer):
            path = f"{self.root}/models/{version}/{name}"
            save_bayes(scorer.model, path)
            return BAYES, {"path": path}
        if isinstance(scorer, ResponseScorer):
            told = {"instruction": scorer.instruction, "send_sender": scorer.send_sender, "categories": scorer.categories}
            return RESPONSES, told
        raise TypeError(f"no settings of a {type(scorer).__name__} are known")

    def save(self, run_id: str, scorers: Mapping[str, Scorer], results: DataFrame) -> None:
        """Settings of the scorers with their rows of `results`: candidate_id, n, n_correct, accuracy_pct."""
        # Each save has its own folder, so that a repeated one overwrites nothing.
        version = self.spark.sql("select uuid() as version").first().version
        documents = [
            (name, *_told(self._document(version, name, scorer))) for name, scorer in scorers.items()
        ]
        told = self.spark.createDataFrame(documents, "candidate_id string, kind string, settings string")
        # One row for each candidate on both sides.
        self.table.publish(F.broadcast(told).join(results, "candidate_id"), run_id=run_id)

    def candidates(self) -> DataFrame:
        return self.table.read(self.spark)

    def best(self) -> Row | None:
        """The most accurate candidate of all runs; of equals the first by name, then by run."""
        order = (F.desc("accuracy_pct"), F.col("candidate_id"), F.col("run_id"))
        return self.candidates().orderBy(*order).first()

    def scorer(self, candidate: Row, connect: Callable[[], Respond] | None = None) -> Scorer:
        """The candidate as it was saved. A client is not saved; `connect` makes one."""
        settings = json.loads(candidate.settings)
        if candidate.kind == RULES:
            return RuleScorer(tuple((name, tuple(words)) for name, words in settings["rules"]))
        if candidate.kind == BAYES:
            return BayesScorer(load_bayes(self.spark, settings["path"]))
        if connect is None:
            raise ValueError(f"candidate {candidate.candidate_id!r} needs a client")
        return ResponseScorer(connect, settings["instruction"], settings["send_sender"], tuple(settings["categories"]))


def _told(document: tuple[str, dict]) -> tuple[str, str]:
    kind, settings = document
    return kind, json.dumps(settings, ensure_ascii=False)


def instruction_with(demonstrations: DataFrame, candidate_id: str, **options) -> str:
    """The instruction of a candidate with its rows of `few_shot_rows`, in their order.

    They all stand in one prompt, so they are as few as a prompt can hold.
    """
    own = demonstrations.where(F.col("candidate_id") == candidate_id).orderBy("place")
    rows = own.select("subject", "body_text", "category").collect()
    shown = starmap(lambda subject, body, category: (_PROMPT.format(subject or "", body or ""), category), rows)
    return default_instruction(demonstrations=shown, **options)
