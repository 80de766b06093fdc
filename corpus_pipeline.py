"""A corpus from raw documents: toxic ones go, repeated passages and near copies go,
documents that hold benchmark items go, and what stays is encoded.

Each stage takes all that the one before kept, and gives the columns of
`documents` on; the last gives the ids of its tokens. Between stages the rows are
written to the shared work folder and read again.

Rows without an id stay in every stage that names rows by id; null texts are
empty texts; further columns are carried along, whatever their names. Repeated rows
become one in the third stage; an id with two texts keeps both, unless other texts
are near copies of them. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailmill.llm.bpe import round_trip
from mailmill.llm.decontaminate import without_contaminated
from mailmill.llm.jaccard import near_duplicates
from mailmill.llm.lines import dedup_lines
from mailmill.llm.tables import stored, table
from mailmill.llm.toxicity import score_toxicity, train_toxicity

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _rows(docs: DataFrame, *columns: str) -> DataFrame:
    """The columns an operator needs beside the whole row, so that no names of columns meet."""
    return docs.select(*columns, F.struct(*docs.columns).alias("_row"))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network calls toxic go."""
    model = train_toxicity(docs, table(spark, sf_dir, "labels"))
    return score_toxicity(_rows(docs, "text"), model).where("predicted = 0").select("_row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that another document holds are cut; documents of which nothing is left go."""
    further = [c for c in docs.columns if c not in ("doc_id", "text")]
    cut = dedup_lines(docs.select("doc_id", "text", F.struct(*further).alias("_row")))
    columns = {c: F.col("_row")[c] for c in further}
    if "n_chars" in further:
        # The length is that of the text as it now is, where it was cut.
        now = F.when(F.col("n_removed_words") > 0, F.length("text")).otherwise(columns["n_chars"])
        columns["n_chars"] = now.cast(docs.schema["n_chars"].dataType)
    return cut.select(*[columns.get(c, F.col(c)).alias(c) for c in docs.columns])


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of the smallest id stays."""
    groups = near_duplicates(docs, links=False)
    gone = groups.where("doc_id is not null and doc_id != class_id").select("doc_id").distinct()
    kept = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    # Repeated rows of one id and text are copies too.
    named = kept.where("doc_id is not null").dropDuplicates(["doc_id", "text"])
    return named.unionByName(kept.where("doc_id is null"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and the digest of what they decode to."""
    coded = round_trip(_rows(docs, "text"), public_tokenizers.path("word_bpe_49k.json"))
    added = {
        "ids": F.col("ids"), "n_tokens": F.size("ids").cast("long"),
        "decoded_sha256": F.sha2(F.col("decoded").cast("binary"), 256),
    }
    own = [F.col("_row")[c].alias(c) for c in docs.columns if c not in added]
    return coded.select(*own, *[column.alias(name) for name, column in added.items()])


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("ngram_jaccard", ngram_jaccard),
    ("decontamination", decontamination),
    ("bpe", bpe),
]

ORACLE_SQL: str | None = None
"""No SQL trains a network; `run` is tested on tables of planted cases instead."""


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
