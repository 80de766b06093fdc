"""The registered queries of the operators, each over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailmill.llm import burst
from mailmill.llm.bpe import bpe_digest, round_trip
from mailmill.llm.decontaminate import find_contaminated
from mailmill.llm.fertility import judge_quality
from mailmill.llm.jaccard import near_duplicates
from mailmill.llm.lines import dedup_lines
from mailmill.llm import langcrf, licences, ngrams
from mailmill.llm.pii import find_pii, pii_digest
from mailmill.llm.repair import damage, repair, repair_digest, with_untouched
from mailmill.llm.tables import stored, table
from mailmill.llm.toxicity import held_out, score_toxicity, train_toxicity
from mailmill.llm.urls import judge_urls


WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
"""Vocabulary files lie at the same place on every worker, or are given by path."""


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of every document; texts of a class are held together by links."""
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and digest of the tokens of every document, and the digest of what they decode to."""
    return bpe_digest(round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), WORD_BPE))


def op3_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences that the sentences of every document name."""
    return licences.licence_digest(licences.scan_licences(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probability of every document under n-grams of those that are not held out."""
    return ngrams.score_texts(table(spark, sf_dir, "documents"), ngrams.trained())


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the passages that another one keeps; those that lose all words go."""
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page by rules, else by what its host is linked with."""
    return judge_urls(table(spark, sf_dir, "pages"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a document and a benchmark item that it holds, with the best measures of their passages."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_contaminated(docs, table(spark, sf_dir, "benchmark"))
    best = (F.count("*").alias("n_passages"), F.max("share").alias("share"), F.max("cosine").alias("cosine"))
    return found.groupBy("doc_id", "item_id").agg(*best)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document by a network trained on labelled ones that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train_toxicity(docs, table(spark, sf_dir, "labels"))
    return score_toxicity(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


BYTE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts of every document, whether it is kept, and the measures of its tokens."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = judge_quality(docs, BYTE_RANKS, PIECES).drop("text")
    first = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return judged.select(*first, *[c for c in judged.columns if c not in first])


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: counts of the base kinds, their digest, all spans."""
    return pii_digest(find_pii(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of every damaged conversation, the letters of its cheapest repair, the digest of the result."""
    conversations = table(spark, sf_dir, "conversations")
    return with_untouched(repair_digest(repair(damage(conversations))), conversations)


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of all rebuilt conversations."""
    whole = stored(burst.rebuilt(burst.sequences(table(spark, sf_dir, "conversations"))), "rebuilt")
    return burst.trie_digest(burst.build_trie(whole), whole)


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by a field learned from those that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = langcrf.predict_languages(docs, langcrf.train_languages(docs))
    return found.select("doc_id", langcrf.held_out().alias("held_out"), "lang_pred", "score")


QUERIES = {f.__name__: f for f in (op1_ngram_jaccard_join, op2_bpe, op3_license_scans, op4_lm_scoring, op5_line_dedup, op6_url_filters, op7_decontamination, op8_toxicity, op9_quality_rules, op10_pii, op11_conversation_repair, op12_conversation_trie, op13_language_id)}
ORACLE: dict[str, str] = {"op3_license_scans": licences.oracle()}
