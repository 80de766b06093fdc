"""Empty tables, columns of clashing names, very long texts, and the whole pipeline."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from mailmill.llm import bpe, decontaminate, fertility, jaccard, licences, lines, ngrams, pii, queries, toxicity, urls

LONG = 60_000


def words(seed, n):
    rnd = random.Random(seed)
    return " ".join(rnd.choice("stone water night over house three within winter green".split()) + str(rnd.randrange(400)) for _ in range(n))


def test_empty_tables(spark, docs_of, sf_dir):
    none = docs_of([])
    assert licences.scan_licences(none).collect() == []
    assert toxicity.score_toxicity(none, None).collect() == []
    assert fertility.judge_quality(none, queries.BYTE_RANKS, queries.PIECES).collect() == []
    assert pii.pii_digest(pii.find_pii(none)).collect() == []
    assert lines.dedup_lines(none).collect() == []
    assert jaccard.near_duplicates(none).collect() == []
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    assert toxicity.train_toxicity(none, labels) is None


@pytest.fixture(scope="module")
def clashing(spark):
    """Texts beside columns that have the names operators give to their own."""
    rows = [(i, words(i, 60) + " a.b@example.org", "x", "y", 1, 2.0, "z") for i in range(6)]
    return spark.createDataFrame(rows, "doc_id long, text string, spans string, path string, class int, score double, n_words string")


def test_clashing_columns(clashing, spark):
    ids = set(range(6))
    assert {r.doc_id for r in licences.licence_digest(licences.scan_licences(clashing)).collect()} == ids
    scored = toxicity.score_toxicity(clashing, None).collect()
    assert {r.doc_id for r in scored} == ids and {r.score for r in scored} == {0.0}
    judged = fertility.judge_quality(clashing, queries.BYTE_RANKS, queries.PIECES).collect()
    assert {r.n_words for r in judged} == {61}
    found = pii.pii_digest(pii.find_pii(clashing)).collect()
    assert {r.n_email for r in found} == {1}
    assert {r.doc_id for r in jaccard.near_duplicates(clashing).collect()} == ids
    assert {r.doc_id for r in lines.dedup_lines(clashing).collect()} == ids
    assert {r.doc_id for r in ngrams.score_texts(clashing, ngrams.trained()).collect()} == ids
    coded = bpe.bpe_digest(bpe.round_trip(clashing, queries.WORD_BPE)).collect()
    assert {r.doc_id for r in coded} == ids
    pages = spark.createDataFrame([(1, "http://a.example.org/es/x", "<p>", "r", "h")], "page_id long, url string, html string, rule string, host string")
    assert [(r.host, r.verdict) for r in urls.judge_urls(pages).collect()] == [("a.example.org", "block")]
    items = spark.createDataFrame([("i1", words(3, 60), 1)], "item_id string, text string, share int")
    kept = decontaminate.without_contaminated(clashing, items)
    assert kept.columns == clashing.columns and {r.doc_id for r in kept.collect()} == ids - {3}


def test_very_long_texts(spark, docs_of):
    long = words(1, LONG)
    docs = docs_of([(1, long), (2, long + " more"), (3, "short text of a few words only")])
    groups = {r.doc_id: r.class_id for r in jaccard.near_duplicates(docs).collect()}
    assert groups == {1: 1, 2: 1, 3: 3}
    (one,) = [r for r in licences.licence_digest(licences.scan_licences(docs)).collect() if r.doc_id == 1]
    assert one.doc_id == 1
    assert {r.doc_id for r in toxicity.score_toxicity(docs, toxicity.fresh_parameters() | {"scale": [0.0, 1.0, 0.0]}).collect()} == {1, 2, 3}


def test_pipeline_run(spark, sf_dir, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    # Too short to be cut as a passage of another text, near enough to be a copy.
    near, other = words(50, 24), words(50, 23) + " changed"
    planted = [(10_001, near), (10_002, other), (10_002, other), (10_003, words(51, 200)), (10_003, words(52, 200)),
               (10_004, words(53, 80) + " " + benchmark.orderBy("item_id").first().text + " " + words(54, 80)), (None, "no id"), (10_005, None)]
    more = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in planted], "doc_id long, text string, lang string, source string, n_chars int")
    whole = docs.select(*[F.col(c).cast(more.schema[c].dataType) for c in more.columns]).unionByName(more)
    whole = whole.withColumns({"score": F.lit("own"), "predicted": F.lit(7), "ids": F.lit("own"), "n_removed_words": F.lit("own"), "class": F.lit(1)})
    for name, df in (("documents", whole), ("labels", labels), ("benchmark", benchmark)):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    out = pipeline.run(spark, str(tmp_path))
    assert out.columns == [c for c in whole.columns if c != "ids"] + ["ids", "n_tokens", "decoded_sha256"]
    rows = out.collect()
    assert {(r.score, r.predicted, r.n_removed_words) for r in rows} == {("own", 7, "own")}
    ids = [r.doc_id for r in rows]
    assert ids.count(10_001) == 1 and 10_002 not in ids and 10_004 not in ids
    assert ids.count(None) == 1 and 10_005 in ids and 10_003 in ids
    words_of = bpe.vocabulary(queries.WORD_BPE)
    for r in rows:
        assert r.ids == words_of.encode(r.text or "") and r.n_tokens == len(r.ids)
        assert r.decoded_sha256 == hashlib.sha256(words_of.decode(r.ids).encode()).hexdigest()
    # Clean documents stay: of the tables' own, all but copies, toxic and contaminated ones.
    toxic = {r.doc_id for r in labels.where("toxic = 1").collect()}
    assert len(set(ids) & {r.doc_id for r in docs.select("doc_id").collect()}) > 0.7 * (docs.count() - len(toxic))


def test_pipeline_of_an_empty_table(spark, sf_dir, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert pipeline.run(spark, str(tmp_path)).collect() == []
