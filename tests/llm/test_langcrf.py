"""The field against sums over all labelings, and its accuracy on texts it did not see."""

import itertools

import numpy as np
import pytest

from mailmill.llm import langcrf
from mailmill.llm.langcrf import Field, label_shares
from mailmill.llm.tables import ship

SCHEMA = "doc_id long, text string, lang string"
WORDS = {
    "en": "the water house green which thing over night winter stone three brother window shall within".split(),
    "de": "der wasser haus grün welche ding über nacht winterlich steinig drei bruder fenster sollen zwischen".split(),
    "fr": "le eau maison vert laquelle chose pendant nuit hivernal pierre trois frère fenêtre devoir entre".split(),
}


def text_of(lang, seed, n=40):
    rng = np.random.default_rng(seed)
    return " ".join(rng.choice(WORDS[lang], n)) + "."


@pytest.fixture(scope="module")
def rows():
    return [(k, text_of(lang, k), lang) for k, lang in zip(range(240), itertools.cycle(WORDS))]


@pytest.fixture(scope="module")
def field(spark, rows):
    ship(spark)
    return langcrf.train_languages(spark.createDataFrame(rows, SCHEMA))


@pytest.mark.parametrize("lengths", [[1], [2, 5], [6, 0, 1, 3]])
def test_shares_are_sums_over_all_labelings(lengths, monkeypatch):
    monkeypatch.setattr(langcrf, "BLOCK", 2)
    monkeypatch.setattr(langcrf, "_BLOCKS_AT_ONCE", 2)
    rng = np.random.default_rng(1)
    field = Field(["a", "b", "c"], {})
    field.passing, field.start = rng.normal(size=(3, 3)), rng.normal(size=3)
    scores, ids = rng.normal(size=(5, 3)), rng.integers(0, 5, sum(lengths))
    got = np.concatenate([s[inside] for _, inside, s in label_shares(field, scores, ids, np.array(lengths))])
    want, at = [], 0
    for n in lengths:
        own, sums = ids[at: at + n], np.zeros((n, 3))
        for ways in itertools.product(range(3), repeat=n):
            weight = np.exp(sum(scores[i, c] for i, c in zip(own, ways)) + (field.start[ways[0]] if n else 0)
                            + sum(field.passing[a, b] for a, b in itertools.pairwise(ways)))
            for k, c in enumerate(ways):
                sums[k, c] += weight
        if n:
            want.append(sums / sums.sum(axis=1, keepdims=True))
        at += n
    assert np.allclose(got, np.concatenate(want))


def test_features_of_a_word_do_not_depend_on_its_neighbours():
    words = ["ab", "a", "Über", "langeswort", "ab"]
    features, counts = langcrf._features(words)
    at = 0
    for word, n in zip(words, counts):
        alone, one = langcrf._features([word])
        assert n == one[0] and sorted(features[at: at + n]) == sorted(alone)
        at += n


def test_held_out_texts(spark, rows, field):
    docs = spark.createDataFrame(rows, SCHEMA)
    got = langcrf.predict_languages(docs, field).join(docs, "doc_id").where(langcrf.held_out()).collect()
    assert len(got) > 50
    assert all(r.lang_pred == r.lang and 0 <= r.score <= 1 for r in got)


def test_held_out_texts_of_the_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    found = langcrf.predict_languages(docs, langcrf.train_languages(docs)).join(docs, "doc_id")
    tested = found.where(langcrf.held_out()).collect()
    assert sum(r.lang == r.lang_pred for r in tested) >= 0.97 * len(tested)


def test_words_of_a_mixed_text(spark, field):
    parts = [(lang, text_of(lang, 900 + k, 15)) for k, lang in enumerate(["en", "fr", "de", "en"])]
    text = " ".join(t for _, t in parts)
    runs = langcrf.label_runs(spark.createDataFrame([(1, text)], "doc_id long, text string"), field).collect()
    runs.sort(key=lambda r: r.start)
    assert [r.lang for r in runs] == [lang for lang, _ in parts]
    assert [text[r.start:r.end] for r in runs] == [t.rstrip(".") for _, t in parts]


def test_texts_without_letters(spark, field):
    odd = [(1, None), (2, ""), (3, "12 ½ _ -- 7"), (None, text_of("de", 1)), (5, "winter"), (5, "winter")]
    got = langcrf.predict_languages(spark.createDataFrame(odd, "doc_id long, text string"), field).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 6 and by[None].lang_pred == "de" and by[5].lang_pred in WORDS
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (1, 2, 3))


def test_very_long_texts_in_pieces(spark, field, monkeypatch):
    long = text_of("fr", 5, 60_000)
    whole = langcrf.text_languages(field, [long, "der bruder"])
    monkeypatch.setattr(langcrf, "_PIECE_CHARS", 1000)
    assert langcrf.text_languages(field, [long, "der bruder"]) == whole
    assert whole[0][0] == "fr" and whole[1][0] == "de"


def test_nothing_to_learn_from(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert langcrf.train_languages(none) is None
    assert langcrf.predict_languages(none, None).collect() == []
    unlabelled = spark.createDataFrame([(1, "a word", None)], SCHEMA)
    assert langcrf.train_languages(unlabelled) is None
    assert [tuple(r) for r in langcrf.predict_languages(unlabelled, None).collect()] == [(1, "und", 0.0)]


def test_one_language_only_and_clashing_columns(spark):
    rows = [(k, text_of("de", k), "de", "x", 1.0) for k in range(12)]
    docs = spark.createDataFrame(rows, SCHEMA + ", word string, n double")
    got = langcrf.predict_languages(docs, langcrf.train_languages(docs)).collect()
    assert {(r.lang_pred, round(r.score, 6)) for r in got} == {("de", 1.0)}


def test_lexicon_is_bounded(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    chosen = langcrf.lexicon_of(docs, share=10).collect()
    assert len({r.word for r in chosen}) <= 10 * len(WORDS)
    assert all(any(r.n * 10 >= r.total for r in chosen if r.word == w) for w in {r.word for r in chosen})
