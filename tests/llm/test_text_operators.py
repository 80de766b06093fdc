"""Operators that look at one text at a time, against plain versions."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import oracle_check
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from mailmill.llm import bpe, fertility, licences, pii, queries, toxicity
from mailmill.llm.tables import table

ODD = [(1, None), (2, ""), (3, " \n\t "), (None, "no id here"), (4, "é　日本 🎉 <|endoftext|> x"), (4, "é　日本 🎉 <|endoftext|> x")]
SMALL = "/root/testdata/sf0.001"
LIBRARY = Tokenizer.from_file(queries.WORD_BPE)
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# Encoding


def test_encoding_equals_the_library_on_random_text():
    rnd, vocabulary = random.Random(5), bpe.vocabulary(queries.WORD_BPE)
    letters = "abcdeéßΣσςİıﬁ²½٣१'’ \t\n\r\x85\xa0​　日本語ไทยकि한🎉A123'S'LL're_--<|>%"
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 60))) for _ in range(3000)]
    texts += ["<|endoftext|> a <|startoftext|>b", "a" * 3000, "é" * 500, "", "'s", "<|ENDOFTEXT|>"]
    for text in texts:
        ids = LIBRARY.encode(text, add_special_tokens=False).ids
        assert vocabulary.encode(text) == ids, text
        assert vocabulary.decode(ids) == LIBRARY.decode(ids, skip_special_tokens=False)


def test_no_token_spans_a_forced_boundary():
    vocabulary = bpe.vocabulary(queries.WORD_BPE)
    for token in list(vocabulary.ids)[:5000]:
        plain = token.removesuffix(vocabulary.end) or token
        symbols = vocabulary.symbols(token)
        assert all(p in vocabulary.joined for p in zip(symbols, symbols[1:])), plain


def test_bpe_query(spark, docs_of):
    docs = docs_of([*ODD, (9, "word " * 50_000)]).withColumnRenamed("lang", "ids")
    rows = bpe.bpe_digest(bpe.round_trip(docs, queries.WORD_BPE)).collect()
    want = [(i, LIBRARY.encode(t or "", add_special_tokens=False).ids) for i, t in [*ODD, (9, "word " * 50_000)]]
    want = [(i, len(x), sha(" ".join(map(str, x))), sha(LIBRARY.decode(x, skip_special_tokens=False))) for i, x in want]
    assert collections.Counter(map(tuple, rows)) == collections.Counter(want)
    assert bpe.bpe_digest(bpe.round_trip(docs.limit(0), queries.WORD_BPE)).collect() == []


# Personal data


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def plain_spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(pii.PLAIN.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": lambda: True,
                "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")),
                "card": lambda: 12 <= len(digits) <= 19 and luhn(digits),
                "phone": lambda: 9 <= len(digits) <= 15,
            }[kind]()
            if ok:
                out.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(s for _, _, s in sorted(out))


def test_pii_against_plain_patterns(spark, docs_of):
    rnd = random.Random(3)
    parts = ["a@b.c", "x_d@e-f.g.h", "@", ".", "1.2.3.4.5.6.7.8", "256.1.1.1", "0001.2.3.4", "4111 1111 1111 1111", "4111-1111-1111-1111", "5500000000000004", "+1 (017) 555-7713", "+49.30.1234567", "é🎉", " ", "-", "12", "+", "\n"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12))) for _ in range(400)]
    texts += ["1" * 30_000, "a" * 30_000 + "@", "a@b.c " * 300, "1 " * 20_000]
    found = pii.find_pii(docs_of(list(enumerate(texts)))).collect()
    for row in found:
        base = [s for s in row.pii if s.kind in pii.PLAIN]
        order = {k: i for i, k in enumerate(pii.PLAIN)}
        got = ",".join(f"{s.kind}:{s.start}:{s.end}" for s in sorted(base, key=lambda s: (s.start, order[s.kind])))
        assert got == plain_spans(row.text), row.text[:200]
        assert all(row.text[s.start : s.end] == s.text for s in row.pii)


def test_pii_methods_spans_and_odd_rows(spark, docs_of):
    texts = [
        "pay to DE89 3704 0044 0532 0130 00 today", "DE88370400440532013000", "token = \"" + "a1" * 20 + "\"", "hash " + "a1" * 20,
        "ssn 123-45-6789", "number 123-45-6789",
    ]
    rows = {r.doc_id: r for r in pii.pii_digest(pii.find_pii(docs_of(list(enumerate(texts))))).collect()}
    kinds = [[s.split(":")[0] for s in rows[i].spans.split(",") if s] for i in range(len(texts))]
    assert "iban" in kinds[0] and "iban" not in kinds[1]
    assert kinds[2] == ["secret"] and kinds[3] == [] and kinds[4] == ["ssn"] and kinds[5] == []
    odd = pii.pii_digest(pii.find_pii(docs_of(ODD).withColumnRenamed("lang", "pii"))).collect()
    assert len(odd) == len(ODD) and all(r.base_sha256 == sha("") for r in odd)
    plan = pii.find_pii(docs_of(ODD))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


# Licences


def test_every_known_sentence_has_a_trigger():
    assert all(re.search(licences.TRIGGER, s) for s in licences.SENTENCES.values())
    assert len(set(licences.KNOWN)) == len(licences.SENTENCES)


def test_licences_in_order(spark, docs_of):
    s = licences.SENTENCES
    mit = " ".join([s["mit-grant"], "Some words.", s["mit-notice"], "More. And more.", s["mit-as-is"]])
    texts = [mit, "\n".join([s["mit-as-is"], s["mit-notice"], s["mit-grant"]]), "x. Released under the  MIT license!\n\nAll rights reserved.", None, "", "license"]
    rows = {r.doc_id: r for r in licences.licence_digest(licences.scan_licences(docs_of(list(enumerate(texts))))).collect()}
    assert rows[0].places == "mit:0:6" and rows[1].n_matches == 0
    assert rows[2].licences == "mit,proprietary"
    assert all(rows[i].n_matches == 0 for i in (3, 4, 5))


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_same_rows_as_sql(spark, sf_dir, name):
    rows, faults = oracle_check.compare(queries.QUERIES[name](spark, sf_dir), oracle_check.connect(sf_dir), queries.ORACLE[name])
    assert rows and not faults, "\n".join(faults)


# Quality


def plain_quality(text):
    words = WORD.findall(text)
    windows = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def test_quality_base_and_measures(spark, docs_of):
    rnd = random.Random(2)
    own = [" ".join(rnd.choice("ab cd\n é\xa0x # | \x0b".split(" ")) for _ in range(rnd.randint(0, 80))) for _ in range(200)]
    texts = own + ["same words again and again " * 2000, None, "", "привет как дела " * 3]
    docs = docs_of(list(enumerate(texts))).withColumnRenamed("lang", "kept")
    rows = fertility.judge_quality(docs, queries.BYTE_RANKS, queries.PIECES).collect()
    for r in rows:
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
        assert got == plain_quality(texts[r.doc_id] or ""), texts[r.doc_id]
        assert not (r.base_failed and r.kept)
    assert rows[-1].script == "cyrillic"
    prose = table(spark, SMALL, "documents").join(table(spark, SMALL, "labels").where("quality = 1"), "doc_id").select("doc_id", "text")
    judged = fertility.judge_quality(prose, queries.BYTE_RANKS, queries.PIECES).where("not base_failed").collect()
    assert sum(r.kept for r in judged) >= 0.98 * len(judged)
    junk = docs_of([(1, "Ered*** reed*** ndsh*** ing&&& erhe*** of%%% to%%% inrent$$$ " * 3 + " ".join(f"w{i}***" for i in range(99)))])
    assert not fertility.judge_quality(junk, queries.BYTE_RANKS, queries.PIECES).first().kept


# Toxicity


def test_gradients():
    words = toxicity.Words()
    windows = np.concatenate([toxicity.windows_of(words.of(t)) for t in ("a b c d e " * 9, "x y", "")])
    features, labels = words.features(), np.array([1.0, 0, 1, 0, 1, 1, 0])[: len(windows)]
    p = {k: v.astype(np.float64) for k, v in toxicity.fresh_parameters().items()}

    def loss(q):
        logits = toxicity._forward(q, toxicity.embed(q, features), windows).astype(float)
        return np.mean(np.log1p(np.exp(logits)) - labels * logits)

    g = toxicity._gradients(p, features, windows, labels)
    for name in ("in_f", "in_b", "state_f", "state_b", "bias_b", "attend", "query", "out"):
        at = tuple(0 for _ in p[name].shape)
        ends = []
        for step in (1e-3, -1e-3):
            q = dict(p, **{name: p[name].copy()})
            q[name][at] += step
            ends.append(loss(q))
        assert abs((ends[0] - ends[1]) / 2e-3 - g[name][at]) < 1e-4, name


def test_windows_cover_every_word():
    for n in (0, 1, 23, 24, 25, 100):
        rows = toxicity.windows_of(np.arange(n, dtype=np.int32))
        assert set(range(n)) <= set(rows.ravel().tolist()) and rows.shape[1] == toxicity.WINDOW


def test_toxicity_learns_and_takes_odd_rows(spark, docs_of):
    rnd = random.Random(1)
    rows, labels = [], []
    for i in range(300):
        words = ["".join(rnd.choice("abcdefgh") for _ in range(4)) for _ in range(40)]
        if i % 3 == 0:
            words[3::9] = ["vile"] * len(words[3::9])
            words[3::9] = ["vile"] * len(words[3::9])
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(i % 3 == 0)))
    docs = docs_of(rows)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.train_toxicity(docs, marks)
    scored = toxicity.score_toxicity(docs.unionByName(docs_of([(1000, None), (1001, ""), (None, "a")])), model).collect()
    held = [r for r in scored if r.doc_id is not None and r.doc_id < 300 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum(r.predicted == (r.doc_id % 3 == 0) for r in held) >= 0.8 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in scored)
    none = toxicity.score_toxicity(docs, toxicity.train_toxicity(docs, marks.limit(0)))
    assert none.where("score != 0").count() == 0
