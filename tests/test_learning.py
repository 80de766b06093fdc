"""Bayes models, folds, paired comparison, registry, daily sketches, lookups of frequent keys."""

import collections
import json
import math
import random
import re
from datetime import date

import pytest
from pyspark.sql import functions as F

from mailmill.operators import bayes, evaluation, lookups, sampling, scoring, sketches, skewed
from mailmill.operators.bounded import MOST_ROWS
from mailmill.plans import jobs
from mailmill.sources.registry import Registry, instruction_with

SCHEMA = "id string, subject string, body_text string, category string"
WORDS = {"a": "alpha beta gamma the the", "b": "delta beta the epsilon", "c": "zeta the eta"}


def messages(n, seed=1):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        label = rng.choice("abc")
        words = rng.choices(WORDS[label].split() + ["noise", "Ünder", "x1"], k=rng.randint(0, 9))
        rows.append((f"m{k:03}", rng.choice(["", None, "Re: the"]), " ".join(words), rng.choice([label] * 9 + [None])))
    return rows


def plain(train, test):
    """Category of each test message, by the sums as they stand in a textbook."""
    def words(r):
        return re.findall(r"[^\W_]+", f"{r[1] or ''}\n{r[2] or ''}".lower())

    counts, docs = collections.defaultdict(collections.Counter), collections.Counter()
    for r in train:
        if r[3] is not None:
            docs[r[3]] += 1
            counts[r[3]].update(words(r))
    vocabulary = {w for c in counts.values() for w in c}
    out = {}
    for r in test:
        best = None
        for c in sorted(docs):
            score = math.log(docs[c] / sum(docs.values()))
            size = sum(counts[c].values()) + len(vocabulary)
            score += sum(math.log((counts[c][w] + 1) / size) for w in words(r) if w in vocabulary)
            if best is None or score > best[0] + 1e-6:
                best = score, c
        out[r[0]] = best and best[1]
    return out


def test_bayes_equals_the_textbook(spark):
    train, test = messages(120), messages(60, seed=2)
    model = bayes.train_bayes(spark.createDataFrame(train, SCHEMA))
    guesses = bayes.predict_bayes(spark.createDataFrame(test, SCHEMA).drop("category"), model)
    assert {r.id: r.category for r in guesses.collect()} == plain(train, test)


def test_folds_are_models_of_the_other_rows(spark):
    rows = messages(90)
    folded = sampling.fold_split(spark.createDataFrame(rows, SCHEMA), 4).select("id", "fold").collect()
    fold = {r.id: r.fold for r in folded}
    assert sorted(collections.Counter(fold.values()).values()) == [22, 22, 23, 23]
    results = evaluation.cross_validate(spark.createDataFrame(rows, SCHEMA), {"whole": bayes.message_text()}, 4).collect()
    labelled = [r for r in rows if r[3] is not None]
    fold = {r.id: r.fold for r in sampling.fold_split(spark.createDataFrame(labelled, SCHEMA), 4).collect()}
    assert {r.id: r.fold for r in results} == fold
    for f in range(4):
        want = plain([r for r in labelled if fold[r[0]] != f], [r for r in labelled if fold[r[0]] == f])
        assert {r.id: r.guess for r in results if r.fold == f} == want
    assert sampling.fold_split(spark.createDataFrame(rows, SCHEMA), 1).select("fold").distinct().collect()[0].fold == 0


def test_folds_with_few_frequent_words_and_repeated_ids(spark, monkeypatch):
    rows = messages(90) + messages(12, seed=7) + [(None, "the", "the zeta", "c"), (None, None, None, "b")]
    folds = sampling.fold_split(spark.createDataFrame([r for r in rows if r[3] is not None], SCHEMA), 4)
    model = bayes.train_folds(folds, 4)
    found = []
    for hot in (0, 3, 20_000):
        monkeypatch.setattr(bayes, "HOT", hot)
        for met in (None, model.met()):
            guesses = bayes.predict_bayes(folds.drop("category"), model, met=met)
            found.append(sorted((r.id or "", r.category) for r in guesses.collect()))
    assert all(f == found[0] for f in found) and len(found[0]) == folds.count()
    # A word of one fold alone is not known to its model, nor counted in its vocabulary.
    alone = [("1", "", "only here", "a"), ("2", "", "both", "a"), ("3", "", "both", "b")]
    own = spark.createDataFrame(alone, SCHEMA).withColumn("fold", F.when(F.col("id") == "3", 1).otherwise(0))
    model = bayes.train_folds(own, 2)
    gains = {r.word: r.gains for r in model.gains(["a", "b"]).collect()}
    assert gains["only"][0] is None and gains["only"][1] == [round(math.log(2) * 1e9), 0]
    assert [(r.fold, r.category, r.size) for r in model.class_rows()] == [
        (0, "b", round(math.log(2) * 1e9)), (1, "a", round(math.log(6) * 1e9))]


def test_words_of_examples_are_counted_once(spark, monkeypatch):
    seen = []
    plain_words = bayes.words_of
    monkeypatch.setattr(bayes, "words_of", lambda df, *keep, **more: seen.append(keep) or plain_words(df, *keep, **more))
    rows = spark.createDataFrame(messages(40), SCHEMA)
    results = evaluation.cross_validate(rows, {"whole": bayes.message_text()}, 3)
    # No shuffle of a row for each word of each message.
    assert seen == [("fold", "category")] and results.count() == rows.where("category is not null").count()


def test_bayes_without_examples_or_words(spark):
    none = bayes.train_bayes(spark.createDataFrame([], SCHEMA))
    test = spark.createDataFrame([("1", "s", "b", None), ("2", None, None, None)], SCHEMA)
    scored = scoring.score_messages(test.drop("category"), bayes.BayesScorer(none))
    assert [(r.category, r.error) for r in scored.collect()] == [(None, "nothing to learn from")] * 2
    bare = bayes.train_bayes(spark.createDataFrame([("1", None, "", "b"), ("2", "", None, "b"), ("3", "", "...", "a")], SCHEMA))
    assert {r.category for r in bayes.predict_bayes(test.drop("category"), bare).collect()} == {"b"}


def test_saved_candidates_score_like_before(spark, tmp_path):
    rows = spark.createDataFrame(messages(80), SCHEMA).where("category is not null")
    rules = scoring.RuleScorer((("a", ("alpha",)), ("b", ("delta", "epsilon"))))
    client = scoring.ResponseScorer(lambda: lambda i, p: json.dumps({"category": "a", "reason_short": i}), "Say é.", categories=("a",))
    scorers = {"rules": rules, "model": bayes.BayesScorer(bayes.train_bayes(rows)), "client": client}
    results = evaluation.evaluate_scorers(rows, scorers)
    saved = Registry(spark, str(tmp_path))
    for _ in range(2):
        saved.save("r", scorers, results)
    again = Registry(spark, str(tmp_path))
    assert again.candidates().count() == 3 and again.best().candidate_id == "model"
    for row in again.candidates().collect():
        scorer = again.scorer(row, client.connect)
        one = evaluation.evaluate_scorers(rows, {row.candidate_id: scorer}).first()
        assert (one.n, one.n_correct) == (row.n, row.n_correct)
        if row.kind == "responses":
            with pytest.raises(ValueError):
                again.scorer(row)
    assert Registry(spark, f"{tmp_path}/empty").best() is None
    with pytest.raises(TypeError):
        saved.save("r", {"odd": lambda inputs: inputs}, results)


def test_instruction_with_two_hundred_demonstrations(spark):
    rows = spark.createDataFrame([(f"{k:04}", f"s{k}", "b", "xy"[k % 2], "train") for k in range(900)], SCHEMA + ", split string")
    shown = sampling.few_shot_rows(rows, {"many": 200, "one": 1})
    assert {r.candidate_id: r["count"] for r in shown.groupBy("candidate_id").count().collect()} == {"many": 400, "one": 2}
    text = instruction_with(shown, "many", categories=("x", "y"), definitions={"x": "even ones"})
    assert text.count("\nCategory: ") == 400 and "1. x: even ones" in text and text.startswith("Put the message")
    assert instruction_with(shown, "one", categories=("x", "y")).count("Subject: ") == 2


def test_paired_comparison(spark):
    right = {"base": "1100", "better": "1110", "other": "0011"}
    data = [(c, str(i), "t", "t" if x == "1" else "f", x == "1") for c, xs in right.items() for i, x in enumerate(xs)]
    results = spark.createDataFrame(data, "candidate_id string, id string, truth string, guess string, is_right boolean")
    got = {r.candidate_id: r for r in evaluation.compare_paired(results, "base").collect()}
    assert tuple(got["better"])[1:] == (4, 2, 1, 0, 1, 25.0, 1.0)
    assert tuple(got["other"])[1:] == (4, 0, 2, 2, 0, 0.0, 0.0)
    counted = {r.candidate_id: r.accuracy_pct for r in evaluation.accuracy_of(results).collect()}
    assert counted == {"base": 50.0, "better": 75.0, "other": 50.0}


def test_evaluation_from_sample_to_comparison(spark, tmp_path):
    sample = spark.createDataFrame(messages(100), SCHEMA).where("category is not null")
    truth = sample.select("id", F.col("category").alias("main_label"), F.lit("r").alias("reason"))
    rules = scoring.RuleScorer((("a", ("alpha",)),))
    for _ in range(2):
        told = jobs.evaluate_run(sample, truth, {"rules": rules}, str(tmp_path), "r", baseline="rules", learn="bayes").collect()
        assert [r.candidate_id for r in told] == ["bayes"] and told[0].only_candidate > told[0].only_baseline


def test_states_of_days_merge(spark, tmp_path):
    rows = spark.range(6000).select((F.col("id") % 2500).cast("string").alias("who"), (F.col("id") % 3).alias("d"), F.when(F.col("id") % 2 == 0, "x").alias("odd"))
    rows = rows.withColumn("day", F.date_add(F.lit(date(2026, 3, 1)), F.col("d").cast("int")))
    states = sketches.day_states(rows, F.col("day"), "who", "odd")
    kept = sketches.DailyStates(f"{tmp_path}/states")
    days = [date(2026, 3, d) for d in (1, 2, 3)]
    for _ in range(2):
        for day in days:
            kept.put(states, day)
    got = {r.column: r for r in kept.distinct(spark, days[0], days[2]).collect()}
    assert abs(got["who"].estimate - 2500) < 2500 * 4 * sketches.relative_error() and got["who"].row_count == 6000
    assert got["odd"].estimate == 1
    one = {r.column: r.row_count for r in kept.distinct(spark, days[1], days[1]).collect()}
    assert one == {"who": 2000, "odd": 2000}
    # Late messages of a day.
    late = spark.createDataFrame([("new", "x", days[1])], "who string, odd string, day date")
    kept.add(sketches.day_states(late, F.col("day"), "who", "odd"), days[1])
    assert {r.column: r.row_count for r in kept.distinct(spark, days[1], days[1]).collect()} == {"who": 2001, "odd": 2001}
    assert kept.distinct(spark, date(2020, 1, 1), date(2020, 1, 2)).collect() == []


def test_frequent_keys_are_not_dealt_to_one_task(spark):
    rows = spark.range(4000).select("id", F.when(F.col("id") % 10 < 9, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    table = rows.select("k").distinct().where("k != '9'").withColumn("v", F.concat(F.lit("v"), "k"))
    counts = rows.groupBy("k").agg(F.count("*").alias("n"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = skewed.lookup(rows, table, ["k"], counts, spread="id", hot=20)
        got = {r.id: r.v for r in found.collect()}
        assert got == {i: "vhot" if i % 10 < 9 else None if i == 9 else f"v{i}" for i in range(4000)}
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" in plan and "Generate" not in plan
        sizes = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
        assert max(sizes) < 0.5 * 4000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_names_of_skewed_label_lists(spark):
    dim = spark.createDataFrame([(f"L{k}", f"n{k}", k) for k in range(30)], "label_id string, label_name string, scan_order long")
    lists = [["L1", "L2"]] * 300 + [["L1", f"L{k}", "none"] for k in range(30)] + [[], None, ["L3", "L3"]]
    df = spark.createDataFrame([(str(k), x) for k, x in enumerate(lists)], "id string, label_ids array<string>")
    by_map, by_join = (lookups.name_labels(df, dim, most=m).select("id", "labels").collect() for m in (MOST_ROWS, 0))
    assert sorted(map(tuple, by_map)) == sorted(map(tuple, by_join))
    plan = lookups.name_labels(df, dim, most=0)._jdf.queryExecution().executedPlan().toString()
    assert "sequence(" not in plan
