"""Operators on small tables made by hand, against brute force in Python."""

import hashlib
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from mailmill.operators import actions as act
from mailmill.operators import aggregates as agg
from mailmill.operators import bounded, evaluation, label_sets, lookups, ordering, sampling, scoring
from mailmill.operators import predicates as pred
from mailmill.schemas import ACTION, LABEL_DIM, SAMPLE_COLUMNS

DIM = [("INBOX", "INBOX", 0), ("Label_1", "ADS", 1), ("Label_2", "ADS", 2), ("Label_3", "OTHERS", 3),
       ("Label_4", "Mine", 4)]
SCOPE_ROWS = [
    ("1", ["INBOX", "UNREAD"]),
    ("2", ["INBOX"]),
    ("3", ["INBOX", "UNREAD", "CATEGORY_PROMOTIONS"]),
    ("4", ["INBOX", "UNREAD", "CATEGORY_PROMOTIONS", "CATEGORY_PERSONAL"]),
    ("5", ["UNREAD"]),
    ("6", []),
    ("7", None),
]


@pytest.fixture(scope="module")
def dim(spark):
    return spark.createDataFrame(DIM, LABEL_DIM)


def ids(df):
    return sorted(r.id for r in df.select("id").collect())


def md5(key, seed=42):
    return hashlib.md5(f"{key}-{seed}".encode()).hexdigest()


def in_seeded_order(keys, seed=42):
    return sorted(keys, key=lambda k: (md5(k, seed), k))


# Filters


@pytest.mark.parametrize("stored", [False, True])
@pytest.mark.parametrize("scope, want", [
    (pred.ANYWHERE, "1234567"), (pred.INBOX, "1234"), (pred.UNREAD, "134"), (pred.UNREAD_PRIMARY, "14"),
])
def test_scopes(spark, scope, want, stored):
    df = spark.createDataFrame(SCOPE_ROWS, "id string, label_ids array<string>")
    if stored:
        df = pred.with_scope_flags(df)
    assert "".join(ids(pred.in_scope(df, scope))) == want


def test_unknown_scope(spark):
    with pytest.raises(ValueError, match="unknown scope"):
        pred.in_scope(spark.range(1), "outbox")


def test_stored_flags_reach_the_scan(spark, tmp_path):
    df = spark.createDataFrame(SCOPE_ROWS, "id string, label_ids array<string>")
    pred.with_scope_flags(df).write.parquet(f"{tmp_path}/t")
    plan = pred.in_scope(spark.read.parquet(f"{tmp_path}/t"), pred.UNREAD).select("id")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(is_inbox,true)" in text and "EqualTo(is_unread,true)" in text
    assert "label_ids" not in text.split("ReadSchema")[1]


@pytest.mark.parametrize("most", [10_000, 0])
def test_custom_labels_both_ways(spark, dim, monkeypatch, most):
    monkeypatch.setattr(pred, "MOST_ROWS", most)
    rows = [("a", ["INBOX"]), ("b", ["INBOX", "Label_4", "Label_1"]), ("c", None), ("d", ["Label_9"])]
    df = spark.createDataFrame(rows, "id string, label_ids array<string>")
    assert ids(pred.with_custom_label(df, dim)) == ["b"]


def test_missing_text_matches_nothing(spark):
    df = spark.createDataFrame([("1", "a lic b"), ("2", None), ("3", "LIC")], "id string, `from` string")
    assert ids(pred.matching(df, "from", "lic")) == ["1"]


def test_columns(spark):
    df = spark.createDataFrame([(1, 2, 3)], "` a` int, b int, c int")
    tidy = pred.tidy_columns(df, rename={"a": "x", "zz": "y"}, drop=("c", "none"))
    assert tidy.columns == ["x", "b"]
    assert pred.existing_columns(df, ("c", "q", "b")).columns == ["c", "b"]
    with pytest.raises(ValueError, match=r"no columns \['q'\] among"):
        pred.require_columns(df, ("b", "q"))


def test_mismatch(spark):
    rows = [("1", "a", "a"), ("2", "a", "b"), ("3", None, "a"), ("4", None, None)]
    df = spark.createDataFrame(rows, "id string, old_label string, new_label string")
    assert ids(evaluation.label_mismatches(df)) == ["2", "3", "4"]


# Sorts


@pytest.mark.parametrize("n", [0, 1, 7, 40, 95, 100, 1000, None])
def test_most_recent(spark, n):
    start = datetime(2026, 1, 1)
    # A third of all rows share one moment, some have none.
    rows = [(f"{i:03}", start + timedelta(hours=i)) for i in range(50)]
    rows += [(f"h{i:03}", start + timedelta(days=1)) for i in range(45)]
    rows += [(f"z{i}", None) for i in range(5)]
    df = spark.createDataFrame(rows, "id string, internal_ts timestamp")
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or start).timestamp(), r[0]))
    got = [r.id for r in ordering.most_recent(df, n).collect()]
    assert got == [r[0] for r in want[:n]]


def test_first_rows(spark):
    df = spark.range(10)
    assert [r.id for r in ordering.first_rows(df, 3, F.desc("id")).collect()] == [9, 8, 7]


# Lookups


@pytest.mark.parametrize("most", [500, 0])
def test_label_names_both_ways(spark, dim, most):
    rows = [("a", ["Label_3", "INBOX", "what", "Label_3"]), ("b", []), ("c", None)]
    rows += [(f"h{i}", ["INBOX", "Label_4"]) for i in range(60)]
    df = spark.createDataFrame(rows, "id string, label_ids array<string>")
    named = {r.id: r.labels for r in lookups.name_labels(df, dim, most=most).collect()}
    assert named.pop("a") == ["OTHERS", "INBOX", "what", "OTHERS"]
    assert named.pop("b") == [] and named.pop("c") == []
    assert len(named) == 60 and set(map(tuple, named.values())) == {("INBOX", "Mine")}


def test_no_labels_at_all(spark):
    df = spark.createDataFrame([("a", ["x"])], "id string, label_ids array<string>")
    empty = spark.createDataFrame([], LABEL_DIM)
    assert lookups.name_labels(df, empty).first().labels == ["x"]


def test_last_label_of_a_name_wins(dim):
    got = {r.category: r.label_id for r in lookups.label_id_of_category(dim).collect()}
    assert got == {"ADS": "Label_2", "OTHERS": "Label_3"}


def test_coverage(dim):
    rows = lookups.label_coverage(dim).collect()
    assert len(rows) == 16 and {r.covered for r in rows} == {"2/16"}
    assert {r.category for r in rows if r.present} == {"ADS", "OTHERS"}


def test_small_rows(spark):
    assert len(bounded.small_rows(spark.range(5), 5)) == 5
    assert bounded.small_rows(spark.range(6), 5) is None
    assert bounded.broadcast_if_small(spark.range(6), 5).count() == 6


# Counts


def test_label_counts(spark):
    df = spark.createDataFrame([(["A", "A", "INBOX"],), (["A", "B"],), ([],), (None,)], "labels array<string>")
    assert [tuple(r) for r in agg.tag_label_counts(df).collect()] == [("A", 2), ("B", 1)]
    listed = agg.listed_label_counts(df, listed=("INBOX", "SENT", "B")).collect()
    assert [tuple(r) for r in listed] == [("B", 1), ("INBOX", 1), ("SENT", 0)]
    assert [tuple(r) for r in agg.tags_per_message(df).collect()] == [(0, 2), (2, 2)]
    assert [r.label for r in label_sets.tag_label_set(df).orderBy("label").collect()] == ["A", "B"]


def test_report_bars(spark):
    df = spark.createDataFrame([("A",)] * 5 + [("B",)] * 2 + [(None,)], "category string")
    got = [tuple(r) for r in agg.category_report(df).select("category", "n", "bar").collect()]
    assert got == [("A", 5, "█" * 60), ("B", 2, "█" * 24)]
    short = [r.bar for r in agg.category_report(df, width=4).collect()]
    assert short == ["█" * 4, "█" * 2]
    counts = [tuple(r) for r in agg.category_counts(df, keep_null=True).collect()]
    assert counts == [("A", 5), ("B", 2), (None, 1)]


def test_distinct(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,)], "category string")
    assert agg.distinct_values(df, "category").first().category == 1
    assert agg.distinct_values(df, "category", approximate=True).first().category == 1


# Samples


@pytest.fixture(scope="module")
def skewed(spark):
    """One group holds most rows, one few, one a single row, some rows have none."""
    rows = [(f"a{i}", "hot") for i in range(20000)] + [(f"b{i}", "cold") for i in range(30)]
    rows += [("c", "one")] + [(f"n{i}", None) for i in range(9)]
    return rows, spark.createDataFrame(rows, "id string, category string").repartition(5).cache()


@pytest.mark.parametrize("n", [0, 1, 3, 20, 30, 4097, 19999, 20000, 30000])
def test_stratified_sample(skewed, n):
    rows, df = skewed
    groups = defaultdict(list)
    for key, group in rows:
        if group:
            groups[group].append(key)
    want = {(k, g) for g, keys in groups.items() for k in in_seeded_order(keys)[:n]}
    got = [tuple(r) for r in sampling.stratified_sample(df, n).collect()]
    assert len(got) == len(want) and set(got) == want


def test_sample_depends_on_seed(skewed):
    _, df = skewed
    one, two = (set(ids(sampling.stratified_sample(df, 20, seed))) for seed in (1, 2))
    assert len(one) == len(two) == 41 and one != two


@pytest.mark.parametrize("ratio", [0.0, 0.0001, 0.25, 0.75, 1.0])
def test_split(skewed, ratio):
    rows, df = skewed
    keys = in_seeded_order([k for k, _ in rows])
    want = set(keys[: int(len(keys) * ratio)])
    got = sampling.train_val_split(df, ratio).collect()
    assert len(got) == len(rows)
    assert {r.id for r in got if r.split == "train"} == want


def test_split_of_few_and_none(spark):
    ten = spark.range(10).select(F.col("id").cast("string"))
    counts = dict(sampling.train_val_split(ten).groupBy("split").count().collect())
    assert counts == {"train": 7, "val": 3}
    assert sampling.train_val_split(ten.limit(0)).count() == 0
    assert sampling.stratified_sample(ten.limit(0).withColumn("category", F.lit("x"))).count() == 0


def test_copies_of_an_id_stay_together(spark):
    rows = [("hot",)] * 3000 + [(f"x{i}",) for i in range(6000)]
    df = spark.createDataFrame(rows, "id string").repartition(4)
    order = in_seeded_order({r[0] for r in rows})
    for ratio in (0.1, 0.5, 0.75):
        wanted, want = int(len(rows) * ratio), set()
        taken = 0
        for key in order:
            if taken >= wanted:
                break
            want.add(key)
            taken += 3000 if key == "hot" else 1
        got = sampling.train_val_split(df, ratio).where("split = 'train'")
        assert {r.id for r in got.collect()} == want and got.count() == taken


def test_split_does_not_shuffle_the_rows(skewed):
    plan = sampling.train_val_split(skewed[1])._jdf.queryExecution().executedPlan().toString()
    main = plan.split("Subquery")[0]
    assert "Exchange" not in main and "Window" not in main


def test_latest_copy_of_a_hot_id(spark):
    rows = [("hot", i) for i in range(9000)] + [(f"x{i}", 1) for i in range(100)]
    df = spark.createDataFrame(rows, "id string, came int").repartition(6)
    latest = sampling.latest_per_id(df, "came")
    plan = latest._jdf.queryExecution().sparkPlan().toString()
    assert "Partial" in plan.split("WindowGroupLimit")[-1]
    got = {r.id: r.came for r in latest.collect()}
    assert len(got) == 101 and got["hot"] == 8999


def test_few_shot(spark):
    rows = [(f"{c}{i}", "s", "b", c, "train" if i % 5 else "val") for c in "xy" for i in range(40)]
    df = spark.createDataFrame(rows, "id string, subject string, body_text string, category string, split string")
    sets = {r.candidate_id: r.demonstrations for r in sampling.few_shot_sets(df, {"p": 2, "q": 3}).collect()}
    for name, n in (("p", 2), ("q", 3)):
        want = []
        for c in "xy":
            want += in_seeded_order([r[0] for r in rows if r[3] == c and r[4] == "train"])[:n]
        assert [d.id for d in sets[name]] == want
    with pytest.raises(ValueError):
        sampling.few_shot_sets(df, {"p": 51})


# Scorers


def messages(spark, rows):
    return spark.createDataFrame(rows, "id string, `from` string, subject string, body_text string")


def test_rules(spark):
    cases = {
        "Your OTP is 1": "OTP_AND_VERIFICATION",
        "New login to your account": "SECURITY_ALERTS",
        "INR 5 was credited": "TRANSACTION_ALERT",
        "paid with Amazon Pay, cashback": "AMAZON_PAY",
        "a refund is on its way": "REFUNDS_REWARDS",
        "wholesaler": "OTHERS",
        "Sale": "ADS",
        "": "OTHERS",
    }
    df = messages(spark, [(str(i), "f", s, None) for i, s in enumerate(cases)])
    got = scoring.score_messages(df, scoring.RuleScorer()).orderBy(F.col("id").cast("int")).collect()
    assert [r.category for r in got] == list(cases.values())
    assert all(len(r.reason) <= 80 and r.error is None for r in got)


def test_rules_see_only_the_given_length(spark):
    df = messages(spark, [("1", "f", "", "x" * 2000 + " refund")])
    whole = scoring.score_messages(df, scoring.RuleScorer()).first()
    cut = scoring.score_messages(df, scoring.RuleScorer(), max_body_chars=1500).first()
    assert (whole.category, cut.category) == ("REFUNDS_REWARDS", "OTHERS")
    assert len(cut.body_text) == 2007


def test_client_faults_stay_in_their_row(spark):
    def connect():
        def respond(instruction, prompt):
            assert instruction == "sort"
            if "boom" in prompt:
                raise OSError("gone")
            if "odd" in prompt:
                return "no json"
            sender = prompt.split("\n")[0]
            return '{"category": "ADS", "reason_short": "%s"}' % sender
        return respond

    df = messages(spark, [("1", "me", "a", "b"), ("2", "me", "boom", ""), ("3", None, "odd", None)])
    scorer = scoring.ResponseScorer(connect, "sort", send_sender=True)
    got = [tuple(r) for r in scoring.score_messages(df, scorer).orderBy("id")
           .select("category", "reason", "error").collect()]
    assert got == [("ADS", "From: me", None), (None, None, "OSError: gone"), (None, None, "invalid answer")]
    empty = scoring.score_messages(df.limit(0), scorer)
    assert empty.count() == 0 and empty.columns[-3:] == ["category", "reason", "error"]


def test_model(spark):
    rows = [(str(i), "f", w, f"{w} {w}") for i, w in enumerate(["red", "blue"] * 10)]
    df = messages(spark, rows).withColumn("category", F.upper("subject"))
    model = scoring.train_model(df.unionByName(df.withColumn("category", F.lit(None).cast("string"))))
    got = scoring.score_messages(df.drop("category"), scoring.ModelScorer(model)).collect()
    assert all(r.category == r.subject.upper() for r in got)


# Actions


SCORED_ROWS = [("1", None), ("2", ""), ("3", "AMAZON_PAY"), ("4", "ADS"), ("5", "OTHERS")]


def test_planned_actions(spark, dim):
    scored = spark.createDataFrame(SCORED_ROWS, "id string, category string")
    got = {r.id: (r.label_id, r.outcome, r.skip_reason) for r in act.plan_actions(scored, dim).collect()}
    assert got == {
        "1": (None, "skipped", "no category"), "2": (None, "skipped", "no category"),
        "3": (None, "skipped", "no label"), "4": ("Label_2", "pending", None),
        "5": ("Label_3", "pending", None),
    }
    assert sum(r.n for r in act.action_summary(act.plan_actions(scored, dim)).collect()) == 5


def test_actions_once(spark, dim):
    scored = spark.createDataFrame(SCORED_ROWS, "id string, category string")
    earlier = spark.createDataFrame(
        [("4", "ADS", "applied"), ("4", "ADS", "applied"), ("5", "OTHERS", "error"), ("3", "ADS", "applied")],
        "id string, category string, outcome string")
    assert ids(act.new_actions(act.plan_actions(scored, dim), earlier)) == ["5"]


def test_applied_actions(spark, dim):
    def connect():
        def add(message_id, label_id):
            if message_id == "5":
                raise RuntimeError("busy")
        return add

    scored = spark.createDataFrame(SCORED_ROWS, "id string, category string")
    done = act.apply_actions(act.plan_actions(scored, dim), connect)
    assert done.schema == ACTION
    got = {r.id: (r.outcome, r.error) for r in done.collect()}
    assert got["4"] == ("applied", None) and got["5"] == ("error", "RuntimeError: busy")
    assert got["1"] == ("skipped", None)


# Evaluation


def test_accuracy(spark):
    df = spark.createDataFrame([(" ads ", "ADS"), (None, "ADS")], "guess string, truth string")
    row = evaluation.accuracy(df, "truth", "guess").first()
    assert (row.n, row.n_correct, row.accuracy_pct) == (2, 1, 50.0)


def test_examples(spark):
    sample = spark.createDataFrame(
        [(str(i), None, "b", "OLD") for i in range(8)], "id string, subject string, body_text string, category string")
    truth = spark.createDataFrame(
        [("0", " A ", "r"), ("1", None, "r"), ("2", "B", None), ("x", "C", "r")],
        "`id ` string, ` main_label` string, reason string")
    rows = evaluation.build_examples(sample, truth).collect()
    assert {(r.id, r.subject, r.category) for r in rows} == {("0", "", "A"), ("2", "", "B")}
    assert sorted(r.split for r in rows) == ["train", "val"]


def test_class_only_in_val(spark):
    df = spark.createDataFrame([("A", "train"), ("A", "val"), ("B", "val")], "category string, split string")
    rows = [tuple(r) for r in evaluation.split_distribution(df).collect()]
    assert rows == [("A", 0, 1, 1, False), ("B", 0, 0, 1, True), ("TOTAL", 1, 1, 2, False)]
    assert [tuple(r) for r in evaluation.split_distribution(df.limit(0)).collect()] in (
        [], [("TOTAL", 1, 0, 0, False)])


def test_equal_candidates(spark):
    rows = [("b", 50.0), ("a", 50.0), ("c", 10.0)]
    df = spark.createDataFrame(rows, "candidate_id string, accuracy_pct double")
    assert evaluation.best_candidate(df).first().candidate_id == "a"
    row = evaluation.baseline_and_best(df, "c").first()
    assert tuple(row) == (10.0, "a", 50.0, 40.0)


def test_sample_needs_its_columns(spark):
    with pytest.raises(ValueError):
        pred.require_columns(spark.range(1), SAMPLE_COLUMNS)
