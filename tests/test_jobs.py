"""Files, tables, batch jobs and the stream, end to end in temporary folders."""

import base64
import json
from dataclasses import replace
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from mailmill.categories import CATEGORIES, category_dim
from mailmill.operators.predicates import UNREAD
from mailmill.operators.scoring import RuleScorer
from mailmill.plans import jobs
from mailmill.plans.normalise import normalise_messages
from mailmill.schemas import ACTION, LABEL_DIM, MESSAGE, RAW, SCORED_CSV, TRUTH
from mailmill.session import work_dir
from mailmill.sources import csv_files, landing, tables
from mailmill.streaming import incremental

DAY = date(2026, 3, 19)
RULES = RuleScorer((("ADS", ("sale",)), ("OTHERS", ("other",)), ("AMAZON_PAY", ("wallet",))))
LABELS = [("INBOX", "INBOX"), ("UNREAD", "UNREAD"), ("Label_1", "ADS"), ("Label_2", "Mine")]


def record(key, words, *labels, minute=0, subject="s"):
    data = base64.urlsafe_b64encode(words.encode()).decode()
    return {
        "id": key, "labelIds": list(labels), "internalDate": str(1_773_925_200_000 + minute * 60_000),
        "payload": {
            "mimeType": "multipart/mixed",
            "headers": [{"name": "From", "value": "me"}, {"name": "Subject", "value": subject}],
            "parts": [{"mimeType": "text/plain", "body": {"data": data}}],
        },
    }


RECORDS = [
    record("01", "a big sale", "INBOX", "UNREAD", minute=1),
    record("02", "other things", "INBOX", "UNREAD", "Label_2", minute=2),
    record("03", "my wallet", "INBOX", "UNREAD", "CATEGORY_SOCIAL", minute=3),
    record("04", "a sale read before", "INBOX", minute=4),
    record("05", "sale  \n\n of é", "INBOX", "UNREAD", "CATEGORY_PERSONAL", minute=5),
    {"id": "06"},
]


def deliver(folder, name, records):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(json.dumps(r) + "\n" for r in records))


@pytest.fixture
def job(tmp_path):
    deliver(tmp_path / "landing", "one.json", RECORDS)
    dim = [{"label_id": i, "label_name": n, "scan_order": k} for k, (i, n) in enumerate(LABELS)]
    deliver(tmp_path / "labels", "labels.json", dim)
    return jobs.Job(f"{tmp_path}/landing", f"{tmp_path}/labels", f"{tmp_path}/root", DAY, ledger_buckets=4)


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_landing_reads_only_its_fields(spark, job):
    raw = landing.read_raw(spark, job.landing)
    assert raw.columns == RAW.names
    assert raw.where("id = '01'").first().payload.startswith('{"mimeType"')
    plan = raw.select("id", "labelIds")._jdf.queryExecution().executedPlan().toString()
    assert "payload" not in plan.split("ReadSchema")[1]


def test_normalised_golden(spark, job):
    raw, dim = landing.read_raw(spark, job.landing), landing.read_label_dim(spark, job.labels)
    flat = normalise_messages(raw, dim)
    assert flat.columns == MESSAGE.names
    row = flat.where("id = '05'").first()
    assert (row.date, row["from"], row.subject, row.body_text) == (
        "2026-03-19T18:35:00+05:30", "me", "s", "sale\n of é")
    assert row.labels == ["INBOX", "UNREAD", "CATEGORY_PERSONAL"]
    bare = flat.where("id = '06'").first()
    assert tuple(bare) == ("06", "", None, "", "", "", [])
    assert normalise_messages(raw.limit(0), dim).count() == 0
    plan = flat._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_daily_run_and_its_repeats(spark, job):
    def connect():
        return lambda message_id, label_id: None

    scored = jobs.daily_run(spark, job, RULES, connect=connect)
    assert rows(scored, "id", "category") == [("01", "ADS"), ("02", "OTHERS"), ("05", "ADS")]
    done = tables.read_actions(spark, job.root, ACTION)
    want = [("01", "applied"), ("02", "skipped"), ("05", "applied")]
    assert rows(done, "id", "outcome") == want
    # The same day again leaves the same rows.
    jobs.daily_run(spark, job, RULES, connect=connect)
    assert rows(tables.read_actions(spark, job.root, ACTION), "id", "outcome") == want
    # The next day the mail is still unread; nothing is applied twice.
    later = replace(job, day=DAY + timedelta(days=1))
    jobs.daily_run(spark, later, RULES, all_tabs=True, connect=connect)
    again = tables.read_actions(spark, job.root, ACTION)
    assert again.where("outcome = 'applied'").count() == 2


def test_dry_run_writes_no_actions(spark, job):
    jobs.daily_run(spark, job, RULES, dry_run=True)
    assert tables.read_actions(spark, job.root, ACTION).count() == 0


def test_cache_and_caps(spark, job, tmp_path):
    first = jobs.tag_recent(spark, job, RULES, max_messages=2, dry_run=True)
    assert rows(first, "id") == [("04",), ("05",)]
    deliver(tmp_path / "landing", "two.json", [record("07", "sale", "INBOX", minute=9)])
    # The stored day is used again for the same cap, not for another one.
    assert rows(jobs.tag_recent(spark, job, RULES, 2, dry_run=True), "id") == [("04",), ("05",)]
    assert rows(jobs.tag_recent(spark, job, RULES, 3, dry_run=True), "id") == [("04",), ("05",), ("07",)]
    manifest = tables.read_manifest(spark, job.root)
    assert rows(manifest, "scope", "run_date", "max_messages", "row_count") == [
        ("inbox", "19Mar2026", 2, 2), ("inbox", "19Mar2026", 3, 3)]


def test_labelled_set(spark, job):
    assert rows(jobs.labelled_set(spark, job), "id", "body_text") == [("02", "other things")]
    assert jobs.labelled_set(spark, job, max_messages=2, anywhere=True).count() == 0


def test_sample_and_evaluation(spark, job):
    scored = jobs.daily_run(spark, job, RULES, all_tabs=True, dry_run=True)
    sample = jobs.sample_labelled(scored, 1)
    assert sample.count() == 3 and sample.columns[-2:] == ["category", "reason"]
    truth = scored.select("id", F.lower("category").alias("main_label"), "reason")
    nothing = RuleScorer((("ADS", ("never",)),))
    for _ in range(2):
        kept = jobs.evaluate(scored, truth, {"rules": RULES, "none": nothing}, job.root, "r1")
        assert rows(kept, "candidate_id", "n") == [("none", 1), ("rules", 1)]
    assert kept.where("candidate_id = 'rules'").first().accuracy_pct == 100.0


def test_csv_keeps_every_character(spark, tmp_path):
    bodies = ["a\nb", 'say "hi", \\"x\\"', "  lead and trail  ", "a\r\nb", ",", "#x", "", None, "\\", '"', "é😀"]
    data = [(f"{i:03}", "", "f", "s", b, ["IN'BOX", 'q"'], None, None) for i, b in enumerate(bodies)]
    schema = "id string, date string, `from` string, subject string, body_text string, labels array<string>, category string, reason string"
    df = spark.createDataFrame(data, schema)
    csv_files.write_csv(df, f"{tmp_path}/csv")
    back = csv_files.with_label_lists(csv_files.read_csv(spark, f"{tmp_path}/csv", SCORED_CSV))
    assert sorted(map(tuple, back.collect())) == sorted(data)


def test_csv_header_is_checked(spark, tmp_path):
    (tmp_path / "t.csv").write_text("id,reason,main_label\n007,r,A\n")
    with pytest.raises(Exception, match="header"):
        csv_files.read_csv(spark, f"{tmp_path}/t.csv", TRUTH).collect()


def test_half_a_partition_is_not_reused(spark, tmp_path):
    def fetch():
        return spark.createDataFrame([("1", "", None, "", "", "", [])], MESSAGE)

    run = tables.run_of("s", DAY)
    names = {**{k: F.lit(v) for k, v in run.items()}, "version": F.lit("stopped")}
    fetch().withColumns(names).write.partitionBy(*names).parquet(f"{tmp_path}/messages/data")
    calls = []
    tables.read_through(spark, str(tmp_path), "s", DAY, lambda: calls.append(1) or fetch())
    got = tables.read_through(spark, str(tmp_path), "s", DAY, lambda: calls.append(1) or fetch())
    assert calls == [1] and got.count() == 1


def test_category_dim(spark):
    assert [r.category for r in category_dim(spark).orderBy("rank").collect()] == list(CATEGORIES)


class FakeSession:
    """Only what `work_dir` asks of a session; the setting cannot change in a running one."""

    def __init__(self, master, shared=None):
        self.conf = {"spark.checkpoint.dir": shared} if shared else {}
        self.sparkContext = type("Context", (), {"master": master})


def test_work_dir_follows_the_session():
    assert work_dir(FakeSession("yarn", "hdfs://x/cp/"), "x").startswith("hdfs://x/cp/mailmill-x-")
    assert "mailmill-x-" in work_dir(FakeSession("local[4]"), "x")
    with pytest.raises(ValueError):
        work_dir(FakeSession("yarn"), "x")


# Stream


def run_stream(spark, job, checkpoint=None, **options):
    dim = spark.createDataFrame([(i, n, k) for k, (i, n) in enumerate(LABELS)], LABEL_DIM)
    query = incremental.start_incremental(
        spark, job.landing, dim, RULES, job.root, checkpoint or f"{job.root}/checkpoint", buckets=4, **options)
    query.awaitTermination()
    return query


@pytest.mark.parametrize("within", [None, "10 days"])
def test_stream_sees_each_message_once(spark, job, tmp_path, within):
    deliver(tmp_path / "landing", "copy.json", RECORDS[:3])
    run_stream(spark, job, within=within, files_per_batch=1)
    # A second run with repeats, one of them unread only now, and one new message.
    late = [RECORDS[0], record("04", "a sale read before", "INBOX", "UNREAD"), record("08", "sale", "INBOX", "UNREAD")]
    deliver(tmp_path / "landing", "two.json", late)
    run_stream(spark, job, within=within)
    got = incremental.read_stream_table(spark, f"{job.root}/label_actions", ACTION)
    assert rows(got, "id", "outcome") == [
        ("01", "pending"), ("02", "skipped"), ("03", "skipped"), ("04", "pending"), ("05", "pending"), ("08", "pending")]
    assert rows(incremental.pending_actions(spark, job.root), "id") == [("01",), ("04",), ("05",), ("08",)]
    # Nothing new, nothing done.
    run_stream(spark, job, within=within)
    assert got.count() == 6


def test_stream_equals_batch(spark, job):
    run_stream(spark, job)
    from mailmill.schemas import SCORED

    streamed = incremental.read_stream_table(spark, f"{job.root}/scored", SCORED)
    batch_job = replace(job, root=f"{job.root}/batch")
    batch = jobs.daily_run(spark, batch_job, RULES, all_tabs=True, dry_run=True)
    columns = ("id", "date", "from", "subject", "body_text", "labels", "category", "reason")
    assert rows(streamed, *columns) == rows(batch, *columns)


def test_stream_dry_run(spark, job, tmp_path):
    run_stream(spark, job, dry_run=True, scope=UNREAD)
    assert (tmp_path / "root" / "scored").exists()
    assert not (tmp_path / "root" / "label_actions").exists()
