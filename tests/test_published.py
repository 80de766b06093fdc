"""Published versions, the store of landing files, the ledger, reports: reruns, stops, copies."""

import json
from dataclasses import replace
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F
from test_jobs import DAY, LABELS, RECORDS, RULES, deliver, job, record, rows, run_stream  # noqa: F401

from mailmill.operators import actions as act
from mailmill.operators.predicates import INBOX, UNREAD, UNREAD_PRIMARY
from mailmill.plans import jobs
from mailmill.schemas import ACTION, SCORED
from mailmill.sources import ingest, tables
from mailmill.sources.ingest import MessageStore
from mailmill.sources.ledger import Ledger
from mailmill.sources.published import PublishedTable
from mailmill.streaming import incremental

SCHEMA = "id string, n int"


def plan_of(df):
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "5000")
    try:
        return df._jdf.queryExecution().executedPlan().toString()
    finally:
        df.sparkSession.conf.unset("spark.sql.maxMetadataStringLength")


@pytest.fixture
def table(spark, tmp_path):
    return PublishedTable(f"{tmp_path}/table", spark.createDataFrame([], SCHEMA).schema, ("day", "cap"))


def put(spark, table, data, **of):
    return table.publish(spark.createDataFrame(data, SCHEMA), **of)


def test_a_partition_is_replaced_whole(spark, table):
    assert table.read(spark).collect() == []
    put(spark, table, [("a", 1), ("b", 2)], day="1", cap="all")
    put(spark, table, [("c", 3)], day="1", cap="5")
    put(spark, table, [("d", 4)], day="2", cap="all")
    put(spark, table, [("e", 5)], day="1", cap="all")
    assert rows(table.read(spark), "id", "day", "cap") == [("c", "1", "5"), ("d", "2", "all"), ("e", "1", "all")]
    assert table.stale_versions(spark).count() == 1


def test_a_version_without_rows_empties_its_partition(spark, table):
    put(spark, table, [], day="1", cap="all")
    assert table.read(spark).collect() == [] and table.is_published(spark, day="1", cap="all")
    put(spark, table, [("a", 1)], day="1", cap="all")
    put(spark, table, [("b", 1)], day="2", cap="all")
    put(spark, table, [], day="1", cap="all")
    assert rows(table.read(spark), "id") == [("b",)]


def test_a_writer_that_stops_before_its_commit_changes_nothing(spark, table, monkeypatch):
    put(spark, table, [("a", 1)], day="1", cap="all")

    def stop(*_, **__):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(PublishedTable, "commit", stop)
        with pytest.raises(RuntimeError):
            put(spark, table, [("b", 2)], day="1", cap="all")
    assert rows(table.read(spark), "id") == [("a",)]
    put(spark, table, [("c", 3)], day="1", cap="all")
    assert rows(table.read(spark), "id") == [("c",)]


def test_versions_are_partition_filters(spark, table):
    version = put(spark, table, [("a", 1)], day="1", cap="all")
    put(spark, table, [("a", 1)], day="2", cap="all")
    plan = plan_of(table.read(spark, day="1").where("n > 0"))
    filters = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert version in filters and "day" in filters
    assert "n" in plan.split("PushedFilters: [")[1].split("]")[0]


def test_partitions_are_named_whole(spark, table):
    with pytest.raises(ValueError):
        put(spark, table, [("a", 1)], day="1")


# The store


def broken(folder, name):
    folder.mkdir(exist_ok=True)
    lines = [json.dumps(record("20", "a sale", "INBOX", "UNREAD")), '{"id": "21", "labelIds"', "no json",
             "", '{"labelIds": ["INBOX"]}', '["a list"]', json.dumps(record("22", "ü" * 300_000, "INBOX"))]
    (folder / name).write_text("\n".join(lines) + "\n")


def test_broken_lines_are_put_aside(spark, job, tmp_path):  # noqa: F811
    broken(tmp_path / "landing", "bad file.json")
    store = jobs.ingest(spark, job)
    found = store.rejects()
    assert rows(found, "reject_reason") == [(ingest.NO_ID,)] + [(ingest.BAD_LINE,)] * 3
    assert '{"id": "21", "labelIds"' in {r.line for r in found.collect()}
    counts = {r.file.rsplit("/", 1)[1]: (r.messages, r.rejects) for r in store.manifest().collect()}
    assert counts == {"bad%20file.json": (2, 4), "one.json": (6, 0)}
    assert rows(store.messages(INBOX).where("id >= '20'"), "id") == [("20",), ("22",)]
    assert len(store.raw(INBOX).where("id = '22'").first().payload) > 300_000


def test_files_are_taken_once(spark, job, tmp_path, monkeypatch):  # noqa: F811
    store = MessageStore(spark, job.root)
    assert store.ingest(job.landing, DAY) is not None
    assert store.ingest(job.landing, DAY) is None
    deliver(tmp_path / "landing", "two.json", [record("07", "new", "INBOX")])

    def stop(*_, **__):
        raise RuntimeError("lost")

    # A run that notes its files and then stops leaves them to the next one.
    with monkeypatch.context() as patch:
        patch.setattr(MessageStore, "_parsed", stop)
        with pytest.raises(RuntimeError):
            store.ingest(job.landing, DAY)
    assert store.messages(INBOX).count() == 5
    assert store.ingest(job.landing, DAY) is not None
    assert store.messages(INBOX).count() == 6 and store.taken_files().count() == 2
    assert MessageStore(spark, f"{job.root}/other").ingest(f"{tmp_path}/nowhere", DAY) is None


def test_many_files_are_joined_not_listed(spark, job, tmp_path, monkeypatch):  # noqa: F811
    broken(tmp_path / "landing", "bad file.json")
    monkeypatch.setattr(ingest, "small_rows", lambda *_: None)
    store = jobs.ingest(spark, job)
    assert store.rejects().count() == 4 and store.rows.read(spark).count() == 12


def test_the_newest_copy_decides_the_scope(spark, job, tmp_path):  # noqa: F811
    store = jobs.ingest(spark, job)
    deliver(tmp_path / "landing", "z.json", [record("01", "read by now", "INBOX"), record("04", "a", "INBOX", "UNREAD")])
    jobs.ingest(spark, replace(job, day=DAY + timedelta(days=1)))
    assert rows(store.messages(UNREAD), "id") == [("02",), ("03",), ("04",), ("05",)]
    assert rows(store.messages(UNREAD, since=DAY + timedelta(days=1)), "id") == [("04",)]


def test_scope_and_day_reach_the_scan(spark, job):  # noqa: F811
    store = jobs.ingest(spark, job)
    plan = plan_of(store.raw(UNREAD, since=DAY).select("id"))
    scan = plan.split("FileScan parquet")[-1]
    assert all(f"EqualTo({flag},true)" in scan or flag in scan.split("PushedFilters")[1] for flag in ("is_inbox", "is_unread"))
    assert "ingest_day" in scan.split("PartitionFilters: [")[1].split("]")[0]
    assert "kind" in scan.split("PartitionFilters: [")[1].split("]")[0]
    assert "payload" not in scan.split("ReadSchema")[1]


# The ledger and runs


def test_history_is_matched_where_it_lies(spark, tmp_path):
    ledger = Ledger(spark, f"{tmp_path}/ledger", buckets=4)
    category = F.when(F.col("id") % 2 == 0, "ADS").otherwise("OTHERS").alias("category")
    history = spark.range(2000).select(F.col("id").cast("string"), category)
    ledger.add(history, spark.createDataFrame([("v",)], "version string"))
    due = spark.range(1990, 2010).select(F.col("id").cast("string"), category)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        fresh = ledger.without_done(due)
        assert rows(fresh, "id") == [(str(i),) for i in range(2000, 2010)]
        plan = plan_of(fresh)
        history_side = plan[plan.rindex("Sort ["):]
        assert "SortMergeJoin" in plan and "Exchange" not in history_side and "Bucketed: true" in history_side
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert rows(ledger.among(["5", "9999"]), "id") == [("5",)]


def test_ledger_takes_in_each_version_once_and_can_be_made_anew(spark, tmp_path):
    table = tables.action_table(str(tmp_path))
    actions = spark.createDataFrame(
        [("1", "ADS", "L", act.APPLIED, None, None), ("2", "ADS", "L", act.ERROR, None, "x"), ("3", None, None, act.SKIPPED, "r", None)], ACTION)
    table.publish(actions, run_id="a")
    for buckets in (2, 2, 3):
        ledger = Ledger(spark, f"{tmp_path}/done", buckets).take_in(table, (act.APPLIED,))
        assert rows(ledger.rows(), "id") == [("1",)]
    # What a replaced version did was done.
    table.publish(actions.where("id = '3'"), run_id="a")
    assert rows(Ledger(spark, f"{tmp_path}/done", 2).take_in(table, (act.APPLIED,)).rows(), "id") == [("1",)]


def test_two_caps_of_a_day_do_nothing_twice(spark, job):  # noqa: F811
    calls = spark.sparkContext.accumulator(0)

    def connect():
        return lambda message_id, label_id: calls.add(1)

    for cap in (1000, 1, 1000):
        jobs.tag_recent(spark, job, RULES, cap, connect=connect)
    done = tables.read_actions(spark, job.root, ACTION).where("outcome = 'applied'")
    assert rows(done, "id") == [("01",), ("04",), ("05",)] and calls.value == 3
    scored = tables.scored_table(job.root).read(spark)
    assert rows(scored.groupBy("cap").count(), "cap", "count") == [("1", 1), ("1000", 5)]


def test_a_rerun_that_finds_nothing_empties_its_table(spark, job, tmp_path):  # noqa: F811
    jobs.daily_run(spark, job, RULES, dry_run=True)
    deliver(tmp_path / "landing", "z.json", [record(i, "read", "INBOX") for i in ("01", "02", "05")])
    assert jobs.daily_run(spark, job, RULES, dry_run=True).count() == 0
    assert tables.raw_table(job.root).read(spark).count() == 0
    assert tables.scored_table(job.root).read(spark).count() == 0


def test_report_of_a_run(spark, job):  # noqa: F811
    def connect():
        def add(message_id, label_id):
            if message_id == "05":
                raise PermissionError("read only")
        return add

    jobs.daily_run(spark, job, RULES, connect=connect)
    told = jobs.read_report(spark, job, UNREAD_PRIMARY)
    by = {}
    for r in told.orderBy("section", "position").collect():
        by.setdefault(r.section, []).append((r.name, r.n, r.detail))
    assert [n for _, n, _ in by["labels"]].count(1) == 1 and by["labels"][0][2] == "1/16"
    assert by["stages"] == [("fetched", 3, None), ("classified", 3, None), ("failed", 0, None)]
    assert by["categories"] == [("ADS", 2, "█" * 60), ("OTHERS", 1, "█" * 30)]
    assert by["actions"] == [("applied", 1, None), ("error", 1, None), ("skipped", 1, "no label")]
    assert by["errors"] == [("05", None, "PermissionError: read only")]


# The stream


def test_a_second_checkpoint_keeps_old_batches(spark, job, tmp_path):  # noqa: F811
    run_stream(spark, job)
    deliver(tmp_path / "landing", "two.json", [record("08", "sale", "INBOX", "UNREAD")])
    # A new stream reads all files again; what was published is not published twice.
    run_stream(spark, job, checkpoint=f"{job.root}/second")
    got = incremental.read_stream_table(spark, f"{job.root}/scored", SCORED)
    assert rows(got, "id") == [("01",), ("02",), ("03",), ("05",), ("08",)]
    assert got.select("stream_id").distinct().count() == 2


def test_a_copy_beyond_the_lifetime_is_not_done_again(spark, job, tmp_path):  # noqa: F811
    calls = spark.sparkContext.accumulator(0)

    def connect():
        return lambda message_id, label_id: calls.add(1)

    run_stream(spark, job, within="1 second", connect=connect)
    import os
    import time

    for k, name in enumerate(("later.json", "copy.json")):
        deliver(tmp_path / "landing", name, [RECORDS[0], record(f"3{k}", "sale", "INBOX", "UNREAD")])
        os.utime(tmp_path / "landing" / name, (time.time() + 10_000 * (k + 1),) * 2)
        run_stream(spark, job, within="1 second", connect=connect)
    done = incremental.read_stream_table(spark, f"{job.root}/label_actions", ACTION).where("outcome = 'applied'")
    assert rows(done, "id") == [("01",), ("05",), ("30",), ("31",)] and calls.value == 4


def test_a_batch_that_stopped_between_its_tables_goes_on(spark, job, monkeypatch):  # noqa: F811
    real = act.plan_actions

    def stop(*_, **__):
        raise RuntimeError("lost")

    monkeypatch.setattr(act, "plan_actions", stop)
    with pytest.raises(Exception):
        run_stream(spark, job)
    monkeypatch.setattr(act, "plan_actions", real)
    run_stream(spark, job)
    got = incremental.read_stream_table(spark, f"{job.root}/label_actions", ACTION)
    assert rows(got, "id") == [("01",), ("02",), ("03",), ("05",)]
    scored = incremental.read_stream_table(spark, f"{job.root}/scored", SCORED)
    assert rows(scored, "id") == rows(got, "id")


def test_store_takes_records_without_a_shuffle(spark, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    (landing / "a.json").write_text('{"id":"1","labelIds":["INBOX","UNREAD"]}\n{"id":"2","labelIds":[]}\nno json\n')
    store = MessageStore(spark, f"{tmp_path}/root")
    files = spark.createDataFrame([(f"{landing}/a.json", f"file://{landing}/a.json")], "path string, uri string")
    plan = store._parsed(f"{landing}", files)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    store.ingest(f"{landing}", DAY)
    assert store.rejects().count() == 1
    assert list(tmp_path.glob("root/ingested/data/*/*/*/kind=message/is_inbox=true/is_unread=true/*/*.parquet"))
