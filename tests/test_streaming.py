import json

import pytest
from pyspark.sql import functions as F

from newsflow.operators import report, select
from newsflow.plans import enrich
from newsflow.schema import FEED
from newsflow.sources import feed, store
from newsflow.streaming import flows

CHANNELS = {"1": [10, 11], "2": [12]}


def write_files(folder, files):
    folder.mkdir(exist_ok=True)
    for name, rows in files.items():
        (folder / name).write_text("\n".join(json.dumps(r) for r in rows), encoding="utf-8")


def record(i, channel=10, day=1, text="t", message=""):
    return {"message_id": i, "channel_id": channel, "publish_date": f"2024-01-{day:02d}T10:00:00Z",
            "source": f"**канал** {channel}", "text": text, "message": message}


FILES = {
    "a.json": [record(1), record(2, 11), record(3, 99), record(4, text="", message="друга форма")],
    "b.json": [record(1, text="виправлено"), record(5, 12, day=2), record(6, text="")],
    "c.json": [record(2, 11), record(7, 10, day=3)],
}


@pytest.fixture
def folders(tmp_path):
    write_files(tmp_path / "in", FILES)
    return {name: str(tmp_path / name) for name in ("in", "store", "checkpoint", "out")}


def ingest(spark, folders, **options):
    stream = feed.live_source(spark, folders["in"], CHANNELS, maxFilesPerTrigger=1, **options)
    flows.stream_ingest(stream, folders["store"], folders["checkpoint"]).awaitTermination()


def stored(spark, folders):
    return {(r.source, r.message_id): r.initial_text
            for r in store.scan_store(spark, folders["store"]).collect()}


def test_stream_equals_batch(spark, folders, tmp_path):
    ingest(spark, folders)
    batch = spark.read.schema(FEED).json(folders["in"])
    kept = batch.transform(lambda d: select.monitored(d, CHANNELS)) \
        .transform(select.non_empty_text).transform(select.to_body)
    keys = {(r.source, r.message_id) for r in kept.collect()}
    got = stored(spark, folders)
    assert set(got) == keys
    assert got[("канал 10", "4")] == "друга форма"
    assert ("канал 99", "3") not in got
    assert len(got) == 5


def test_stream_resumes_and_a_repeat_changes_nothing(spark, folders, tmp_path):
    ingest(spark, folders)
    before = stored(spark, folders)
    ingest(spark, folders)
    assert stored(spark, folders) == before
    write_files(tmp_path / "in", {"d.json": [record(1, text="виправлено"), record(8, 12, day=4)]})
    ingest(spark, folders)
    after = stored(spark, folders)
    assert set(after) - set(before) == {("канал 12", "8")}
    # the whole feed again, as after a lost checkpoint
    folders["checkpoint"] += "-new"
    ingest(spark, folders)
    assert set(stored(spark, folders)) == set(after)


def test_dedup_knows_all_that_came_before(spark, folders, tmp_path):
    def run():
        stream = feed.live_source(spark, folders["in"], maxFilesPerTrigger=1).withColumn(
            "message_id", F.col("message_id").cast("string"))
        flows.stream_dedup(stream, folders["out"], folders["checkpoint"]).awaitTermination()
        return flows.read_once(spark, folders["out"], stream.schema).collect()
    assert sorted(r.message_id for r in run()) == ["1", "2", "3", "4", "5", "6", "7"]
    # months later, and older than all the rest: only the new one is added
    write_files(tmp_path / "in", {"d.json": [record(1, day=31), record(9), record(7, 10, day=3)]})
    assert sorted(r.message_id for r in run()) == ["1", "2", "3", "4", "5", "6", "7", "9"]
    assert [r.publish_date.day for r in run() if r.message_id == "1"] == [1]
    assert not list((tmp_path / "checkpoint").glob("state/*"))
    # the last batch again, as after a failure between its output and its commit
    last = max((tmp_path / "checkpoint" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    last.unlink()
    assert sorted(r.message_id for r in run()) == ["1", "2", "3", "4", "5", "6", "7", "9"]


@pytest.mark.parametrize("merge_every", [1, 20])
def test_histogram_equals_batch(spark, folders, tmp_path, merge_every):
    def run():
        stream = feed.live_source(spark, folders["in"], maxFilesPerTrigger=1)
        flows.stream_histogram(stream, folders["out"], folders["checkpoint"],
                               merge_every=merge_every).awaitTermination()
        batch = report.date_histogram(spark.read.schema(FEED).json(folders["in"]))
        assert {tuple(r) for r in flows.read_histogram(spark, folders["out"])
                .select("day", "source", "messages").collect()} == \
            {tuple(r) for r in batch.select("day", "source", "messages").collect()}
    run()
    write_files(tmp_path / "in", {"d.json": [record(10, day=1), record(11, day=9)]})
    run()
    assert not list((tmp_path / "checkpoint").glob("state/*"))
    assert len(list((tmp_path / "out").glob("merged=*"))) == (merge_every == 1)


def test_incremental_enrichment_takes_up_what_failed(spark, folders):
    ingest(spark, folders)

    def half(messages):
        done = enrich.clean_ner_by_rules(messages)
        failed = F.col("source") == "канал 10"
        return done.withColumn("cleared_text", F.when(~failed, F.col("cleared_text")))

    assert flows.enrich_incremental(spark, folders["store"], half) == 5
    assert flows.enrich_incremental(spark, folders["store"], enrich.clean_ner_by_rules, 2) == 2
    assert flows.enrich_incremental(spark, folders["store"], enrich.clean_ner_by_rules) == 1
    assert flows.enrich_incremental(spark, folders["store"], enrich.clean_ner_by_rules) == 0
    rows = store.scan_store(spark, folders["store"]).collect()
    assert len(rows) == 5 and all(r.cleared_text and r.initial_text for r in rows)


def test_a_backlog_is_worked_off_and_failures_do_not_loop(spark, folders):
    ingest(spark, folders)
    rounds = []

    def all_but_one(messages):
        rounds.append(messages.count())
        done = enrich.clean_ner_by_rules(messages)
        return done.withColumn("cleared_text", F.when(F.col("message_id") != "1",
                                                      F.col("cleared_text")))

    flows.enrich_backlog(spark, folders["store"], all_but_one, limit=2)
    left = store.scan_store(spark, folders["store"]).filter("cleared_text is null").collect()
    assert [r.message_id for r in left] == ["1"]
    assert max(rounds) == 2 and len(rounds) <= 6


def test_enrichment_job_runs_at_intervals(spark, folders):
    import time
    ingest(spark, folders)
    query = flows.enrich_forever(spark, folders["store"], enrich.clean_ner_by_rules,
                                 folders["checkpoint"] + "-enrich", interval="1 second")
    deadline = time.time() + 60
    while time.time() < deadline and \
            store.scan_store(spark, folders["store"]).filter("cleared_text is null").count():
        time.sleep(1)
    query.stop()
    assert store.scan_store(spark, folders["store"]).filter("cleared_text is null").count() == 0
