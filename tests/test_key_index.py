"""The key index of the store: what it reads, what it knows, and what a lost job leaves."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from newsflow.operators import merge
from newsflow.scratch import matching
from newsflow.sources import key_index, store

DAY = datetime.datetime(2023, 7, 1, tzinfo=datetime.timezone.utc)


def messages(spark, ids, day=0, text="x", source="a"):
    return spark.createDataFrame(
        [(source, str(i), DAY + datetime.timedelta(days=day), text) for i in ids],
        "source string, message_id string, publish_date timestamp, initial_text string")


@pytest.fixture
def path(tmp_path):
    return str(tmp_path / "store")


def rows(spark, path):
    return sorted((r.message_id, r.initial_text, r.publish_day.day)
                  for r in store.scan_store(spark, path).collect())


def test_new_keys_read_few_buckets_and_old_ones_their_own(spark, path):
    store.write_messages(spark, path, messages(spark, range(3000)))
    assert len(key_index.possible_buckets(spark, path, messages(spark, range(3)))) in (1, 2, 3)
    wrong = sum(len(key_index.possible_buckets(spark, path, messages(spark, [i])))
                for i in range(9000, 9005))
    assert wrong <= 2  # of five keys that are not there
    found = key_index.lookup(spark, path, messages(spark, [5, 6, 9999]))
    assert sorted(r.message_id for r in found.collect()) == ["5", "6"]
    read = {f.split("bucket=")[1].split("/")[0] for f in found.inputFiles() if "bucket=" in f}
    assert len(read) <= 3


def test_keys_are_not_sent_to_the_driver(spark, path, monkeypatch):
    store.write_messages(spark, path, messages(spark, range(30)))
    found = key_index.lookup(spark, path, messages(spark, [5, 6]))
    assert found.count() == 2
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    written = spark.range(10).select("id")
    assert "Broadcast" in spark.range(9).join(merge.sized(written), "id")._jdf.queryExecution().toString()
    monkeypatch.setattr(merge, "BROADCAST_KEYS", 5)
    joined = spark.range(9).join(merge.sized(written), "id")
    assert "Broadcast" not in joined._jdf.queryExecution().toString()


def test_moves_repeats_and_other_sources(spark, path):
    store.write_messages(spark, path, messages(spark, range(20)))
    store.write_messages(spark, path, messages(spark, [3], day=2, text="moved"))
    for _ in range(2):
        store.write_messages(spark, path, messages(spark, [3, 50], day=3, text="again"))
    store.write_messages(spark, path, messages(spark, [3], source="b"))
    got = rows(spark, path)
    assert len(got) == 22 and [r for r in got if r[0] == "3"] == [("3", "again", 4), ("3", "x", 1)]
    # what the index knows too much goes with a rebuild
    three = key_index.lookup(spark, path, messages(spark, [3]))
    assert {r.day.day for r in three.collect()} == {1, 3, 4}
    store.build_key_index(spark, path, buckets=4)
    three = key_index.lookup(spark, path, messages(spark, [3]))
    assert {r.day.day for r in three.collect()} == {4}
    store.write_messages(spark, path, messages(spark, [3], text="last"))
    assert [r for r in rows(spark, path) if r[0] == "3"] == [("3", "last", 1), ("3", "x", 1)]


def test_a_job_lost_between_index_and_rows(spark, path, monkeypatch):
    store.write_messages(spark, path, messages(spark, range(5)))
    batch = messages(spark, [4, 7, 8], day=1, text="new")
    monkeypatch.setattr(store, "_append", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        store.write_messages(spark, path, batch)
    monkeypatch.undo()
    for _ in range(2):
        store.write_messages(spark, path, batch)
        got = rows(spark, path)
        assert [r[0] for r in got] == ["0", "1", "2", "3", "4", "7", "8"]
        assert got[-1] == ("8", "new", 2)


def test_a_table_without_an_index_gets_one(spark, path, tmp_path):
    store.ensure_store(spark, path)
    store._append(path, messages(spark, range(9)), store.KEY)
    assert not key_index.exists(spark, path)
    store.write_messages(spark, path, messages(spark, [2, 9], text="y"))
    assert key_index.exists(spark, path) and len(rows(spark, path)) == 10


def test_many_writes_are_folded(spark, path, monkeypatch):
    monkeypatch.setattr(key_index, "MOST_FILES", 0)
    draw, want = random.Random(4), set()
    for i in range(4):
        ids = draw.sample(range(40), 8)
        want |= set(map(str, ids))
        store.write_messages(spark, path, messages(spark, ids, day=i % 2))
    assert {r[0] for r in rows(spark, path)} == want and len(rows(spark, path)) == len(want)
    assert len(matching(spark, f"{path}/_keys/version=*")) == 1


def test_null_and_other_keys(spark, path):
    none = messages(spark, [1]).withColumn("message_id", F.lit(None).cast("string"))
    store.write_messages(spark, path, none)
    store.write_messages(spark, path, none.withColumn("initial_text", F.lit("z")))
    assert [r.initial_text for r in store.scan_store(spark, path).collect()] == ["z"]
    store.write_messages(spark, path, messages(spark, [1], source="c"), key_cols=("source",))
    store.write_messages(spark, path, messages(spark, [2], source="c", text="w"),
                         key_cols=("source",))
    assert sorted(r.initial_text for r in store.scan_store(spark, path).collect()) == ["w", "z"]


def test_rows_that_lose_their_date_leave_others_alone(spark, path):
    undated = messages(spark, [1, 2]).withColumn("publish_date", F.lit(None).cast("timestamp"))
    store.write_messages(spark, path, undated)
    store.write_messages(spark, path, messages(spark, [3]))
    store.write_messages(spark, path, messages(spark, [3]).drop("publish_date"), mode="replace")
    assert [r[0] for r in rows(spark, path)] == ["1", "2", "3"]
