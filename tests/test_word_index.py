"""The word index finds what the full scan finds, whatever way its messages came."""

import datetime

import pytest

from newsflow.operators import search
from newsflow.scratch import matching
from newsflow.sources import store, word_index

DAY = datetime.datetime(2023, 9, 1, tzinfo=datetime.timezone.utc)
TEXTS = ["Київ чекає на матч", "матч матч матч", "сьогодні у місті дощ", "Київ. Київ! дощ", "", None,
         "довгий текст про матч та ще багато інших слів поспіль", "мат ч"]


def messages(spark, rows):
    return spark.createDataFrame(
        [("s", str(i), DAY + datetime.timedelta(days=day), text) for i, day, text in rows],
        "source string, message_id string, publish_date timestamp, initial_text string")


def both(spark, path, index, query):
    stored = store.scan_store(spark, path).drop("publish_day").filter("initial_text IS NOT NULL")
    return [[(r.message_id, pytest.approx(r.score)) for r in found.collect()] for found in (
        word_index.search(spark, index, query), search.text_search(stored, query))]


def test_index_follows_the_table(spark, tmp_path):
    path, index = str(tmp_path / "store"), str(tmp_path / "words")
    rows = [(i, i % 3, t) for i, t in enumerate(TEXTS)]
    store.write_messages(spark, path, messages(spark, rows[:4]))
    word_index.build(spark, path, index)
    for change in (rows, [(1, 0, "тепер інше"), (20, 5, "матч " * 50)], [(2, 4, "переїхав матч")]):
        days = store.write_messages(spark, path, messages(spark, change))
        for _ in range(2):  # an update may be repeated
            word_index.update(spark, path, index, days)
        got, want = both(spark, path, index, "Київ, матч?")
        assert got == want and got
    assert word_index.search(spark, index, ["немає"]).count() == 0
    assert word_index.search(spark, index, []).count() == 0


def test_a_search_reads_its_words_buckets(spark, tmp_path):
    path, index = str(tmp_path / "store"), str(tmp_path / "words")
    store.write_messages(spark, path, messages(spark, [(i, 0, f"w{i} спільне") for i in range(200)]))
    word_index.update(spark, path, index, {DAY.date()})
    assert len(matching(spark, f"{index}/buckets=16/postings/*/bucket=*")) == 16
    plan = word_index.postings(spark, index, ["w7"])
    assert plan.collect()[0].message_id == "7"
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in text and "PushedFilters: [" in text
    # a day without messages leaves the index
    store.write_messages(spark, path, messages(spark, [(500, 3, "пізніше")]))
    word_index.update(spark, path, index, {(DAY + datetime.timedelta(days=3)).date(), DAY.date()})
    store.write_messages(spark, path, messages(spark, [(500, 4, "пізніше")]))
    word_index.update(spark, path, index, {(DAY + datetime.timedelta(days=n)).date() for n in (3, 4)})
    assert word_index.search(spark, index, "пізніше").count() == 1


def test_files_grow_with_postings_not_with_days(spark, tmp_path):
    path, index = str(tmp_path / "store"), str(tmp_path / "words")
    days = store.write_messages(spark, path, messages(spark, [(i, i, f"w{i} спільне") for i in range(60)]))
    word_index.update(spark, path, index, days)
    first = matching(spark, f"{index}/buckets=16/postings/version=0/bucket=*/*.parquet")
    assert 16 <= len(first) <= 16 * word_index.PARTS
    # some days change: their old postings count no more; when all have changed, they are deleted
    for change in (range(20), range(60)):
        changed = store.write_messages(spark, path, messages(
            spark, [(i, i, f"w{i} спільне спільне") for i in change]))
        word_index.update(spark, path, index, changed)
        got, want = both(spark, path, index, "спільне")
        assert got == want and got
    assert len(matching(spark, f"{index}/buckets=16/postings/*")) == 1


def test_many_versions_become_one(spark, tmp_path, monkeypatch):
    path, index = str(tmp_path / "store"), str(tmp_path / "words")
    monkeypatch.setattr(word_index, "MOST_VERSIONS", 2)
    for i in range(4):
        word_index.update(spark, path, index, store.write_messages(
            spark, path, messages(spark, [(i, i, f"w{i} спільне спільне" + " ще" * i)])))
        got, want = both(spark, path, index, "спільне w1")
        assert got == want and len(got) == i + 1
    assert len(matching(spark, f"{index}/buckets=16/postings/*")) <= 2
