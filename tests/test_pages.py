import datetime
import os

import pytest
from pyspark.sql import Row, functions as F

from newsflow.schema import FEED
from newsflow.sources import pages

START = datetime.datetime(2024, 5, 1, tzinfo=datetime.timezone.utc)


def _message(channel, i):
    return Row(message_id=i, channel_id=1, publish_date=START + datetime.timedelta(hours=i),
               source=channel, text=f"{channel} {i} \nnext", message="")


@pytest.fixture
def feed(spark, tmp_path):
    """Channel a: 100 messages. b: й/1: 5. Pages of 10. The client leaves a file per question."""
    class Counted(pages.FolderClient):
        log = str(tmp_path / "log")

        def page(self, channel, before):
            with open(f"{self.log}/{channel[0]}-{before}", "w"):
                return super().page(channel, before)

    folder = str(tmp_path / "pages")
    os.mkdir(Counted.log)
    rows = [_message("a", i) for i in range(100)] + [_message("b: й/1", i) for i in range(0, 50, 10)]
    pages.write_pages(spark.createDataFrame(rows, FEED), folder, 10)
    return Counted(folder, 10), rows


def _keys(df):
    return sorted((r.source, r.message_id) for r in df.select("source", "message_id").collect())


def test_all_messages_whole(spark, feed):
    client, rows = feed
    pages.register_pages(spark, client, "whole", span=25)
    read = pages.paged_feed(spark, "whole")
    assert read.schema == FEED
    found = read.select("message_id", "channel_id", F.unix_seconds("publish_date"), "source", "text",
                        "message").collect()
    assert sorted(map(tuple, found)) == sorted(
        (r.message_id, 1, int(r.publish_date.timestamp()), r.source, r.text, "") for r in rows)
    assert read.rdd.getNumPartitions() == 4 + 2


def test_pages_before_the_cutoff_are_not_read(spark, feed):
    client, rows = feed
    pages.register_pages(spark, client, "cut", span=1000)
    since = START + datetime.timedelta(hours=75)
    assert _keys(pages.paged_feed(spark, "cut", since)) == [("a", i) for i in range(75, 100)]
    # a: 90 to 99, 80 to 89, and the page with the cutoff; b: its newest is too old
    assert sorted(os.listdir(client.log)) == ["a-100", "a-80", "a-90", "b-41"]


def test_conditions_are_pushed_down(spark, feed):
    client, rows = feed
    spark.conf.set(pages.PUSHDOWN, "true")
    try:
        pages.register_pages(spark, client, "pushed", span=1000)
        read = pages.paged_feed(spark, "pushed").filter(
            (F.col("publish_date") >= F.lit("2024-05-04 20:00:00").cast("timestamp"))
            & (F.col("source") == "a"))
        assert _keys(read) == [("a", i) for i in range(92, 100)]
    finally:
        spark.conf.unset(pages.PUSHDOWN)
    assert sorted(os.listdir(client.log)) == ["a-100"]


def test_pages_of_a_block_share_a_file_and_gaps_are_passed(spark, tmp_path):
    folder = str(tmp_path / "pages")
    ids = [*range(1000), *range(50_000, 50_010)]
    pages.write_pages(spark.createDataFrame([_message("a", i) for i in ids], FEED), folder, 10)
    files = [f for _, _, names in os.walk(folder + "/source=a") for f in names if f.endswith(".json")]
    assert len(files) == 3  # 101 pages
    listed = []

    class Watched(pages.FolderClient):
        def _blocks(self, channel):
            listed.append(channel)
            return super()._blocks(channel)

    client = Watched(folder, 10)
    assert client.newest("a") == 50_009
    listed.clear()
    assert [m["message_id"] for m in client.page("a", 995)] == [994, 993, 992, 991, 990]
    assert [m["message_id"] for m in client.page("a", 640)] == list(range(639, 629, -1))
    assert not listed
    assert client.page("a", 50_000)[0]["message_id"] == 999 and len(listed) == 1
    assert client.page("a", 0) == []


def test_many_spans_share_tasks(feed, monkeypatch):
    client, rows = feed
    monkeypatch.setattr(pages, "MOST_TASKS", 4)
    reader = pages.PageReader(client, FEED, 7, None)
    tasks = reader.partitions()
    assert len(tasks) == 4 and max(len(task.spans) for task in tasks) == 6
    read = [m for task in tasks for batch in reader.read(task) for m in batch.to_pylist()]
    assert sorted((m["source"], m["message_id"]) for m in read) == sorted(
        (r.source, r.message_id) for r in rows)
    assert pages._tasks([]) == []


def test_stream_goes_on_from_its_offset(spark, feed, tmp_path):
    client, rows = feed

    def run():
        pages.register_pages(spark, client, "on", span=30)
        stream = pages.paged_feed(spark, "on", stream=True)
        (stream.writeStream.format("parquet").option("path", str(tmp_path / "out"))
         .option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True)
         .start().awaitTermination())
        return _keys(spark.read.schema(FEED).parquet(str(tmp_path / "out")))

    first = sorted((r.source, r.message_id) for r in rows)
    assert run() == first
    asked = set(os.listdir(client.log))
    assert run() == first and set(os.listdir(client.log)) == asked
    later = [_message("a", i) for i in range(100, 112)] + [_message("c", 3)]
    pages.write_pages(spark.createDataFrame(later, FEED), client.folder, 10)
    assert run() == sorted(first + [(r.source, r.message_id) for r in later])
    assert {n for n in os.listdir(client.log) if n.startswith("a-")} - asked == {
        "a-112", "a-110"}


def test_nothing_there(spark, tmp_path):
    pages.register_pages(spark, pages.FolderClient(str(tmp_path / "none"), 10), "empty")
    assert pages.paged_feed(spark, "empty").count() == 0


def test_page_that_does_not_go_back():
    class Stuck:
        def page(self, channel, before):
            return [_message("a", 7).asDict()]

    with pytest.raises(ValueError, match="go back"):
        list(pages._records(Stuck(), pages.Span("a", 0, 9), None))
