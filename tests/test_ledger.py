import os
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from newsflow import __main__ as commands
from newsflow.operators import ledger
from newsflow.operators.ledger import read_ledger, score_once
from newsflow.plans import jobs
from newsflow.sources import store

cloudpickle.register_pickle_by_value(sys.modules[__name__])
SCHEMA = "source string, batch_id long, request string"


class Model:
    """Answers with its name and leaves a file per request; what contains ``bad`` is refused."""

    def __init__(self, name, log, bad="never"):
        self.name, self.log, self.bad = name, str(log), bad

    def __call__(self, requests, setup):
        for request in requests:
            with open(f"{self.log}/{request}", "a") as file:
                file.write(".")
        if any("raise" in request for request in requests):
            raise OSError("lost")
        return ["Error: 400" if self.bad in r else f"{self.name} {r}" for r in requests]


@pytest.fixture
def log(tmp_path):
    (tmp_path / "log").mkdir()
    return tmp_path / "log"


def asked(log):
    return {name: len((log / name).read_text()) for name in os.listdir(log)}


def answers(told):
    return {(r.source, r.batch_id): (r.answer, r.error) for r in told.collect()}


def test_nothing_is_asked_twice(spark, tmp_path, log):
    path = str(tmp_path / "ledger")
    rows = [("a", i, f"q{i}") for i in range(6)] + [("b", i, "q0") for i in range(50)] \
        + [("c", 0, None), ("c", 1, "bad")]
    requests = spark.createDataFrame(rows, SCHEMA)
    first = answers(score_once(requests, Model("one", log, bad="bad"), path, "summary", rounds=3))
    assert first == {(s, i): (None, "no request") if q is None else
                     ("Error: 400", None) if q == "bad" else (f"one {q}", None) for s, i, q in rows}
    assert asked(log) == {**{f"q{i}": 1 for i in range(6)}, "bad": 1}
    second = answers(score_once(requests, Model("two", log), path, "summary"))
    assert second == first | {("c", 1): ("two bad", None)}
    assert asked(log) == {**{f"q{i}": 1 for i in range(6)}, "bad": 2}
    assert answers(score_once(requests, Model("three", log), path, "summary")) == second
    assert sum(asked(log).values()) == 8
    # another step, or other options, are other requests
    score_once(requests, Model("four", log), path, "tonality").collect()
    score_once(requests, Model("five", log), path, "summary", {"temperature": 0.5}).collect()
    assert asked(log)["q0"] == 3


def test_a_lost_call_is_asked_again(spark, tmp_path, log):
    path = str(tmp_path / "ledger")
    requests = spark.createDataFrame([("a", 0, "raise"), ("a", 1, "fine")], SCHEMA)
    told = answers(score_once(requests, Model("one", log), path, "summary", tasks=1))
    assert told == {("a", 0): (None, "OSError: lost"), ("a", 1): ("one fine", None)}
    score_once(requests, Model("one", log), path, "summary", tasks=1)
    assert asked(log) == {"raise": 2, "fine": 1}
    assert read_ledger(spark, path).count() == 1


def test_setups_of_a_row_are_part_of_the_request(spark, tmp_path, log):
    path = str(tmp_path / "ledger")
    grid = spark.createDataFrame([("a", 0, "q"), ("a", 1, "q")], SCHEMA).withColumn(
        "heat", F.col("batch_id") / 2)
    told = score_once(grid, Model("one", log), path, "summary", setup_cols=["heat"])
    assert told.count() == 2 and asked(log) == {"q": 2}


def test_a_reply_that_two_jobs_wrote_counts_once(spark, tmp_path, log):
    path = str(tmp_path / "ledger")
    requests = spark.createDataFrame([("a", 0, "q")], SCHEMA)
    score_once(requests, Model("one", log), path, "summary").collect()
    copied = str(tmp_path / "copy")
    read_ledger(spark, path).write.parquet(copied)
    spark.read.parquet(copied).write.mode("append").partitionBy("bucket").parquet(path)
    assert read_ledger(spark, path).count() == 2
    assert answers(score_once(requests, Model("two", log), path, "summary")) == {
        ("a", 0): ("one q", None)}


def test_no_requests(spark, tmp_path, log):
    empty = spark.createDataFrame([], SCHEMA)
    assert score_once(empty, Model("one", log), str(tmp_path / "ledger"), "summary").count() == 0


def test_options_reach_the_model(spark, tmp_path, log):
    path, ledger = str(tmp_path / "store"), str(tmp_path / "ledger")
    store.write_messages(spark, path, spark.createDataFrame(
        [("1", "a", "one"), ("2", "a", "two")],
        "message_id string, source string, initial_text string").withColumn(
            "publish_date", F.lit("2024-05-01 00:00:00").cast("timestamp")))
    (tmp_path / "templates.json").write_text('{"summary": "short, {count}: {texts}"}')
    (tmp_path / "setups.json").write_text('{"summary": {"temperature": 0.1}}')
    log_dir = str(log)

    def model(requests, setup):
        with open(f"{log_dir}/calls", "a") as file:
            file.write(f"{setup['temperature']} {requests[0][:8]}|")
        return [f"Текст #1: {len(requests)}" for _ in requests]

    commands._function = lambda name: model
    args = commands.parser().parse_args([
        "enrich", path, "summary", "--model", "m:f", "--ledger", ledger, "--batch", "1",
        "--templates", str(tmp_path / "templates.json"), "--setups", str(tmp_path / "setups.json"),
        "--tasks", "1", "--call-size", "1"])
    commands.run(spark, args)
    assert (log / "calls").read_text() == "0.1 short, 1|" * 2
    commands.run(spark, args)
    assert (log / "calls").read_text() == "0.1 short, 1|" * 2
    args.ledger, args.new_only = None, True
    commands.run(spark, args)
    assert (log / "calls").read_text() == "0.1 short, 1|" * 2
    assert {r.summary for r in store.scan_store(spark, path).collect()} == {"1"}
    listed = commands.parser().parse_args(["list-channels", path, "--output", str(tmp_path / "l")])
    commands.run(spark, listed)
    assert [r.source for r in spark.read.json(str(tmp_path / "l")).collect()] == ["a"]


def test_only_requests_to_be_asked_move(spark, tmp_path, monkeypatch):
    written = {}

    def noted(df, label, write=ledger.materialise):
        written.setdefault(label, []).append(df.columns)
        return write(df, label)

    monkeypatch.setattr(ledger, "materialise", noted)
    rows = spark.createDataFrame([("s", i, f"text {i % 3}") for i in range(6)],
                                 "source string, batch_id long, request string")
    for _ in range(2):
        told = ledger.score_once(rows, lambda r, _: [x.upper() for x in r], str(tmp_path / "l"), "s")
        assert {(r.batch_id, r.answer) for r in told.collect()} == {
            (i, f"TEXT {i % 3}") for i in range(6)}
    assert written["asked"] == [["key"], ["key"]] and len(written["told"]) == 1
