import json
import os

import pytest
from pyspark.sql import functions as F

from newsflow import __main__ as command
from newsflow.plans import jobs
from newsflow.scratch import drop_scratch, materialise
from newsflow.sources import jsonl, store

LINES = {
    "a.jsonl": [("2024-01-01T10:00:00+00:00", "канал А", "Добре. Міста Київ та Львів святкують! Далі."),
                ("2024-01-02T10:00:00+00:00", "канал А", "Однаковий текст")],
    "b.jsonl": [("2024-01-03T10:00:00+00:00", "канал Б", "Однаковий текст"),
                ("2024-01-03T11:00:00+00:00", "канал Б", "погано #тег")],
}
LEXICON = "word,value,weight\nдобре,позитивна,2\nпогано,негативна,2\nкиїв,політика,1\n"


@pytest.fixture
def paths(tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for name, rows in LINES.items():
        (folder / name).write_text("\n".join(json.dumps(
            dict(zip(("publish_date", "source", "text"), row)), ensure_ascii=False)
            for row in rows), encoding="utf-8")
    (tmp_path / "words.csv").write_text(LEXICON, encoding="utf-8")
    return {n: str(tmp_path / n) for n in ("in", "store", "dump", "words.csv", "check")}


def run(spark, *args):
    command.run(spark, command.parser().parse_args(list(args)))


def rows(spark, paths):
    return {r.initial_text[:5]: r for r in store.scan_store(spark, paths["store"]).collect()}


def test_load_enrich_dump(spark, paths, capsys):
    run(spark, "load-data", paths["store"], paths["in"])
    loaded = rows(spark, paths)
    assert len(loaded) == 3
    assert loaded["Однак"].source == "канал Б"   # the later one of two equal texts
    run(spark, "load-data", paths["store"], paths["in"])
    assert len(rows(spark, paths)) == 3

    words = ["--tonality-lexicon", paths["words.csv"], "--category-lexicon", paths["words.csv"]]
    run(spark, "enrich", paths["store"], "tonality", "--source", "канал А", *words)
    got = rows(spark, paths)
    assert got["Добре"].tonality == "позитивна" and got["поган"].tonality is None
    run(spark, "enrich", paths["store"], "all", *words)
    got = rows(spark, paths)
    assert got["поган"].tonality == "негативна" and got["Добре"].category == "політика"
    assert got["поган"].cleared_text == "погано тег"
    assert got["Добре"].named_entities == ["Київ", "Львів"]
    assert got["Добре"].summary == "добре. міста київ та львів святкують!"
    assert len(got["Добре"].embedding_clf) == 768
    with pytest.raises(SystemExit):
        run(spark, "enrich", paths["store"], "tonality")

    run(spark, "dump", paths["store"], paths["dump"])
    assert sorted(n for n in os.listdir(paths["dump"]) if "=" in n) == [
        "source_file=канал А", "source_file=канал Б"]
    again = paths["store"] + "2"
    jobs.load_files(spark, paths["dump"], again, "*.json", recursive=True)
    assert {str(r) for r in store.scan_store(spark, again).collect()} == \
        {str(r) for r in store.scan_store(spark, paths["store"]).collect()}
    run(spark, "list-channels", paths["store"])
    assert capsys.readouterr().out.split("\n")[:2] == ["канал Б", "канал А"]


def test_read_command(spark, paths, tmp_path):
    feed = tmp_path / "feed"
    feed.mkdir()
    (feed / "1.json").write_text("\n".join(json.dumps(
        {"message_id": i, "channel_id": c, "publish_date": "2024-01-01T10:00:00Z",
         "source": f"c{c}", "text": "t", "message": ""}) for i, c in ((1, 5), (2, 6))))
    (tmp_path / "channels.json").write_text('{"1": [5]}')
    run(spark, "read", paths["store"], str(feed), paths["check"],
        "--channels", str(tmp_path / "channels.json"))
    assert [(r.source, r.message_id) for r in store.scan_store(spark, paths["store"]).collect()] \
        == [("c5", "1")]


def test_model_steps_report_failures(spark, paths):
    jobs.load_files(spark, paths["in"], paths["store"])

    def answer(requests, setup):
        if any("погано" in r for r in requests):
            raise RuntimeError("down")
        return ["Текст #1: Спорт" for _ in requests]

    failed = jobs.run_model_steps(spark, paths["store"], {"category": answer})
    assert {r.category_error for r in failed.collect()} == {"RuntimeError: down"}
    assert {r.category for r in rows(spark, paths).values()} == {"спорт", None}


def test_scratch_is_shared_and_can_be_dropped(spark):
    table = materialise(spark.range(5), "numbers")
    folder = table.inputFiles()[0].removeprefix("file://").rsplit("/", 2)[0]
    root = spark.conf.get("spark.checkpoint.dir", None)
    assert root is None or folder.startswith(root.removeprefix("file:"))
    assert table.count() == 5 and os.path.isdir(folder)
    drop_scratch(spark)
    assert not os.path.isdir(folder)


def test_a_cluster_needs_a_shared_folder():
    from newsflow.scratch import scratch_path

    class Session:
        class conf:
            get = staticmethod(lambda key, default=None: {"spark.master": "yarn"}.get(key, default))
    with pytest.raises(ValueError):
        scratch_path(Session, "x")


def test_a_local_warehouse_serves_one_machine_only():
    from newsflow.scratch import scratch_path

    def session(**conf):
        class Session:
            class conf_:
                get = staticmethod(lambda key, default=None: conf.get(key[6:].replace(".", "_"),
                                                                      default))
        Session.conf = Session.conf_
        return Session
    for warehouse in ("file:/work/warehouse", "/work/warehouse"):
        with pytest.raises(ValueError):
            scratch_path(session(master="yarn", sql_warehouse_dir=warehouse), "x")
        assert scratch_path(session(master="local[4]", sql_warehouse_dir=warehouse), "x")
    assert scratch_path(session(master="yarn", sql_warehouse_dir="hdfs://n/w"), "x")
    assert scratch_path(session(master="yarn", checkpoint_dir="hdfs://n/c"), "x")


def test_scoped_scratch_goes_with_its_block(spark):
    from newsflow.scratch import scoped
    with scoped(spark):
        inner = materialise(spark.range(3), "inner")
        files = [f.removeprefix("file://") for f in inner.inputFiles()]
        assert all(os.path.exists(f) for f in files)
    assert not any(os.path.exists(f) for f in files)
    outer = materialise(spark.range(3), "outer")
    assert outer.count() == 3


def test_each_file_is_read_once(spark, tmp_path):
    folder = tmp_path / "import"
    folder.mkdir()
    lines = [{"publish_date": "2023-05-06T07:08:09+00:00", "source": "s", "text": f"t{i}"}
             for i in range(20)] + [{"message_id": "k", "source": "s", "initial_text": "так"}]
    (folder / "a.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\nno json\n")
    reads = []
    scan = jsonl.scan_jsonl

    def counted(*args, **kwargs):
        seen = spark.sparkContext.accumulator(0)
        reads.append(seen)

        def count(rows):
            for row in rows:
                seen.add(len(row))
                yield row
        found = scan(*args, **kwargs)
        return found.mapInPandas(count, found.schema)
    jobs.jsonl.scan_jsonl = counted
    try:
        assert jobs.load_files(spark, str(folder), str(tmp_path / "store")) == 1
    finally:
        jobs.jsonl.scan_jsonl = scan
    assert [r.value for r in reads] == [22]
    assert store.scan_store(spark, str(tmp_path / "store")).count() == 21
