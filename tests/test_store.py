import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from newsflow.operators import merge, select
from newsflow.schema import KEY
from newsflow.scratch import matching
from newsflow.sources import jsonl, store


def at(day, hour=0):
    return datetime.datetime(2024, 1, day, hour, tzinfo=datetime.timezone.utc)


RAW = "source string, message_id string, publish_date timestamp, initial_text string"


def raw(spark, *rows):
    return spark.createDataFrame(list(rows), RAW)


def content(spark, path):
    rows = store.scan_store(spark, path).select(*KEY, "initial_text", "cleared_text",
                                                F.dayofmonth("publish_day").alias("day")).collect()
    result = {(r.source, r.message_id): (r.initial_text, r.cleared_text, r.day) for r in rows}
    assert len(result) == len(rows)
    return result


@pytest.fixture
def path(tmp_path):
    return str(tmp_path / "store")


def test_ensure_store_creates_once(spark, path):
    store.ensure_store(spark, path)
    assert store.scan_store(spark, path).count() == 0
    store.write_messages(spark, path, raw(spark, ("a", "1", at(1), "x")))
    store.ensure_store(spark, path)
    assert store.scan_store(spark, path).count() == 1


@pytest.mark.parametrize("fixed_dates", [False, True])
def test_merge_keeps_enrichment_and_is_idempotent(spark, path, fixed_dates):
    store.write_messages(spark, path, raw(spark, ("a", "1", at(1), "x"), ("a", "2", at(2), "y"),
                                          ("b", "1", at(1, 5), "z")))
    enriched = spark.createDataFrame([("a", "1", at(1), "ясно")],
                                     "source string, message_id string, publish_date timestamp, "
                                     "cleared_text string")
    store.write_messages(spark, path, enriched, fixed_dates=fixed_dates)
    again = raw(spark, ("a", "1", at(1), "x2"), ("a", "3", at(2), "new"), ("c", "1", at(9), "far"))
    for _ in range(2):
        store.write_messages(spark, path, again, fixed_dates=fixed_dates)
        assert content(spark, path) == {
            ("a", "1"): ("x2", "ясно", 1), ("a", "2"): ("y", None, 2), ("b", "1"): ("z", None, 1),
            ("a", "3"): ("new", None, 2), ("c", "1"): ("far", None, 9)}


def test_replace_erases_enrichment(spark, path):
    store.write_messages(spark, path, raw(spark, ("a", "1", at(1), "x")).withColumn(
        "cleared_text", F.lit("ясно")))
    store.write_messages(spark, path, raw(spark, ("a", "1", at(1), "x2")), mode="replace")
    assert content(spark, path) == {("a", "1"): ("x2", None, 1)}


def test_a_message_may_move_to_another_day(spark, path):
    store.write_messages(spark, path, raw(spark, ("a", "1", at(1), "x"), ("a", "2", at(2), "y"),
                                          ("a", "3", at(3), "z")))
    store.write_messages(spark, path, raw(spark, ("a", "1", at(3), "moved")))
    assert content(spark, path) == {("a", "1"): ("moved", None, 3), ("a", "2"): ("y", None, 2),
                                    ("a", "3"): ("z", None, 3)}


def test_only_touched_days_are_rewritten(spark, path, tmp_path):
    store.write_messages(spark, path, raw(spark, ("a", "1", at(1), "x"), ("a", "2", at(2), "y")))
    files = {p for p in (tmp_path / "store").glob("publish_day=*/*.parquet")}
    store.write_messages(spark, path, raw(spark, ("a", "1", at(1), "x2"), ("a", "9", at(2), "w")))
    kept = {p for p in (tmp_path / "store").glob("publish_day=*/*.parquet")} & files
    assert kept and all("2024-01-02" in str(p) for p in kept)


def test_messages_without_a_date_or_source(spark, path):
    rows = [(None, "1", None, "x")]
    for _ in range(2):
        store.write_messages(spark, path, spark.createDataFrame(rows, RAW))
    assert content(spark, path) == {(None, "1"): ("x", None, 1)}


def test_global_key(spark, path):
    store.write_messages(spark, path, raw(spark, ("a", "1", at(1), "x")), key_cols=("message_id",))
    store.write_messages(spark, path, raw(spark, ("b", "1", at(1), "y")), key_cols=("message_id",))
    assert content(spark, path) == {("b", "1"): ("y", None, 1)}


def test_random_writes_agree_with_a_dictionary(spark, path):
    """Merges and replacements of random rows, dates moving, against plain Python."""
    rng = random.Random(5)
    model = {}
    for step in range(5):
        mode = "replace" if step == 3 else "merge"
        fields = ["publish_date", "initial_text", "summary"] if step % 2 == 0 else [
            "publish_date", "summary"]
        batch = {}
        for _ in range(12):
            key = (rng.choice(["a", "b", None]), str(rng.randrange(6)))
            row = {"publish_date": rng.choice([at(1), at(2), at(3), None]),
                   "initial_text": rng.choice(["x", "y", None]), "summary": rng.choice(["s", None])}
            batch[key] = {f: row[f] for f in fields}
        for key, row in batch.items():
            old = model.get(key, {}) if mode == "merge" else {}
            model[key] = {**old, **row}
        types = {"publish_date": "timestamp", "initial_text": "string", "summary": "string"}
        frame = spark.createDataFrame(
            [(*key, *row.values()) for key, row in batch.items()],
            "source string, message_id string, " + ", ".join(f"{f} {types[f]}" for f in fields))
        store.write_messages(spark, path, frame, mode)
        rows = store.scan_store(spark, path).collect()
        got = {(r.source, r.message_id): (r.publish_date, r.initial_text, r.summary) for r in rows}
        assert len(got) == len(rows)
        assert got == {k: tuple(
            v.get(f).replace(tzinfo=None) if f == "publish_date" and v.get(f) else v.get(f)
            for f in types) for k, v in model.items()}
        assert all(r.publish_day == (r.publish_date.date() if r.publish_date else store.NO_DAY)
                   for r in rows)


def test_unknown_columns_are_refused(spark, path):
    with pytest.raises(ValueError):
        store.write_messages(spark, path, raw(spark).withColumn("mood", F.lit(1)))


def test_day_filters_reach_the_partitions(spark, path):
    store.write_messages(spark, path, raw(spark, ("a", "1", at(1), "x"), ("a", "2", at(2), "y")))
    chosen = select.by_date_range(store.scan_store(spark, path), datetime.date(2024, 1, 2),
                                  datetime.date(2024, 1, 2))
    assert [r.message_id for r in chosen.collect()] == ["2"]
    plan = chosen._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(publish_day" in plan


def test_upsert_distinguishes_absent_from_null(spark):
    old = spark.createDataFrame([("a", "1", "x", "c"), ("a", "2", "y", "d")],
                                "source string, message_id string, initial_text string, "
                                "cleared_text string")
    absent = spark.createDataFrame([("a", "1", "x2")],
                                   "source string, message_id string, initial_text string")
    null = spark.createDataFrame([("a", "1", None)],
                                 "source string, message_id string, cleared_text string")
    rows = {tuple(r) for r in merge.upsert_merge(old, absent).collect()}
    assert rows == {("a", "1", "x2", "c"), ("a", "2", "y", "d")}
    rows = {tuple(r) for r in merge.upsert_merge(old, null).collect()}
    assert rows == {("a", "1", "x", None), ("a", "2", "y", "d")}


def test_latest_per_key_takes_one_whole_row(spark):
    rows = raw(spark, ("a", "1", at(1), "z"), ("a", "1", at(2), "b"), ("a", "1", at(2), "c"),
               ("b", "1", None, "n"))
    got = {tuple(r)[:2]: (r.publish_date and r.publish_date.day, r.initial_text)
           for r in merge.latest_per_key(rows).collect()}
    assert got == {("a", "1"): (2, "c"), ("b", "1"): (None, "n")}


def test_dedup_aggregates_before_the_shuffle(spark):
    copies = spark.range(50_000).select(
        F.lit("a").alias("source"), F.col("id").cast("string").alias("message_id"),
        F.timestamp_seconds("id").alias("publish_date"), F.lit("copy").alias("initial_text"))
    once = merge.dedup_exact(copies)
    assert [r.message_id for r in once.collect()] == ["49999"]
    plan = once._jdf.queryExecution().executedPlan().toString()
    assert "partial_max" in plan


LINES = [
    {"publish_date": "2024-03-23T12:40:27+00:00", "source": "Вечірні вісті",
     "text": "Сніг уночі... Ні???"},
    {"publish_date": "2024-03-23T12:40:27+02:00", "source": "b", "text": "**а**\n\n-б-"},
    {"publish_date": "2024-03-23T12:40:27+00:00", "source": "c", "text": ""},
    {"publish_date": "2024-03-23T12:40:27+00:00", "source": "d", "text": None},
    {"publish_date": "2024-03-23T12:40:27", "source": "e", "text": "без поясу"},
]


def test_jsonl_import(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text(
        "\n".join(json.dumps(line, ensure_ascii=False) for line in LINES) + "\nnot json\n",
        encoding="utf-8")
    (tmp_path / "b.txt").write_text(json.dumps(LINES[0]))
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "c.jsonl").write_text(json.dumps(LINES[0]))
    lines = jsonl.scan_jsonl(spark, str(tmp_path)).cache()
    rows = {r.source: r for r in jsonl.parse_message(lines).collect()}
    assert set(rows) == {"Вечірні вісті", "b"}
    assert rows["Вечірні вісті"].message_id == "7422c23eee00a10b1035abc04729cdd8"
    assert rows["Вечірні вісті"].initial_text == "Сніг уночі... Ні???"
    assert rows["b"].initial_text == "а б"
    assert rows["b"].named_entities == [] and rows["b"].cleared_text is None
    bad = jsonl.rejected(lines).collect()
    assert {(r.source, r._corrupt) for r in bad} == {("e", None), (None, "not json")}


def test_dump_and_load_round_trip(spark, tmp_path, path):
    store.write_messages(spark, path, raw(
        spark, ("канал/1", "1", at(1), "перший"), ("канал/1", "2", at(2), "другий"),
        (None, "3", at(2), "третій"), ("b", "4", at(3), "четвертий")).withColumn(
        "named_entities", F.array(F.lit("Київ"))).withColumn("summary", F.lit("так")))
    folder = tmp_path / "dump"
    folder.mkdir()
    (folder / "old.json").write_text("{}")
    stored = store.scan_store(spark, path).drop("publish_day")
    jsonl.dump_by_source(stored, str(folder))
    assert {p.name for p in folder.iterdir() if p.is_dir()} == {
        "source_file=канал_1", "source_file=unknown", "source_file=b"}
    loaded = jsonl.parse_message(jsonl.scan_dump(spark, str(folder)))
    assert loaded.schema.names == stored.schema.names
    assert {str(r) for r in loaded.collect()} == {str(r) for r in stored.collect()}
    jsonl.dump_by_source(stored, str(folder), source="b")
    assert {p.name for p in folder.iterdir() if p.is_dir()} == {"source_file=b"}
    only = jsonl.scan_dump(spark, str(folder))
    assert [(r.source, r.message_id, r.initial_text) for r in only.collect()] == [
        ("b", "4", "четвертий")]


def test_days_are_merged_in_one_exchange_where_no_message_moves(spark, path, monkeypatch):
    store.write_messages(spark, path, raw(spark, *[("a", str(i), at(1 + i % 3), f"t{i}") for i in range(9)]))

    def staged(*_):
        raise AssertionError("days are staged")

    monkeypatch.setattr(store, "_rewrite", staged)
    done = spark.createDataFrame([("a", str(i), at(1 + i % 3), f"c{i}") for i in range(4)],
                                 "source string, message_id string, publish_date timestamp, cleared_text string")
    store.write_messages(spark, path, done, fixed_dates=True, unique=True)
    got = content(spark, path)
    assert {k[1]: v for k, v in got.items()} == {
        str(i): (f"t{i}", f"c{i}" if i < 4 else None, 1 + i % 3) for i in range(9)}


def test_a_repeat_that_is_stored_as_it_is_rewrites_no_day(spark, path):
    rows = [("a", str(i), at(1 + i % 2), f"t{i}") for i in range(4)] + [("a", "n", None, None)]
    store.write_messages(spark, path, raw(spark, *rows))

    def files():
        return {day: set(matching(spark, f"{path}/publish_day={day}/*.parquet"))
                for day in ("2024-01-01", "2024-01-02", "1970-01-01")}

    first = files()
    days = store.write_messages(spark, path, raw(spark, *rows, rows[0], ("a", "9", at(3), "new")))
    assert {day.day for day in days} == {1, 2, 3} and files() == first
    store.write_messages(spark, path, raw(spark, *rows[:3], ("a", "3", at(2), "edited")))
    assert files()["2024-01-01"] == first["2024-01-01"] and files()["2024-01-02"] != first["2024-01-02"]
    got = content(spark, path)
    assert got["a", "3"][0] == "edited" and len(got) == 6
