import datetime
from collections import Counter

import pytest

from newsflow.sources import day_sketches, store

SCHEMA = "message_id string, source string, publish_date timestamp, named_entities array<string>"


def day(n):
    return datetime.date(2024, 3, n)


def messages(spark, rows):
    """Rows of id, source, day of the month and entities."""
    return spark.createDataFrame(
        [(i, s, datetime.datetime(2024, 3, d, 12, tzinfo=datetime.timezone.utc), names)
         for i, s, d, names in rows], SCHEMA)


def told(df):
    return [(r.entity, r.mentions) for r in df.collect()]


def exact(rows, start, end):
    counts = Counter(e for _, _, d, names in rows if start <= d <= end for e in names or () if e)
    return sorted(counts.items(), key=lambda pair: (-pair[1], pair[0]))


def test_any_range_of_days_and_changes(spark, tmp_path):
    path, folder = str(tmp_path / "store"), str(tmp_path / "days")
    rows = [(str(i), f"s{i % 3}", 1 + i % 4, [f"E{i % 5}", "Київ", f"E{i % 7}"]) for i in range(60)]
    rows += [("none", "s0", 2, None), ("empty", "s0", 2, [])]
    day_sketches.update(spark, path, folder, store.write_messages(spark, path, messages(spark, rows)))
    for start, end in ((1, 4), (2, 3), (4, 4)):
        assert told(day_sketches.top_entities(spark, folder, 100, day(start), day(end))) == exact(
            rows, start, end)
    assert told(day_sketches.top_entities(spark, folder, 2)) == exact(rows, 1, 4)[:2]
    # a message changes, one comes on a new day, one moves and leaves its day empty
    more = [("0", "s0", 1, ["Львів"]), ("new", "s9", 5, ["Львів"])]
    for change in (more, [("new", "s9", 6, ["Львів"])]):
        days = store.write_messages(spark, path, messages(spark, change))
        for _ in range(2):  # a repeated update changes nothing
            day_sketches.update(spark, path, folder, days)
        rows = [r for r in rows if r[0] not in {c[0] for c in change}] + change
    assert told(day_sketches.top_entities(spark, folder, 100)) == exact(rows, 1, 6)
    counted = {(r.day.day, r.source): r.messages
               for r in day_sketches.count_by_day(spark, folder, day(2)).collect()}
    assert counted == Counter((d, s) for _, s, d, _ in rows if d >= 2)


def test_error_bound_of_small_sketches(spark, tmp_path):
    path, folder = str(tmp_path / "store"), str(tmp_path / "days")
    rows = [(str(i), "s", 1 + i % 5, [f"E{int(3000 / (1 + i % 977))}" for _ in range(3)] + [f"R{i}"])
            for i in range(3000)]
    store.write_messages(spark, path, messages(spark, rows))
    day_sketches.build(spark, path, folder, tracked=64)
    truth, found = dict(exact(rows, 1, 5)), day_sketches.top_entities(spark, folder, 100).collect()
    bound = found[0].bound
    assert bound < 1000 and all(abs(r.mentions - truth[r.entity]) <= bound for r in found)
    assert {e for e, n in truth.items() if n > 2 * bound} <= {r.entity for r in found}


def test_nothing(spark, tmp_path):
    path, folder = str(tmp_path / "store"), str(tmp_path / "days")
    with pytest.raises(ValueError, match="no sketches"):
        day_sketches.top_entities(spark, folder)
    store.write_messages(spark, path, messages(spark, [("1", "s", 1, None)]))
    day_sketches.build(spark, path, folder)
    assert told(day_sketches.top_entities(spark, folder)) == []
    assert told(day_sketches.top_entities(spark, folder, start=day(9))) == []
    assert day_sketches.count_by_day(spark, folder).count() == 1


def test_reports_read_no_message(spark, tmp_path):
    path, folder = str(tmp_path / "store"), str(tmp_path / "days")
    store.write_messages(spark, path, messages(spark, [("1", "s", 1, ["A"]), ("2", "s", 2, ["B"])]))
    day_sketches.build(spark, path, folder)
    asked = day_sketches.top_entities(spark, folder, start=day(2), end=day(2))
    assert all("/sketches/" in file for file in asked.inputFiles())
    plan = asked._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(publish_day" in plan and "named_entities" not in plan
    assert told(asked) == [("B", 1)]
