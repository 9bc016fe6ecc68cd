"""Counts and the most named entities by day, kept beside a message table.

A day has its messages per source, exactly, and a frequent-items sketch of the entities named in it, of
a bounded size whatever the day holds. Both merge: a report on any range of days adds up one small row
per day and source, and reads no message. Days are replaced one by one as the table changes.

A sketch that tracks ``n`` items knows each count to within 3.5 / n of all mentions merged into it, and
exactly while it has met ``n`` different ones at most. Beyond that it names only what is clear of that
bound: each entity with more than twice as many mentions is among them.
"""

import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from newsflow.functions.text import explode_words
from newsflow.scratch import drop, matching, temporary
from newsflow.sources.store import scan_store

#: Entities that a sketch tracks. All sketches of a folder must track the same number.
TRACKED = 10_000


def _place(spark: SparkSession, folder: str) -> tuple[str, int]:
    """Where the sketches are, and how many entities they track."""
    found = matching(spark, f"{folder.rstrip('/')}/tracked=*")
    if not found:
        raise ValueError(f"no sketches in {folder}")
    return found[-1], int(found[-1].rsplit("=", 1)[1])


def _write_days(messages: DataFrame, place: str, tracked: int, days=()) -> None:
    spark = messages.sparkSession
    with temporary(spark) as keep:
        named = explode_words(messages.select(
            "publish_day", F.col("named_entities").alias("entity")), "entity")
        # tasks sketch what they read, so what is exchanged is a sketch per task and day
        sketches = keep(named.groupBy("publish_day").agg(
            F.expr(f"approx_top_k_accumulate(entity, {int(tracked)})").alias("sketch"),
            F.count(F.lit(1)).alias("mentions"))
            .select("sketch", "mentions", "publish_day"), "sketches")
        counts = keep(messages.groupBy("publish_day", "source").agg(
            F.count(F.lit(1)).alias("messages"))
            .select("source", "messages", "publish_day"), "counts")
        # all is counted by now; what is lost between here and the end, the same call restores
        for day in days:
            for part in ("sketches", "counts"):
                drop(spark, f"{place}/{part}/publish_day={day.isoformat()}")
        for name, rows in (("sketches", sketches), ("counts", counts)):
            rows.repartition("publish_day").write.mode("append").partitionBy("publish_day") \
                .parquet(f"{place}/{name}")


def build(spark: SparkSession, store: str, folder: str, tracked: int = TRACKED) -> None:
    """Sketch all days of a table anew."""
    drop(spark, folder)
    _write_days(scan_store(spark, store), f"{folder.rstrip('/')}/tracked={tracked}", tracked)


def update(spark: SparkSession, store: str, folder: str, days, tracked: int = TRACKED) -> None:
    """Bring some days up to date, as :func:`store.write_messages` returns them.

    May be repeated. A day that has no message any more leaves. Where there are no sketches yet, all
    days are sketched, with ``tracked`` entities; else the folder's number holds.
    """
    if not matching(spark, f"{folder.rstrip('/')}/tracked=*"):
        return build(spark, store, folder, tracked)
    place, tracked = _place(spark, folder)
    changed = scan_store(spark, store).filter(F.col("publish_day").isin(sorted(days)))
    _write_days(changed, place, tracked, days)


def _range(df: DataFrame, start: datetime.date | None, end: datetime.date | None) -> DataFrame:
    if start is not None:
        df = df.filter(F.col("publish_day") >= F.lit(start))
    return df if end is None else df.filter(F.col("publish_day") <= F.lit(end))


def top_entities(spark: SparkSession, folder: str, k: int = 20,
                 start: datetime.date | None = None, end: datetime.date | None = None) -> DataFrame:
    """The ``k`` entities named most often from ``start`` to ``end``, both days included.

    ``bound`` is how far off ``mentions`` may be.
    """
    place, tracked = _place(spark, folder)
    layout = spark.createDataFrame([], "entity string").agg(
        F.expr(f"approx_top_k_accumulate(entity, {tracked})").alias("sketch")).schema
    days = _range(spark.read.schema(layout.add("mentions", "long").add("publish_day", "date"))
                  .parquet(f"{place}/sketches"), start, end)
    # grouped, as nothing cannot be combined
    merged = days.groupBy(F.lit(1).alias("_range")).agg(F.expr(f"approx_top_k_combine(sketch, {tracked})").alias("sketch"),
                      F.sum("mentions").alias("_all"))
    # all that is tracked, so that equal counts are cut by name and not by chance
    told = merged.select("_all", F.expr(f"inline(approx_top_k_estimate(sketch, {tracked}))"))
    bound = F.ceil(F.col("_all") * 3.5 / tracked)
    return (told.select(F.col("item").alias("entity"), F.col("count").alias("mentions"),
                        bound.alias("bound"))
            .orderBy(F.desc("mentions"), "entity").limit(k))


def count_by_day(spark: SparkSession, folder: str, start: datetime.date | None = None,
                 end: datetime.date | None = None) -> DataFrame:
    """Messages per day and source from ``start`` to ``end``."""
    place, _ = _place(spark, folder)
    counts = spark.read.schema("source string, messages long, publish_day date").parquet(
        f"{place}/counts")
    return _range(counts, start, end).select(F.col("publish_day").alias("day"), "source", "messages")
