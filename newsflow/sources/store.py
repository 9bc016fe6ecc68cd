"""The message table at rest: Parquet, partitioned by day of publication."""

import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from newsflow.operators.merge import (drop_matching, join_on_key, keep_matching, latest_per_key,
                                      sized, upsert_merge, upsert_replace)
from newsflow.schema import KEY, MESSAGE, STORED
from newsflow.scratch import temporary
from newsflow.sources import key_index

#: The partition of messages that have no date.
NO_DAY = datetime.date(1970, 1, 1)
MODES = {"merge": upsert_merge, "replace": upsert_replace}


def ensure_store(spark: SparkSession, path: str) -> None:
    """Create an empty message table unless there is one."""
    (spark.createDataFrame([], STORED).write.mode("ignore")
     .partitionBy("publish_day").parquet(path))


def scan_store(spark: SparkSession, path: str) -> DataFrame:
    """All messages, with ``publish_day`` for partition pruning."""
    return spark.read.schema(STORED).parquet(path)


def _with_day(df: DataFrame) -> DataFrame:
    return df.withColumn("publish_day",
                         F.coalesce(F.to_date("publish_date"), F.lit(NO_DAY)))


def _complete(df: DataFrame) -> DataFrame:
    """All columns of the table in order; the ones ``df`` lacks are null or empty."""
    given = {f.name: F.col(f.name) if f.name in df.columns else F.lit(None)
             for f in MESSAGE.fields}
    typed = {f.name: given[f.name].cast(f.dataType) for f in MESSAGE.fields}
    typed["named_entities"] = F.coalesce(typed["named_entities"], F.array().cast("array<string>"))
    return _with_day(df.select(*[column.alias(name) for name, column in typed.items()]))


def _spread(df: DataFrame, key_cols) -> DataFrame:
    """Few days per task, and a day with many messages over several tasks."""
    return df.repartitionByRange("publish_day", *key_cols)


def _days(df: DataFrame) -> set:
    """Distinct days: one small value per partition directory of the table."""
    return {row[0] for row in df.select("publish_day").distinct().collect()}


def write_messages(spark: SparkSession, path: str, new: DataFrame, mode: str = "merge",
                   key_cols=KEY, order_cols=("publish_date",), fixed_dates: bool = False,
                   unique: bool = False) -> set:
    """Upsert ``new`` into the table; returns the days that its rows are and were on.

    ``merge`` overwrites the columns ``new`` has, ``replace`` the whole row.
    Messages with a new key are appended as files of their own. Only days that
    hold a stored row to be changed are rewritten. Writing the same rows again
    changes nothing, so a batch may be repeated after a failure.

    Stored keys are found by the key index, which reads only what may hold one
    of ``new``'s; keys without ``message_id`` are searched in the table itself.
    ``fixed_dates`` says that ``new`` brings each message's stored date. Then
    only its days are searched. ``unique`` says that no key occurs twice in ``new``.
    """
    ensure_store(spark, path)
    unknown = set(new.columns) - set(MESSAGE.names)
    if unknown:
        raise ValueError(f"not a column of the table: {sorted(unknown)}")
    dated = "publish_date" in new.columns
    if fixed_dates and not dated:
        raise ValueError("fixed_dates needs publish_date")
    with temporary(spark) as keep:
        increment = keep(new, "increment")
        if not unique:
            # most writes repeat no key, which the keys alone tell
            if not increment.groupBy(*key_cols).count().filter(F.col("count") > 1).isEmpty():
                increment = keep(latest_per_key(increment, key_cols, order_cols), "latest")
        located = _complete(increment).select("source", "message_id",
                                              F.col("publish_day").alias("day"))
        stored = scan_store(spark, path)
        if stored.isEmpty():
            # the index comes first: it may know more than the table, never less
            key_index.rebuild(spark, path, located)
            _append(path, increment, key_cols)
            return _days(located.withColumnRenamed("day", "publish_day"))
        if not key_index.exists(spark, path):
            build_key_index(spark, path)
        found = sized(keep(_find(spark, path, stored, increment, key_cols, fixed_dates), "found"))
        met, arriving = found.select(*key_cols).distinct().count(), increment.count()
        # all keys new or all stored: then there is nothing to part by a join
        if met == 0:
            fresh, changes = increment, increment.limit(0)
        elif met == arriving:
            fresh, changes = increment.limit(0), increment
        else:
            fresh = keep(drop_matching(increment, found, key_cols), "fresh")
            changes = keep_matching(increment, found, key_cols)
        placed = located if dated else _complete(fresh).select(
            "source", "message_id", F.col("publish_day").alias("day"))
        key_index.add(spark, path, key_index.not_indexed(
            placed, found.withColumnRenamed("publish_day", "day")))

        days = _days(found)
        if days:
            days_now = days | _days(_with_day(changes)) if dated and not fixed_dates else days
            if not dated and mode == "replace":
                days_now.add(NO_DAY)  # where rows that lose their date go
            searched = stored.filter(F.col("publish_day").isin(sorted(days_now)))
            partial = mode == "merge" and set(key_cols) == set(KEY)
            if partial and dated and not fixed_dates:
                # a feed brings much again that is stored as it is: of that no day is rewritten
                changes = keep(_differing(searched, changes), "changes")
            if partial and (fixed_dates or dated and not _moved(changes, found)):
                if not fixed_dates:
                    searched = stored.filter(F.col("publish_day").isin(sorted(_days(_with_day(changes)))))
                if not changes.isEmpty():
                    _merge_days(spark, path, searched, changes)
            else:
                _rewrite(spark, path, searched, changes, days_now, MODES[mode], key_cols, order_cols, keep)
            days = days_now
        if met < arriving:
            _append(path, fresh, key_cols)
            days |= _days(_complete(fresh))
        return days


def _differing(stored, changes) -> DataFrame:
    """The ``changes`` that are not stored as they are, by a digest of the columns they bring."""
    def digest(df):
        return F.sha2(F.to_json(F.struct(*[
            F.unix_micros(c).alias(c) if c == "publish_date" else F.col(c)
            for c in changes.columns if c not in KEY and c in df.columns])), 256).alias("_digest")

    new = _complete(changes).select(*changes.columns, digest(_complete(changes)))
    return join_on_key(new, stored.select(*KEY, digest(stored)).hint("merge"), [*KEY, "_digest"],
                       "left_anti").drop("_digest")


def _moved(changes, found) -> bool:
    """Whether a stored message is found on another day than the one that it now has."""
    own = _with_day(changes).select(*KEY, F.col("publish_day").alias("_day"))
    return not join_on_key(found.select(*KEY, "publish_day"), own).filter(
        F.col("publish_day") != F.col("_day")).isEmpty()


def _merge_days(spark, path, stored, changes) -> None:
    """Rewrite the days of ``stored`` with the columns that ``changes`` bring, where no message
    changes its day.

    Old rows and new ones meet in the very exchange that spreads the days over files. Days are
    overwritten when the last task has read and written, so nothing is staged.
    """
    day_and_key = ["publish_day", *KEY]
    brought = [c for c in changes.columns if c not in KEY]
    kept = [c for c in MESSAGE.names if c not in KEY and c not in brought]
    old = stored.select(*day_and_key, F.lit(False).alias("_new"), F.struct(*brought).alias("_brought"),
                        F.struct(*kept).alias("_kept"))
    new = _with_day(changes).select(
        *day_and_key, F.lit(True).alias("_new"),
        F.struct(*[F.col(c).cast(MESSAGE[c].dataType).alias(c) for c in brought]).alias("_brought"),
        F.lit(None).cast(old.schema["_kept"].dataType).alias("_kept"))
    merged = (old.unionByName(new).repartitionByRange(*day_and_key).groupBy(*day_and_key)
              .agg(F.max_by("_brought", "_new").alias("_brought"),
                   F.min_by("_kept", "_new").alias("_kept"))
              .select(*KEY, *[f"_brought.{c}" for c in brought], *[f"_kept.{c}" for c in kept]))
    (_complete(merged).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .option("compression", "zstd")
     .partitionBy("publish_day").parquet(path))


def build_key_index(spark: SparkSession, path: str, buckets: int | None = None) -> None:
    """Index the keys of a table anew, e.g. with more buckets, or after other writers."""
    key_index.rebuild(spark, path, scan_store(spark, path).select(
        "source", "message_id", F.col("publish_day").alias("day")), buckets)


def _find(spark, path, stored, increment, key_cols, fixed_dates) -> DataFrame:
    """Keys of ``increment`` that are stored, with their days."""
    if fixed_dates:
        days = sorted(_days(_with_day(increment)))
        searched = stored.filter(F.col("publish_day").isin(days))
    elif "message_id" in key_cols:
        return key_index.lookup(spark, path, increment, key_cols).withColumnRenamed(
            "day", "publish_day")
    else:
        searched = stored
    return keep_matching(searched.select(*{*key_cols, *KEY}, "publish_day"), increment, key_cols)


def _append(path, fresh, key_cols) -> None:
    (_spread(_complete(fresh), key_cols)
     .write.mode("append").option("compression", "zstd").partitionBy("publish_day").parquet(path))


def _rewrite(spark, path, stored, changes, days, upsert, key_cols, order_cols, keep) -> None:
    merged = upsert(stored.drop("publish_day"), changes, key_cols, order_cols)
    # a table cannot be overwritten while it is read: stage the days first
    staged = keep(_spread(_complete(merged), key_cols), "days")
    kept = _days(staged)
    (staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .option("compression", "zstd")
     .partitionBy("publish_day").parquet(path))
    # overwriting by partition leaves a day alone that all its messages have left
    for day in sorted(days - kept):
        (spark.createDataFrame([], MESSAGE).write.mode("overwrite")
         .parquet(f"{path.rstrip('/')}/publish_day={day.isoformat()}"))
