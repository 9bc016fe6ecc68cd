"""Projections, filters and bounded reads of the message table."""

import datetime
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from newsflow.functions.text import clean_text_spaced, parse_ts
from newsflow.operators.merge import keep_matching
from newsflow.schema import JSONL, KEY, MESSAGE

#: A channel list longer than this is joined by shuffle instead of broadcast.
BROADCAST_CHANNELS = 100_000


def non_empty_text(feed: DataFrame) -> DataFrame:
    """Keep records with text in either form; ``message_text`` is the first that has any."""
    text, message = F.coalesce("text", F.lit("")), F.coalesce("message", F.lit(""))
    return (feed.filter((text != "") | (message != ""))
            .withColumn("message_text", F.when(text != "", text).otherwise(message)))


def to_body(records: DataFrame) -> DataFrame:
    """Feed records as message rows: typed id, cleaned channel title, raw text."""
    return records.select(
        F.col("message_id").cast("string").alias("message_id"), "publish_date",
        clean_text_spaced(F.col("source")).alias("source"),
        F.col("message_text").alias("initial_text"))


def by_source(messages: DataFrame, source: str) -> DataFrame:
    return messages.filter(F.col("source") == source)


def by_date_range(messages: DataFrame, start: datetime.date, end: datetime.date) -> DataFrame:
    """Messages from ``start`` to ``end``, the whole of both days included."""
    after = end + datetime.timedelta(days=1)
    kept = messages.filter((F.col("publish_date") >= F.lit(start).cast("timestamp"))
                           & (F.col("publish_date") < F.lit(after).cast("timestamp")))
    if "publish_day" in messages.columns:
        kept = kept.filter(F.col("publish_day").between(F.lit(start), F.lit(end)))
    return kept


def backfill(messages: DataFrame, now: datetime.datetime, days_depth: int = 30) -> DataFrame:
    """Messages since midnight UTC ``days_depth`` days before ``now``, cutoff included."""
    if now.tzinfo is not None:
        now = now.astimezone(datetime.timezone.utc)
    cutoff = now.date() - datetime.timedelta(days=days_depth)
    kept = messages.filter(F.col("publish_date") >= F.lit(cutoff).cast("timestamp"))
    if "publish_day" in messages.columns:
        kept = kept.filter(F.col("publish_day") >= F.lit(cutoff))
    return kept


def newest_first(messages: DataFrame, now: datetime.datetime, days_depth: int = 30) -> DataFrame:
    """The backfill, newest message first."""
    return backfill(messages, now, days_depth).orderBy(
        F.desc("publish_date"), *[F.desc(c) for c in KEY])


def is_unprocessed(fields=("cleared_text",)) -> Column:
    """True if one of ``fields`` is still to come. For texts null and empty both mean that."""
    missing = F.lit(False)
    for field in fields:
        missing = missing | (F.col(field).isNull()
                             if field.startswith("embedding") or field == "named_entities"
                             else F.coalesce(field, F.lit("")) == "")
    return missing


def unprocessed(messages: DataFrame, limit: int | None = None,
                fields=("cleared_text",)) -> DataFrame:
    """Messages that lack one of ``fields``; with a ``limit`` the oldest so many of them."""
    waiting = messages.filter(is_unprocessed(fields))
    return waiting if limit is None else limit_chunk(waiting, limit)


def limit_chunk(messages: DataFrame, limit: int) -> DataFrame:
    """The ``limit`` oldest messages.

    Only keys are brought together to be picked; the rows that carry texts and
    vectors join them. Of rows with one key and date, all or none are taken.
    """
    picked = (messages.select("publish_date", *KEY).orderBy("publish_date", *KEY).limit(limit)
              .distinct())
    return keep_matching(messages, picked, ("publish_date", *KEY))


def skip_processed(messages: DataFrame, reprocess: bool = False,
                   fields=("cleared_text",)) -> DataFrame:
    return messages if reprocess else messages.filter(is_unprocessed(fields))


def channel_table(spark: SparkSession, channels: Mapping[str, Sequence[int]]) -> DataFrame:
    """The monitoring map ``{worker: [channel, ...]}`` as rows ``(worker_id, channel_id)``."""
    schema = T.StructType([T.StructField("worker_id", T.StringType()),
                           T.StructField("channels", T.ArrayType(T.LongType()))])
    rows = [(str(worker), [int(c) for c in listed]) for worker, listed in channels.items()]
    return (spark.createDataFrame(rows, schema)
            .select("worker_id", F.explode("channels").alias("channel_id")))


def monitored(messages: DataFrame, channels: Mapping[str, Sequence[int]]) -> DataFrame:
    """Messages of the configured channels."""
    table = channel_table(messages.sparkSession, channels).select("channel_id")
    if sum(len(listed) for listed in channels.values()) <= BROADCAST_CHANNELS:
        table = F.broadcast(table)
    return messages.join(table, "channel_id", "left_semi")


def from_stored(documents: DataFrame, id_col: str = "_id", body_col: str = "_source") -> DataFrame:
    """Stored JSON documents as typed message rows."""
    body = F.from_json(F.col(body_col), JSONL)
    parsed = documents.select(F.col(id_col).cast("string").alias("message_id"), body.alias("b"))
    return parsed.select("message_id", parse_ts(F.col("b.publish_date")).alias("publish_date"), *[
        F.coalesce("b.named_entities", F.array().cast("array<string>")).alias(f.name)
        if f.name == "named_entities" else F.col("b")[f.name].alias(f.name)
        for f in MESSAGE.fields if f.name not in ("message_id", "publish_date")])


def training_columns(messages: DataFrame) -> DataFrame:
    """Text, label and vector, the frame a classifier is trained on."""
    return messages.select("cleared_text", "tonality", "embedding_clf")
