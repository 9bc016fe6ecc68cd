"""Structured Streaming jobs: ingest, deduplication, daily counts, periodic enrichment."""

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from newsflow.operators.merge import drop_matching, latest_per_key, sized
from newsflow.operators.select import non_empty_text, to_body, unprocessed
from newsflow.plans.enrich import keep_stored, message_columns
from newsflow.schema import KEY
from newsflow.scratch import drop, matching, materialise, scoped, temporary
from newsflow.sources import key_index, word_index
from newsflow.sources.store import scan_store, write_messages

# How often the enrichment job looks for work when it runs on.
IDLE = "1 hour"
TOTALS = "day date, source string, messages long"
#: Tables of counts that a histogram may consist of.
MERGE_EVERY = 20


def _start(writer, checkpoint: str, interval: str | None) -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval
            else writer.trigger(availableNow=True)).start()


def stream_ingest(feed: DataFrame, store: str, checkpoint: str, interval: str | None = None,
                  mode: str = "merge", key_cols=KEY,
                  fixed_dates: bool = False, words: str | None = None) -> StreamingQuery:
    """Write a feed's messages to the table, batch by batch; with ``words``, keep that word index
    of the table up to date as well.

    Runs until the feed is read up, or on and on with an ``interval``. A batch
    that is delivered twice changes nothing the second time. ``fixed_dates``
    promises that a message never comes again with another date; then only the
    days of a batch are searched for its keys.
    """
    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        days = write_messages(spark, store, batch, mode, key_cols, fixed_dates=fixed_dates)
        if words:
            # a batch that is run again changes no row, so all of its days are brought up to date
            word_index.update(spark, store, words, days)

    messages = feed.transform(non_empty_text).transform(to_body)
    return _start(messages.writeStream.foreachBatch(write), checkpoint, interval)


def stream_dedup(messages: DataFrame, folder: str, checkpoint: str,
                 interval: str | None = None) -> StreamingQuery:
    """Keep each key's first message in ``folder``, however late repeats come.

    What was seen is known to a key index in the folder, not to the state of the
    query: history arrives newest first, so no watermark could tell what is late,
    and the index may grow as the table does. A batch reads the buckets that may
    hold one of its keys. Of repeats within a batch the latest stays.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        out = f"{folder}/batch={batch_id}"
        if batch_id not in _finished(spark, folder, "batch"):
            with temporary(spark) as keep:
                once = keep(latest_per_key(batch), "once")
                if key_index.exists(spark, folder):
                    seen = sized(keep(key_index.lookup(spark, folder, once), "seen"))
                    once = drop_matching(once, seen, KEY)
                once.write.mode("overwrite").parquet(out)
        # the index follows the messages: a batch that is run again finds them written
        seen = spark.read.schema(batch.schema).parquet(out).select(
            *KEY, F.to_date("publish_date").alias("day"))
        update = key_index.add if key_index.exists(spark, folder) else key_index.rebuild
        update(spark, folder, seen)

    return _start(messages.writeStream.foreachBatch(write), checkpoint, interval)


def read_once(spark: SparkSession, folder: str, schema) -> DataFrame:
    """The messages that :func:`stream_dedup` kept."""
    batches = _finished(spark, folder, "batch")
    if not batches:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{folder}/batch={n}" for n in batches])


def stream_histogram(messages: DataFrame, folder: str, checkpoint: str,
                     interval: str | None = None, merge_every: int = MERGE_EVERY) -> StreamingQuery:
    """Messages per day and source, kept current in ``folder``, whatever order they come in.

    Each batch adds its own counts as a small table, and readers add the tables
    up: no state, no watermark, and a late message counts on its day. Now and
    then the tables become one.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        counts = (batch.groupBy(F.to_date("publish_date").alias("day"), "source")
                  .agg(F.count(F.lit(1)).alias("messages")))
        # a repeated batch overwrites its own counts
        counts.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")
        parts = _parts(spark, folder)
        if len(parts) > merge_every:
            read_histogram(spark, folder).write.mode("overwrite").parquet(
                f"{folder}/merged={batch_id}")
            # readers leave alone what is merged, whether it is deleted yet or not
            for path in parts:
                drop(spark, path)

    return _start(messages.writeStream.foreachBatch(write), checkpoint, interval)


def _finished(spark: SparkSession, folder: str, name: str) -> list[int]:
    """Numbers of the subfolders ``name=...`` that are complete."""
    found = matching(spark, f"{folder}/{name}=*/_SUCCESS")
    return sorted(int(path.rsplit("/", 2)[1].split("=")[1]) for path in found)


def _parts(spark: SparkSession, folder: str) -> list[str]:
    """The last merged counts and those of the batches after them."""
    merged = _finished(spark, folder, "merged")[-1:]
    return [f"{folder}/merged={n}" for n in merged] + [
        f"{folder}/batch={n}" for n in _finished(spark, folder, "batch")
        if not merged or n > merged[0]]


def read_histogram(spark: SparkSession, folder: str) -> DataFrame:
    """The total of each day and source."""
    parts = _parts(spark, folder)
    if not parts:
        return spark.createDataFrame([], TOTALS)
    return (spark.read.schema(TOTALS).parquet(*parts)
            .groupBy("day", "source").agg(F.sum("messages").alias("messages")))


def _enrich_round(spark, store, enrich, limit, fields, tried) -> DataFrame | None:
    """Enrich unprocessed messages whose keys are not in ``tried``; their keys, if there are any."""
    messages = scan_store(spark, store).drop("publish_day")
    if tried is not None:
        messages = drop_matching(messages, tried, KEY)
    waiting = unprocessed(messages, limit, fields)
    if limit is not None:
        waiting = materialise(waiting, "waiting")
    keys = materialise(waiting.select(*KEY), "keys")  # the table tells them until it is written
    if keys.isEmpty():
        return None
    done = message_columns(keep_stored(enrich(waiting), waiting, first=True))
    write_messages(spark, store, done.drop("initial_text"), fixed_dates=True, unique=True)
    return keys


def enrich_incremental(spark: SparkSession, store: str, enrich, limit: int | None = None,
                       fields=("cleared_text",)) -> int:
    """Enrich the messages that lack one of ``fields`` and merge the result; returns how many.

    ``enrich`` takes messages and returns keys, ``publish_date`` and new
    columns. What it failed on stays unprocessed, and what a message has already
    is kept; both hold for each field by itself.
    """
    with scoped(spark):
        done = _enrich_round(spark, store, enrich, limit, fields, None)
        return 0 if done is None else done.count()


def enrich_backlog(spark: SparkSession, store: str, enrich, limit: int | None = None,
                   fields=("cleared_text",)) -> None:
    """Work through all unprocessed messages, ``limit`` at a time, each of them once.

    Every round is stored before the next begins, so a long backlog survives the
    loss of the job. Messages that fail wait for the next call and hold up none.
    What a round leaves in the scratch folder, but its keys, goes with it.
    """
    with temporary(spark) as keep:
        tried = None
        while True:
            with scoped(spark):
                keys = _enrich_round(spark, store, enrich, limit, fields, tried)
                if keys is None or limit is None:
                    break
                tried = keep(keys if tried is None else tried.unionAll(keys), "tried")


def enrich_forever(spark: SparkSession, store: str, enrich, checkpoint: str,
                   interval: str = IDLE, limit: int | None = None,
                   fields=("cleared_text",)) -> StreamingQuery:
    """Run :func:`enrich_backlog` at every ``interval`` until the query is stopped."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()

    def run(batch: DataFrame, _: int) -> None:
        enrich_backlog(batch.sparkSession, store, enrich, limit, fields)

    return _start(ticks.writeStream.foreachBatch(run), checkpoint, interval)
