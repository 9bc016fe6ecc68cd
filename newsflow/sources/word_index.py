"""An inverted index of the message table: which messages hold a word, and how often.

Postings are dealt into buckets by a hash of the word and sorted by word. Each write adds a version:
the postings of all its days in as many files as their size asks for, whatever the number of days,
and a line of length statistics per day. Of a day the last complete version counts, so a day's
postings and statistics are replaced together when its messages change. Versions of which no day is
left are deleted, and many versions become one. A search reads the buckets of the words asked for.
"""

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from newsflow.functions.text import word_counts, words
from newsflow.operators.search import B, K1, asked_words
from newsflow.schema import KEY
from newsflow.scratch import drop, matching, temporary
from newsflow.sources.store import scan_store

#: Buckets of words per day, unless told otherwise.
BUCKETS = 16
#: Parts of a bucket at least, and postings of a part, about.
PARTS, POSTINGS_PER_PART = 4, 4_000_000
#: Versions after which an update merges them.
MOST_VERSIONS = 20
POSTING = T.StructType([
    T.StructField("word", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("message_id", T.StringType()), T.StructField("tf", T.LongType()),
    T.StructField("length", T.LongType()), T.StructField("publish_day", T.DateType()),
    T.StructField("bucket", T.IntegerType())])
LENGTHS = T.StructType([T.StructField("publish_day", T.DateType()), T.StructField("messages", T.LongType()),
                        T.StructField("words", T.LongType()), T.StructField("version", T.IntegerType())])


def _place(spark: SparkSession, index: str) -> tuple[str, int]:
    """Folder of the index and its number of buckets."""
    found = matching(spark, f"{index.rstrip('/')}/buckets=*")
    if not found:
        raise ValueError(f"no index in {index}")
    return found[-1], int(found[-1].rsplit("=", 1)[1])


def _bucket(word, buckets: int):
    return F.pmod(F.xxhash64(word), F.lit(buckets)).cast("int")


def _versions(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the complete versions: lengths are written last."""
    found = matching(spark, f"{folder}/lengths/version=*/_SUCCESS")
    return sorted(int(path.rsplit("/", 2)[1].split("=")[1]) for path in found)


def _lengths(spark: SparkSession, folder: str) -> DataFrame:
    """The statistics that count: of each day those of its last version."""
    paths = [f"{folder}/lengths/version={n}" for n in _versions(spark, folder)]
    if not paths:
        return spark.createDataFrame([], LENGTHS)
    lines = spark.read.schema(LENGTHS).option("basePath", f"{folder}/lengths").parquet(*paths)
    last = lines.groupBy("publish_day").agg(
        F.max(F.struct("version", "messages", "words")).alias("_last"))
    return last.select("publish_day", "_last.messages", "_last.words", "_last.version")


def _current(spark: SparkSession, folder: str, only=None) -> DataFrame:
    """All postings that count; ``only`` is a condition on what is read."""
    days, found = _lengths(spark, folder), []
    versions = _versions(spark, folder)
    for n in versions:
        part = spark.read.schema(POSTING).parquet(f"{folder}/postings/version={n}")
        part = part if only is None else part.filter(only)
        if n != versions[-1]:  # days of the last version are all its own
            # one line per day
            own = days.filter(F.col("version") == n).select(F.col("publish_day").alias("_day"))
            part = part.join(F.broadcast(own), F.col("publish_day") == F.col("_day"), "left_semi")
        found.append(part)
    return reduce(DataFrame.unionAll, found) if found else spark.createDataFrame([], POSTING)


def _write(dealt: DataFrame, lengths: DataFrame, folder: str, version: int, postings: int,
           buckets: int) -> None:
    """Write a version: its postings, then the lengths that make them count."""
    # a word that is everywhere is dealt, by message, into parts of its bucket
    parts = max(PARTS, -(-postings // buckets // POSTINGS_PER_PART))
    (dealt.repartition("bucket", F.pmod(F.xxhash64(*KEY), F.lit(parts)))
     .sortWithinPartitions("bucket", "word")
     .write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/postings/version={version}"))
    lengths.coalesce(1).write.mode("overwrite").parquet(f"{folder}/lengths/version={version}")


def _write_days(messages: DataFrame, folder: str, buckets: int, text_col: str, days=()) -> None:
    """Write a version of all days of ``messages``; those of ``days`` without any are empty in it."""
    spark = messages.sparkSession
    versions = _versions(spark, folder)
    with temporary(spark) as keep:
        listed = messages.filter(F.col(text_col).isNotNull()).select(
            *KEY, "publish_day", words(F.col(text_col)).alias("_words"))
        counted = keep(listed.select(*KEY, "publish_day", F.size("_words").cast("long").alias("length"),
                                     word_counts(F.col("_words")).alias("_counts")), "counted")
        none = spark.createDataFrame([(day,) for day in days], "publish_day date").select(
            "publish_day", F.lit(0).cast("long").alias("messages"), F.lit(0).cast("long").alias("words"))
        lengths = (counted.groupBy("publish_day").agg(
            F.count(F.lit(1)).alias("messages"), F.sum("length").alias("words"))
            .unionAll(none).groupBy("publish_day")
            .agg(F.sum("messages").alias("messages"), F.sum("words").alias("words")))
        dealt = counted.select(*KEY, "publish_day", "length", F.inline("_counts")).select(
            "word", *KEY, "tf", "length", "publish_day", _bucket("word", buckets).alias("bucket"))
        postings = counted.agg(F.coalesce(F.sum(F.size("_counts")), F.lit(0))).first()[0]
        _write(dealt, lengths, folder, max(versions, default=-1) + 1, postings, buckets)
    _tidy(spark, folder, buckets)


def _tidy(spark: SparkSession, folder: str, buckets: int) -> None:
    """Delete the versions of which no day is left; of too many versions make one."""
    days = _lengths(spark, folder)
    live = {row[0] for row in days.select("version").distinct().collect()}  # at most MOST_VERSIONS
    versions = _versions(spark, folder)
    if len(live) > MOST_VERSIONS:
        merged = _current(spark, folder)
        live = {versions[-1] + 1}
        _write(merged, days.drop("version"), folder, versions[-1] + 1, merged.count(), buckets)
    for n in versions:
        if n not in live:
            # its lengths first: without them the rest does not count
            for part in ("lengths", "postings"):
                drop(spark, f"{folder}/{part}/version={n}")


def build(spark: SparkSession, store: str, index: str, text_col: str = "initial_text",
          buckets: int = BUCKETS) -> None:
    """Index all messages of a table anew."""
    drop(spark, index)
    _write_days(scan_store(spark, store), f"{index.rstrip('/')}/buckets={buckets}", buckets, text_col)


def update(spark: SparkSession, store: str, index: str, days,
           text_col: str = "initial_text") -> None:
    """Bring some days up to date, as :func:`store.write_messages` returns them.

    May be repeated. A day that has no message any more leaves the index. Where there is no index
    yet, it is built.
    """
    if not matching(spark, f"{index.rstrip('/')}/buckets=*"):
        return build(spark, store, index, text_col)
    folder, buckets = _place(spark, index)
    messages = scan_store(spark, store).filter(F.col("publish_day").isin(sorted(days)))
    _write_days(messages, folder, buckets, text_col, days)


def postings(spark: SparkSession, index: str, asked: Sequence[str]) -> DataFrame:
    """Postings of some words, from their buckets alone."""
    folder, buckets = _place(spark, index)
    found = spark.createDataFrame([(word,) for word in asked], "word string") \
        .select(_bucket("word", buckets).alias("b")).distinct().collect()  # one number per word
    return _current(spark, folder, F.col("bucket").isin([row["b"] for row in found])
                    & F.col("word").isin(list(asked)))


def search(spark: SparkSession, index: str, query: str | Sequence[str], k: int = 10) -> DataFrame:
    """The ``k`` messages that match any of the words best, by BM25: what
    :func:`newsflow.operators.search.text_search` finds by reading all texts."""
    folder, _ = _place(spark, index)
    found = postings(spark, index, asked_words(query))
    totals = _lengths(spark, folder).agg(
        F.sum("messages").alias("n"), (F.sum("words") / F.sum("messages")).alias("average"))
    per_word = found.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (totals.select("n").scalar() - F.col("df") + 0.5) / (F.col("df") + 0.5))
    damped = F.col("tf") + K1 * (1 - B + B * F.col("length") / totals.select("average").scalar())
    # a row per word asked for
    return (found.join(F.broadcast(per_word.select("word", idf.alias("idf"))), "word").groupBy(*KEY)
            .agg(F.sum(F.col("idf") * F.col("tf") / damped).alias("score"))
            .orderBy(F.desc("score"), *KEY).limit(k))
