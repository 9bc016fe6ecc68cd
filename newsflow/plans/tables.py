"""The sample tables seen as messages, feed records and training rows."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from newsflow.functions.text import clean_text

EPOCH_2024 = 1704067200  # 2024-01-01 00:00:00 UTC

#: Channels under watch, by worker.
CHANNELS = {"1": [7, 8, 46], "2": [3, 21, 99]}

#: Word weights for the rules; the words are common ones of the sample texts.
TONALITY_WORDS = [
    ("with", "позитивна", 2), ("des", "позитивна", 1), ("para", "позитивна", 2),
    ("was", "негативна", 2), ("nicht", "негативна", 3), ("pas", "негативна", 3),
    ("is", "нейтральна", 1), ("und", "нейтральна", 1), ("et", "нейтральна", 1),
    ("the", "об'єктивна", 1), ("der", "об'єктивна", 1), ("el", "об'єктивна", 1),
    ("that", "емоційна", 2), ("la", "емоційна", 1), ("sich", "емоційна", 2),
    ("are", "загрозлива", 3), ("auf", "загрозлива", 3), ("dans", "загрозлива", 3),
]
CATEGORY_WORDS = [
    ("of", "політика", 1), ("die", "політика", 1), ("de", "економіка", 1),
    ("to", "економіка", 2), ("das", "соціальні питання", 2), ("for", "наука і технології", 3),
    ("le", "культура і мистецтво", 1), ("los", "спорт", 1), ("on", "міжнародні події", 2),
    ("que", "міжнародні події", 2), ("mit", "освіта", 3), ("by", "здоров'я і медицина", 3),
    ("at", "природні катастрофи та надзвичайні ситуації", 4),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as unprocessed messages, one per minute."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("message_id"),
        F.timestamp_seconds(F.lit(EPOCH_2024) + F.col("doc_id") * 60).alias("publish_date"),
        "source", F.col("text").alias("initial_text"))


def part_processed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, where the messages that ``labels`` covers already have their cleaned text."""
    labels = table(spark, sf_dir, "labels").select(
        F.col("doc_id").cast("string").alias("message_id"), F.lit(True).alias("_labelled"))
    return (text_messages(spark, sf_dir).join(labels, "message_id", "left")
            .withColumn("cleared_text",
                        F.when(F.col("_labelled"), clean_text(F.col("initial_text"))))
            .drop("_labelled"))


def text_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as feed records: by label, one text form or both may be empty."""
    labels = table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "message_id")
    return (table(spark, sf_dir, "documents")
            .select(F.col("doc_id").alias("message_id"), "source", F.col("text").alias("_t"))
            .join(labels, "message_id", "left")
            .select("message_id", "source",
                    F.when(F.col("quality") == 0, "").otherwise(F.col("_t")).alias("text"),
                    F.when(F.col("toxic") == 1, "").otherwise(F.col("_t")).alias("message")))


def event_messages(events: DataFrame) -> DataFrame:
    """``events``, read at rest or as a stream, as messages with a channel."""
    return events.select(
        F.col("event_id").cast("string").alias("message_id"),
        F.col("user_id").alias("channel_id"),
        F.col("ts").cast("timestamp").alias("publish_date"),
        F.col("event_type").alias("source"), F.col("props").alias("initial_text"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` as messages: the turn is the id, so ids repeat across sources."""
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("source"),
        F.col("turn").cast("string").alias("message_id"),
        F.timestamp_seconds(F.lit(EPOCH_2024) + F.col("turn") * 3600).alias("publish_date"),
        F.col("text").alias("initial_text"), "role")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embeddings`` as training rows."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("string").alias("message_id"),
        F.concat(F.lit("class "), F.col("label").cast("string")).alias("tonality"),
        F.col("embedding").alias("embedding_clf"))


def lexicon(spark: SparkSession, entries) -> DataFrame:
    return spark.createDataFrame(entries, "word string, value string, weight int")
