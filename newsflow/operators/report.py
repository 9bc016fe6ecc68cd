"""Counts and shares over the message table."""

from pyspark.sql import DataFrame, Window, functions as F

from newsflow.functions.text import explode_words


def unique_sources(messages: DataFrame) -> DataFrame:
    """Every source, the one with most messages first."""
    return count_by_source(messages).orderBy(F.desc("messages"), "source").select("source")


def count_by_source(messages: DataFrame) -> DataFrame:
    return messages.groupBy("source").agg(F.count(F.lit(1)).alias("messages"))


def category_distribution(messages: DataFrame) -> DataFrame:
    """Messages per category and their share of all that have one."""
    counts = (messages.filter(F.col("category").isNotNull())
              .groupBy("category").agg(F.count(F.lit(1)).alias("messages")))
    # over the counts: a row per category, so the messages are read once
    total = F.sum("messages").over(Window.partitionBy(F.lit(1)))
    return counts.withColumn("share", F.col("messages") / total)


def tonality_distribution(messages: DataFrame) -> DataFrame:
    """Messages per source and tonality, with the share within the source."""
    counts = (messages.filter(F.col("tonality").isNotNull())
              .groupBy("source", "tonality").agg(F.count(F.lit(1)).alias("messages")))
    # over the counts: a source has one row per tonality here
    total = F.sum("messages").over(Window.partitionBy("source"))
    return counts.withColumn("share", F.col("messages") / total)


def tonality_pivot(messages: DataFrame, tonalities) -> DataFrame:
    """One row per source, one column per tonality."""
    return (messages.groupBy("source").pivot("tonality", list(tonalities))
            .agg(F.count(F.lit(1))).fillna(0))


def top_entities(messages: DataFrame, k: int = 20, approximate: bool = False,
                 tracked: int = 10_000) -> DataFrame:
    """The ``k`` entities named most often.

    The approximate variant keeps ``tracked`` counters instead of one per entity.
    """
    named = explode_words(messages.select(F.col("named_entities").alias("entity")), "entity")
    if approximate:
        top = F.expr(f"approx_top_k(entity, {int(k)}, {int(tracked)})")
        return named.agg(top.alias("top")).select(F.inline("top")) \
            .select(F.col("item").alias("entity"), F.col("count").alias("mentions"))
    return (named.groupBy("entity").agg(F.count(F.lit(1)).alias("mentions"))
            .orderBy(F.desc("mentions"), "entity").limit(k))


def date_histogram(messages: DataFrame, by=("source",)) -> DataFrame:
    """Messages per day, by default of each source."""
    return (messages.groupBy(F.to_date("publish_date").alias("day"), *by)
            .agg(F.count(F.lit(1)).alias("messages")))
