"""The live feed and the catalogue of its channels."""

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from newsflow.operators.select import monitored
from newsflow.schema import FEED


def live_source(spark: SparkSession, folder: str, channels=None, schema: T.StructType = FEED,
                fmt: str = "json", **options) -> DataFrame:
    """An unbounded feed from files that arrive in ``folder``, restricted to ``channels``.

    ``options`` go to the reader, e.g. ``pathGlobFilter`` or ``maxFilesPerTrigger``.
    """
    feed = spark.readStream.format(fmt).schema(schema).options(**options).load(folder)
    return feed if channels is None else monitored(feed, channels)


def kafka_source(spark: SparkSession, servers: str, topic: str, channels=None,
                 schema: T.StructType = FEED, **options) -> DataFrame:
    """The same feed from a Kafka topic of JSON records (needs Spark's Kafka package)."""
    records = (spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
               .option("subscribe", topic).options(**options).load())
    feed = records.select(F.from_json(F.col("value").cast("string"), schema).alias("r")) \
        .select("r.*")
    return feed if channels is None else monitored(feed, channels)


def source_catalogue(messages: DataFrame) -> DataFrame:
    """The channels that have stored messages."""
    return messages.select("source").distinct()
