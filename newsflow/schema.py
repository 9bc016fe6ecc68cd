"""Column layouts of the message table and of the records that feed it."""

from pyspark.sql import types as T

KEY = ("source", "message_id")

#: The message table. ``cleared_text`` is null until a message has been enriched.
MESSAGE = T.StructType([
    T.StructField("message_id", T.StringType(), False),
    T.StructField("publish_date", T.TimestampType()),
    T.StructField("source", T.StringType()),
    T.StructField("initial_text", T.StringType()),
    T.StructField("cleared_text", T.StringType()),
    T.StructField("named_entities", T.ArrayType(T.StringType())),
    T.StructField("summary", T.StringType()),
    T.StructField("tonality", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("embedding_sts", T.ArrayType(T.FloatType())),
    T.StructField("embedding_clf", T.ArrayType(T.FloatType())),
])

ENRICHED = ("cleared_text", "named_entities", "summary", "tonality", "category",
            "embedding_sts", "embedding_clf")

#: The table at rest: one extra column, the day it is partitioned by.
STORED = T.StructType(MESSAGE.fields + [T.StructField("publish_day", T.DateType())])

#: One record as the feed delivers it; either text form may be empty.
FEED = T.StructType([
    T.StructField("message_id", T.LongType()),
    T.StructField("channel_id", T.LongType()),
    T.StructField("publish_date", T.TimestampType()),
    T.StructField("source", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("message", T.StringType()),
])

#: One line of a JSONL file. ``text`` belongs to import files; the rest, from
#: ``initial_text`` on, to files this package dumped.
JSONL = T.StructType([
    T.StructField("message_id", T.StringType()),
    T.StructField("publish_date", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("initial_text", T.StringType()),
    T.StructField("cleared_text", T.StringType()),
    T.StructField("named_entities", T.ArrayType(T.StringType())),
    T.StructField("summary", T.StringType()),
    T.StructField("tonality", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("embedding_sts", T.ArrayType(T.FloatType())),
    T.StructField("embedding_clf", T.ArrayType(T.FloatType())),
])

# The closed sets of labels, in the order that breaks ties.
TONALITIES = ("позитивна", "негативна", "нейтральна", "об'єктивна", "емоційна", "загрозлива")
CATEGORIES = ("політика", "економіка", "соціальні питання", "наука і технології",
              "культура і мистецтво", "спорт", "міжнародні події", "освіта",
              "здоров'я і медицина", "природні катастрофи та надзвичайні ситуації")
