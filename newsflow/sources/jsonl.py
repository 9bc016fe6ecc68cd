"""JSONL files: reading, parsing to messages, and the dump by source."""

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from newsflow.functions.text import clean_text, content_id, parse_ts, sanitize_name
from newsflow.schema import JSONL, KEY, MESSAGE

CORRUPT = "_corrupt"


def scan_jsonl(spark: SparkSession, folder: str, pattern: str = "*.jsonl",
               recursive: bool = False) -> DataFrame:
    """The lines of a folder's JSONL files; a line that is no JSON lands in ``_corrupt``."""
    schema = T.StructType(JSONL.fields + [T.StructField(CORRUPT, T.StringType())])
    return (spark.read.schema(schema)
            .option("pathGlobFilter", pattern)
            .option("recursiveFileLookup", str(recursive).lower())
            .option("columnNameOfCorruptRecord", CORRUPT)
            .json(folder))


def _raw_text():
    return F.coalesce("text", "initial_text")


def parse_message(lines: DataFrame) -> DataFrame:
    """Import lines and dumped lines as message rows.

    An import line's text is cleaned, and its id is the md5 of the raw text;
    without text it is left out. A dumped line, which has an id, comes back as
    it was. Lines that :func:`rejected` returns are left out.
    """
    return lines.filter(_is_message()).select(*_as_message())


def _is_message():
    has_text = F.coalesce(_raw_text() != "", F.lit(False))
    return ~_is_rejected() & (F.col("message_id").isNotNull() | has_text)


def _as_message() -> list:
    derived = {
        "message_id": F.coalesce("message_id", content_id(_raw_text())),
        "publish_date": parse_ts(F.col("publish_date")),
        "initial_text": F.when(F.col("message_id").isNotNull(), F.col("initial_text")).otherwise(
            clean_text(_raw_text())),
        "named_entities": F.coalesce("named_entities", F.array().cast("array<string>")),
    }
    return [derived.get(f.name, F.col(f.name)).alias(f.name) for f in MESSAGE.fields]


def staged(lines: DataFrame) -> DataFrame:
    """Each line once, with its ``state``: ``import`` and ``dump`` lines as a ``message``, ``rejected``
    ones as the ``line``. Lines without text have no row."""
    state = (F.when(_is_rejected(), "rejected")
             .when(_is_message() & F.col("message_id").isNull(), "import")
             .when(_is_message(), "dump"))
    judged = lines.select(state.alias("state"), F.struct(*_as_message()).alias("_message"),
                          F.struct(*lines.columns).alias("_line"))
    bad = F.col("state") == "rejected"
    return judged.filter("state IS NOT NULL").select(
        "state", F.when(~bad, F.col("_message")).alias("message"),
        F.when(bad, F.col("_line")).alias("line"))


def _is_rejected():
    untimed = F.col("message_id").isNull() & (_raw_text() != "") \
        & parse_ts(F.col("publish_date")).isNull()
    return F.col(CORRUPT).isNotNull() | F.coalesce(untimed, F.lit(False))


def rejected(lines: DataFrame) -> DataFrame:
    """Lines that hold no JSON or a field of another type, or text without a valid time."""
    return lines.filter(_is_rejected())


def dump_by_source(messages: DataFrame, folder: str, source: str | None = None) -> None:
    """Replace ``folder`` by JSONL files, one subfolder per (sanitised) source.

    Range partitioning keeps small sources together in a task and spreads a
    large one over several tasks, so it gets several files.
    """
    chosen = messages if source is None else messages.filter(F.col("source") == source)
    body = [f.name for f in MESSAGE.fields
            if f.name in messages.columns]
    named = (chosen.withColumn("source_file",
                               sanitize_name(F.coalesce("source", F.lit("unknown"))))
             .repartitionByRange("source_file", "publish_date", "message_id"))
    times = F.date_format("publish_date", "yyyy-MM-dd'T'HH:mm:ssXXX")
    (named.select("source_file", *[times.alias(c) if c == "publish_date" else F.col(c)
                                   for c in body])
     .write.mode("overwrite").partitionBy("source_file").json(folder))


def scan_dump(spark: SparkSession, folder: str) -> DataFrame:
    """The lines of a dump, from all its subfolders."""
    return scan_jsonl(spark, folder, "*.json", recursive=True)
