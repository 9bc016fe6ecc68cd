"""Numbered batches of messages, the requests made of them and the way back."""

from pyspark.sql import DataFrame, Window, functions as F

from newsflow.functions.text import (answer_failed, entity_list, split_actions, split_answers,
                                     split_blocks)
from newsflow.operators.merge import join_on_key
from newsflow.scratch import materialise

# Messages per text request and per embedding request, and the
# most that answer markers of two digits can tell apart.
BATCH = 6
EMBEDDING_BATCH = 30
MAX_BATCH = 99

#: Up to this many runs (groups per partition) are broadcast, more are joined by shuffle.
BROADCAST_RUNS = 1_000_000


def number_rows(df: DataFrame, within, order, name: str = "row_number") -> DataFrame:
    """Consecutive numbers from 1 inside each ``within`` group, in the ``order`` given.

    ``within`` and ``order`` together identify a row. A window would pull a
    whole group into one task. Instead the keys alone are range partitioned, so
    that a large group spans many partitions; each key gets its position there,
    and the keys that the same group has in earlier partitions are added. The
    positions are written out once, as a second run of the partitioning may cut
    elsewhere; they are narrow, and the other columns are joined to them.
    """
    keys = [*within, *order]
    placed = materialise(
        df.select(*keys).repartitionByRange(*keys).sortWithinPartitions(*keys)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_at", F.monotonically_increasing_id()), "numbered")
    before = (Window.partitionBy(*within).orderBy("_part")
              .rowsBetween(Window.unboundedPreceding, -1))
    # one row per group and partition: a group has at most one per partition
    runs = materialise(
        placed.groupBy(*within, "_part")
        .agg(F.count(F.lit(1)).alias("_size"), F.min("_at").alias("_first"))
        .withColumn("_before", F.coalesce(F.sum("_size").over(before), F.lit(0))), "runs")
    if runs.count() <= BROADCAST_RUNS:
        runs = F.broadcast(runs)
    number = F.col("_before") + F.col("_at") - F.col("_first") + 1
    numbered = (join_on_key(placed, runs, (*within, "_part"))
                .select(*keys, number.alias(name)))
    if set(df.columns) <= set(keys):
        return numbered.select(*df.columns, name)
    return join_on_key(df, numbered, keys).select(*df.columns, name)


def chunk(messages: DataFrame, size: int = BATCH, within=("source",),
          order=("publish_date", "message_id")) -> DataFrame:
    """Cut each source's messages into consecutive batches; the last may be short.

    Adds ``batch_id`` (from 0 in each source) and ``n`` (from 1 in each batch).
    """
    if not 1 <= size <= MAX_BATCH:
        raise ValueError(f"a batch holds 1 to {MAX_BATCH} messages")
    place = F.col("_row") - 1
    return (number_rows(messages, within, order, "_row")
            .withColumn("batch_id", F.floor(place / size).cast("long"))
            .withColumn("n", (place % size + 1).cast("int"))
            .drop("_row"))


def batch_texts(chunked: DataFrame, text_col: str = "initial_text") -> DataFrame:
    """One row per batch: its texts under numbered headings, in order.

    A group is a batch, so it never holds more than :data:`MAX_BATCH` texts.
    """
    heading = F.concat(F.lit("Текст #"), F.col("n").cast("string"), F.lit(": "),
                       F.coalesce(F.col(text_col), F.lit("")), F.lit("\n"))
    in_order = F.sort_array(F.collect_list(F.struct("n", heading.alias("text"))))
    return (chunked.groupBy("source", "batch_id")
            .agg(in_order.alias("_texts"))
            .select("source", "batch_id", F.size("_texts").alias("texts"),
                    F.array_join(F.transform("_texts", lambda t: t["text"]), "\n")
                    .alias("request")))


def to_prompt(requests: DataFrame, template: str) -> DataFrame:
    """Put each request into a user's template with the fields ``{count}`` and ``{texts}``."""
    prompt = F.replace(F.lit(template), F.lit("{count}"), F.col("texts").cast("string"))
    return requests.withColumn("request", F.replace(prompt, F.lit("{texts}"), F.col("request")))


def parse_single(answers: DataFrame) -> DataFrame:
    """Replies of the one-value steps as rows ``(source, batch_id, n, value)``."""
    return (answers.filter(~answer_failed(F.col("answer")))
            .select("source", "batch_id", F.inline_outer(split_answers(F.col("answer"))))
            .filter(F.col("n").isNotNull()))


def parse_clean_ner(answers: DataFrame) -> DataFrame:
    """Replies of the clean-and-entities step, one row per block."""
    blocks = (answers.filter(~answer_failed(F.col("answer")))
              .select("source", "batch_id", F.inline_outer(split_blocks(F.col("answer"))))
              .filter(F.col("n").isNotNull())
              .withColumn("_parts", split_actions(F.col("block"))))
    return blocks.select("source", "batch_id", "n",
                         F.col("_parts.cleared_text").alias("cleared_text"),
                         entity_list(F.col("_parts.entities")).alias("named_entities"))


def align_answers(chunked: DataFrame, parsed: DataFrame, answers: DataFrame | None = None
                  ) -> DataFrame:
    """Attach parsed answers to their messages by batch and number.

    An unanswered message stays, with nulls. Given the replies too, ``error``
    tells a failed batch from a number that its reply left out.
    """
    joined = join_on_key(chunked, parsed, ("source", "batch_id", "n"), "left")
    if answers is None:
        return joined
    failed = (answers.filter(answer_failed(F.col("answer")))
              .select("source", "batch_id",
                      F.coalesce("error", "answer", F.lit("no answer")).alias("error")))
    return join_on_key(joined, failed, ("source", "batch_id"), "left")


def setup_grid(messages: DataFrame, setups) -> DataFrame:
    """Every message under every generation setup.

    ``setups`` is a list of dicts with equal keys, one of them ``setup``. It is
    written into the plan, so each row fans out where it lies.
    """
    rows = [F.struct(*[F.lit(value).alias(key) for key, value in setup.items()])
            for setup in setups]
    return messages.select("*", F.inline(F.array(*rows)))
