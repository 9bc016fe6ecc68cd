"""Model replies that are kept, so that no request is paid for twice.

A ledger is a folder of Parquet. Its key is a hash of the step, the options and the request, so an
equal request of another message, run or job finds the same reply. Only replies are kept: a call that
failed is asked again. Rows lie by the first :data:`DIGITS` digits of the key, and a lookup names the
ones it needs, so a round of a few requests reads a part of a long history.
"""

import json

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from newsflow.functions.text import answer_failed
from newsflow.operators.scoring import score_batches
from newsflow.scratch import materialise

#: Hexadecimal digits of the key that name its folder; more for a ledger of many millions.
DIGITS = 1
ENTRY = T.StructType([T.StructField("key", T.StringType()), T.StructField("answer", T.StringType()),
                      T.StructField("bucket", T.StringType())])


def request_key(step: str, setup: dict, request: str = "request",
                setup_cols=()) -> Column:
    """Hash of what decides a reply: step, options, request and the row's own options."""
    fixed = json.dumps([step, setup], ensure_ascii=False, sort_keys=True, default=str)
    own = F.to_json(F.struct(*[F.col(c) for c in sorted(setup_cols)])) if setup_cols else F.lit("")
    # lengths keep the parts apart, whatever they hold
    return F.sha2(F.concat_ws("\n", F.lit(fixed), F.length(own).cast("string"), own,
                              F.col(request)), 256)


def _bucket() -> Column:
    return F.substring("key", 1, DIGITS).alias("bucket")


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The replies known so far, one per key."""
    spark.createDataFrame([], ENTRY).write.mode("ignore").partitionBy("bucket").parquet(path)
    return spark.read.schema(ENTRY).parquet(path)


def _lookup(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """The ledger's replies to ``keys``; what two lost jobs both wrote counts once."""
    # as many values as there are folders, at most
    needed = [row[0] for row in keys.select(_bucket()).distinct().collect()]
    known = read_ledger(spark, path).filter(F.col("bucket").isin(needed))
    return (known.join(keys.select("key").distinct(), "key", "left_semi")
            .groupBy("key").agg(F.min("answer").alias("answer")))


def score_once(requests: DataFrame, batch_fn, path: str, step: str, setup: dict | None = None,
               id_cols=("source", "batch_id"), setup_cols=(), rounds: int = 1,
               **pace) -> DataFrame:
    """:func:`score_batches`, where requests that the ledger at ``path`` answers are not asked.

    Equal requests are asked once. The work is dealt out in ``rounds`` parts by key, and each part's
    replies are stored before the next is begun, so a job that is lost asks again for one part at
    most. A null request is not asked; it fails. Returns the ``id_cols`` and ``setup_cols`` of every
    row with ``answer`` and ``error``.
    """
    spark, id_cols, setup_cols = requests.sparkSession, list(id_cols), list(setup_cols)
    keyed = materialise(requests.select(*id_cols, *setup_cols, "request", F.when(
        F.col("request").isNotNull(), request_key(step, setup or {}, setup_cols=setup_cols)
    ).alias("key")), "keyed")
    known = keyed.filter(F.col("key").isNotNull())
    once = known.select("key").distinct()
    failed = None
    for part in range(rounds):
        asked = once.filter(F.pmod(F.xxhash64("key"), F.lit(rounds)) == part)
        new = materialise(asked.join(_lookup(spark, path, asked), "key", "left_anti"), "asked")
        if new.isEmpty():
            continue
        # only now requests move: those to be asked, copies of one shrunk ahead
        work = known.join(new, "key", "left_semi").groupBy("key").agg(
            *[F.any_value(c).alias(c) for c in (*setup_cols, "request")])
        told = materialise(score_batches(work, batch_fn, id_cols=["key"], setup_cols=setup_cols,
                                         **pace), "told")
        bad = F.col("error").isNotNull() | answer_failed(F.col("answer"))
        (told.filter(~bad).select("key", "answer", _bucket())
         .repartition("bucket").write.mode("append").partitionBy("bucket").parquet(path))
        lost = told.filter(bad).select("key", F.col("answer").alias("_refused"), "error")
        failed = lost if failed is None else failed.unionAll(lost)
    result = keyed.drop("request").join(_lookup(spark, path, once), "key", "left")
    if failed is None:
        result = result.withColumns({"_refused": F.lit(None).cast("string"),
                                     "error": F.lit(None).cast("string")})
    else:
        result = result.join(failed, "key", "left")
    return result.select(
        *id_cols, *setup_cols, F.coalesce("answer", "_refused").alias("answer"),
        F.coalesce("error", F.when(F.col("key").isNull(), "no request")).alias("error"))
