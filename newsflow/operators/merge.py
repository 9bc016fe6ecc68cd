"""Keyed writes as DataFrame operations: deduplication, upserts and unions."""

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from newsflow.functions.text import content_id
from newsflow.schema import KEY


#: Up to this many keys may be broadcast.
BROADCAST_KEYS = 100_000


def latest_per_key(df: DataFrame, key_cols=KEY, order_cols=("publish_date",)) -> DataFrame:
    """One row per key: the greatest by ``order_cols``, ties by the remaining columns.

    A plain aggregation, so copies of one key shrink to a row per task before
    the shuffle however many there are.
    """
    order = [c for c in order_cols if c in df.columns and c not in key_cols]
    rest = [c for c in df.columns if c not in key_cols and c not in order]
    if not order and not rest:
        return df.dropDuplicates(list(key_cols))
    return (df.groupBy(*key_cols)
            .agg(F.max(F.struct(*order, *rest)).alias("_row"))
            .select(*[F.col(c) if c in key_cols else F.col("_row")[c].alias(c)
                      for c in df.columns]))


def join_on_key(left: DataFrame, right: DataFrame, key_cols=KEY, how: str = "inner") -> DataFrame:
    """Join on equal keys, where null equals null; the right side's keys are dropped."""
    renamed = [F.col(c).alias("_r_" + c) if c in key_cols else F.col(c) for c in right.columns]
    same = reduce(lambda a, b: a & b,
                  [F.col(c).eqNullSafe(F.col("_r_" + c)) for c in key_cols])
    return left.join(right.select(*renamed), same, how).drop(*["_r_" + c for c in key_cols])


def keep_matching(df: DataFrame, other: DataFrame, key_cols=KEY) -> DataFrame:
    return join_on_key(df, other.select(*key_cols), key_cols, "left_semi")


def drop_matching(df: DataFrame, other: DataFrame, key_cols=KEY) -> DataFrame:
    return join_on_key(df, other.select(*key_cols), key_cols, "left_anti")


def sized(keys: DataFrame) -> DataFrame:
    """Written keys, marked for a join by shuffle if they are too many to broadcast: the size of
    their files says little about that of their rows."""
    return keys if keys.count() <= BROADCAST_KEYS else keys.hint("merge")


def upsert_merge(old: DataFrame, new: DataFrame, key_cols=KEY,
                 order_cols=("publish_date",)) -> DataFrame:
    """Partial update by key, insert when absent.

    The columns ``new`` has are the ones supplied: they overwrite, with null
    too; the others keep their stored value. The result has ``old``'s columns.
    """
    unknown = set(new.columns) - set(old.columns)
    if unknown:
        raise ValueError(f"not a column of the table: {sorted(unknown)}")
    fresh = latest_per_key(new, key_cols, order_cols).select(
        F.lit(True).alias("_new"), *[F.col(c).alias("_new_" + c) for c in new.columns])
    same = reduce(lambda a, b: a & b,
                  [F.col(c).eqNullSafe(F.col("_new_" + c)) for c in key_cols])
    return old.join(fresh, same, "full_outer").select(*[
        F.when(F.col("_new"), F.col("_new_" + c)).otherwise(F.col(c)).alias(c)
        if c in new.columns else F.col(c) for c in old.columns])


def upsert_replace(old: DataFrame, new: DataFrame, key_cols=KEY,
                   order_cols=("publish_date",)) -> DataFrame:
    """Whole-row replacement by key; columns ``new`` lacks become null."""
    fresh = latest_per_key(new, key_cols, order_cols)
    return drop_matching(old, fresh, key_cols).unionByName(
        fresh.select(*[F.col(c) if c in new.columns
                       else F.lit(None).cast(old.schema[c].dataType).alias(c)
                       for c in old.columns]))


def backfill_union_live(backfill: DataFrame, live: DataFrame, key_cols=KEY,
                        order_cols=("publish_date",)) -> DataFrame:
    """History and live messages together, one row per key."""
    return latest_per_key(backfill.unionByName(live), key_cols, order_cols)


def dedup_exact(messages: DataFrame, text_col: str = "initial_text",
                order_cols=("publish_date", "source", "message_id")) -> DataFrame:
    """One row per identical text: the greatest by ``order_cols``."""
    return (latest_per_key(messages.withColumn("content_id", content_id(F.col(text_col))),
                           ("content_id",), order_cols))
