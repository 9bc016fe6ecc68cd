"""Applying a user's model function to requests and to texts."""

import random
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from newsflow.operators.batches import EMBEDDING_BATCH


def _paced(calls_per_minute: float | None) -> Callable[[], None]:
    """A function that sleeps so that it returns at most so often; each task gets its own copy.

    A task waits ahead of its first call too, as the last call may have been in the task before.
    """
    due = None

    def wait():
        nonlocal due
        now = time.monotonic()
        if due is None:
            due = now + (random.uniform(0.5, 1.5) * 60 / calls_per_minute
                         if calls_per_minute else 0)
        if calls_per_minute and due > now:
            time.sleep(due - now)
            now = due
        due = now + (60 / calls_per_minute if calls_per_minute else 0)
    return wait


def _deal(work: DataFrame, tasks: int | None) -> tuple[DataFrame, int]:
    """``work`` dealt out to ``tasks`` tasks, and how many of them run at a time.

    Adaptive execution sizes tasks by bytes, and little text can mean many slow
    calls, so the number is fixed. Small tasks also lose little when one fails.
    """
    spark = work.sparkSession
    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return work.repartition(tasks), min(tasks, spark.sparkContext.defaultParallelism)


def score_batches(requests: DataFrame, batch_fn, id_cols=("source", "batch_id"),
                  setup_cols=(), tasks: int | None = None,
                  requests_per_minute: float | None = None, call_size: int = 1) -> DataFrame:
    """Answer every ``request`` with ``batch_fn(list[str], setup) -> list[str]``.

    ``setup`` is a dict of the row's ``setup_cols``. The requests are dealt out to
    ``tasks`` tasks (by default as many as a shuffle has), of which the cluster's
    cores run some at a time; those share the rate limit evenly, and fewer tasks
    than cores mean fewer calls at once. A call that raises, or that returns a
    list of another length, fails for its ``call_size`` requests only: null
    answer and ``error``.
    """
    id_cols, setup_cols = list(id_cols), list(setup_cols)
    kept = [requests.schema[c] for c in id_cols + setup_cols]
    schema = T.StructType(kept + [T.StructField("answer", T.StringType()),
                                  T.StructField("error", T.StringType())])
    work, at_once = _deal(requests.select(*id_cols, *setup_cols, "request"), tasks)
    wait = _paced(requests_per_minute and requests_per_minute / at_once)

    def answer(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            answers, errors = [None] * len(frame), [None] * len(frame)
            setups = frame[setup_cols].to_dict("records") if setup_cols else [{}] * len(frame)
            texts = frame["request"].tolist()
            start = 0
            while start < len(texts):
                end = start + 1
                while (end < len(texts) and end - start < call_size
                       and setups[end] == setups[start]):
                    end += 1
                wait()
                try:
                    got = list(batch_fn(texts[start:end], setups[start]))
                    if len(got) != end - start:
                        raise ValueError(f"{end - start} requests but {len(got)} answers")
                    answers[start:end] = got
                except Exception as error:  # whatever the user's function raises
                    errors[start:end] = [f"{type(error).__name__}: {error}"] * (end - start)
                start = end
            yield frame[id_cols + setup_cols].assign(
                answer=pd.Series(answers, index=frame.index, dtype=object),
                error=pd.Series(errors, index=frame.index, dtype=object))

    return work.mapInPandas(answer, schema)


def embed_texts(messages: DataFrame, embed_fn, id_cols=("source", "message_id"),
                text_col: str = "cleared_text", batch: int = EMBEDDING_BATCH,
                tasks: int | None = None,
                requests_per_minute: float | None = None) -> DataFrame:
    """Both vectors of every message that has text, from ``embed_fn(list[str], kind)``.

    ``kind`` is ``"similarity"`` or ``"classification"``. A failed call leaves
    null vectors and an ``error`` for its ``batch`` messages.
    """
    id_cols = list(id_cols)
    vector = T.ArrayType(T.FloatType())
    schema = T.StructType([messages.schema[c] for c in id_cols]
                          + [T.StructField("embedding_sts", vector),
                             T.StructField("embedding_clf", vector),
                             T.StructField("error", T.StringType())])
    with_text = messages.filter(F.coalesce(F.col(text_col), F.lit("")) != "")
    work, at_once = _deal(with_text.select(*id_cols, text_col), tasks)
    wait = _paced(requests_per_minute and requests_per_minute / at_once)

    def embed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start in range(0, len(frame), batch):
                part = frame.iloc[start:start + batch]
                vectors, error = {}, None
                try:
                    for kind in ("similarity", "classification"):
                        wait()
                        vectors[kind] = list(embed_fn(part[text_col].tolist(), kind))
                        if len(vectors[kind]) != len(part):
                            raise ValueError(f"{len(part)} texts but {len(vectors[kind])} vectors")
                except Exception as raised:  # whatever the user's function raises
                    error = f"{type(raised).__name__}: {raised}"
                    vectors = {"similarity": [None] * len(part),
                               "classification": [None] * len(part)}
                yield part[id_cols].assign(
                    embedding_sts=pd.Series(vectors["similarity"], index=part.index, dtype=object),
                    embedding_clf=pd.Series(vectors["classification"], index=part.index,
                                            dtype=object),
                    error=error)

    return work.mapInPandas(embed, schema)
