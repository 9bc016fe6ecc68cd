"""Nearest messages by vector and ranked messages by words."""

import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from newsflow.functions.text import times, words
from newsflow.schema import KEY
from newsflow.scratch import materialise

# The usual parameters of BM25.
K1 = 1.2
B = 0.75


#: Bytes and rows that a block of vectors holds at most; a few vectors are not cut into smaller ones.
BLOCK_BYTES, BLOCK_ROWS, FEW = 48 << 20, 32768, 1024
#: Queries that a task scores at a time, and parts in which a query's finds are cut first.
SCORED, SALTS = 256, 16
#: Scores whose largest stands for all of them where a bound for the best is sought.
GROUP = 64


def _units(vectors: pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as rows of length one, or zero."""
    rows = vectors.combine_chunks()
    values = rows.flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(len(rows), -1)
    norms = np.linalg.norm(values, axis=1, keepdims=True)
    return np.divide(values, norms, out=np.zeros_like(values), where=norms > 0)


def _best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of each row's ``k`` largest scores, equal ones by column.

    ``k`` groups have a largest score that is not below the ``k``-th of these, which thus bounds the
    ``k``-th score of the row from below; few scores reach it.
    """
    n, width = scores.shape
    if width > k:
        groups = width // GROUP
        tops = scores[:, :groups * GROUP].reshape(n, groups, GROUP).max(axis=2) \
            if groups >= 4 * k else scores
        bound = np.partition(tops, tops.shape[1] - k, axis=1)[:, -k, None]
        row, column = np.nonzero(scores >= bound)
    else:
        row, column = np.divmod(np.arange(n * width), width)
    order = np.lexsort((column, -scores[row, column], row))
    row, column = row[order], column[order]
    kept = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[kept], column[kept]


def _blocks(vectors: DataFrame, name: str, size: int | None) -> int:
    """In how many blocks to cut a table: large ones, but enough for each core to have some pairs."""
    n, width = vectors.agg(F.count(F.lit(1)), F.max(F.size(name))).first()
    if size is None:
        each = 1 + int((2 * vectors.sparkSession.sparkContext.defaultParallelism) ** 0.5)
        size = min(BLOCK_ROWS, BLOCK_BYTES // (8 * max(1, width or 0)), -(-n // each))
        size = max(size, FEW)
    return max(1, -(-n // size))


def similar_topk(messages: DataFrame, queries: DataFrame | Sequence[tuple[str, Sequence[float]]],
                 k: int = 10, vector_col: str = "embedding_sts", id_cols=KEY,
                 query_block: int | None = None, message_block: int | None = None) -> DataFrame:
    """The ``k`` messages nearest to each query vector by cosine, exactly.

    ``queries`` is a table of ``query`` and ``vector``, of any size, or a list of
    such pairs. Adds ``query``, ``score`` and ``rank``; equal scores are ordered
    by id. Vectors of other lengths are not compared; zero vectors score 0.

    Blocks of queries meet blocks of messages, one pair of blocks in a task, by matrix
    products for some queries at a time, and pass on ``k`` messages per query. These
    are cut to ``k`` per query and part, then per query. A vector is sent out once per
    block of the other side, so large blocks keep what is sent small.
    """
    id_cols, spark = list(id_cols), messages.sparkSession
    if not isinstance(queries, DataFrame):
        queries = spark.createDataFrame([(name, [float(x) for x in v]) for name, v in queries],
                                        "query string, vector array<double>")
    asked = queries.filter(F.col("vector").isNotNull()).select(
        "query", F.col("vector").cast("array<double>").alias("vector"))
    with_vector = messages.filter(F.col(vector_col).isNotNull()).select(
        *id_cols, F.col(vector_col).alias("_vector"))
    q_blocks = _blocks(asked, "vector", query_block)
    m_blocks = _blocks(with_vector, "_vector", message_block)

    def everywhere(n, name):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)

    blocks = ["_dim", "_m", "_q"]
    left = with_vector.select(
        *id_cols, "_vector", F.size("_vector").alias("_dim"),
        F.pmod(F.xxhash64(*id_cols), F.lit(m_blocks)).cast("int").alias("_m"),
        everywhere(q_blocks, "_q"))
    right = asked.select(
        "query", "vector", F.size("vector").alias("_dim"),
        F.pmod(F.xxhash64("query"), F.lit(q_blocks)).cast("int").alias("_q"),
        everywhere(m_blocks, "_m"))
    ids = [messages.schema[c] for c in id_cols]
    schema = T.StructType([queries.schema["query"], *ids, T.StructField("score", T.DoubleType())])
    by_id = [(c, "ascending") for c in id_cols]

    def nearest(rows: pa.Table, wanted: pa.Table) -> pa.Table:
        rows = rows.sort_by(by_id)  # of equal scores the first ids stay
        found = []
        if rows.num_rows and wanted.num_rows:
            against, asking = _units(rows["_vector"]).T, _units(wanted["vector"])
            for start in range(0, len(asking), SCORED):
                scores = asking[start:start + SCORED] @ against
                query, at = _best(scores, k)
                found.append(rows.select(id_cols).take(pa.array(at))
                             .add_column(0, "query", wanted["query"].take(pa.array(start + query)))
                             .append_column("score", pa.array(scores[query, at])))
        if found:
            return pa.concat_tables(found)
        return pa.table([wanted["query"].slice(0, 0), *[rows[c].slice(0, 0) for c in id_cols],
                         pa.array([], pa.float64())], names=["query", *id_cols, "score"])

    best = left.groupBy(*blocks).cogroup(right.groupBy(*blocks)).applyInArrow(nearest, schema)
    salt = F.pmod(F.xxhash64(*id_cols), F.lit(SALTS)).alias("_salt")
    order = [F.desc("score"), *id_cols]
    first = Window.partitionBy("query", "_salt").orderBy(*order)
    best = (best.select("*", salt).withColumn("rank", F.row_number().over(first))
            .filter(F.col("rank") <= k).drop("_salt", "rank"))
    return (best.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order)))
            .filter(F.col("rank") <= k))


def asked_words(query: str | Sequence[str]) -> list[str]:
    """The words of a search, each once."""
    listed = re.findall(r"[^\W_]+", query) if isinstance(query, str) else query
    return sorted({word.lower() for word in listed})


def text_search(messages: DataFrame, query: str | Sequence[str], k: int = 10,
                text_col: str = "initial_text", id_cols=KEY) -> DataFrame:
    """The ``k`` messages that match any of the words best, by BM25.

    The texts are read once: each message is reduced to its length and the
    counts of the words asked for, and the rest works on those numbers.
    """
    asked = asked_words(query)
    counts = [f"_tf{i}" for i in range(len(asked))]
    counted = materialise(
        messages.select(*id_cols, words(F.col(text_col)).alias("_tokens"))
        .select(*id_cols, F.size("_tokens").cast("long").alias("_length"),
                *[times(F.col("_tokens"), word).alias(name)
                  for name, word in zip(counts, asked)]), "counts")
    stats = counted.agg(
        F.count(F.lit(1)).alias("n"), F.avg("_length").alias("avg_length"),
        *[F.count_if(F.col(name) > 0).alias("df" + name) for name in counts])
    average = stats.select("avg_length").scalar()
    total = stats.select("n").scalar()
    score = F.lit(0.0)
    for name in counts:
        having = stats.select("df" + name).scalar()
        idf = F.log(1 + (total - having + 0.5) / (having + 0.5))
        damped = F.col(name) + K1 * (1 - B + B * F.col("_length") / average)
        score = score + F.when(F.col(name) > 0, idf * F.col(name) / damped).otherwise(0.0)
    hit = F.lit(False)
    for name in counts:
        hit = hit | (F.col(name) > 0)
    return (counted.filter(hit).select(*id_cols, score.alias("score"))
            .orderBy(F.desc("score"), *id_cols).limit(k))
