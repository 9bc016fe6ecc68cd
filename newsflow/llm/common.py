"""Helpers shared by the operators: blocks of texts, per-worker caches, word codes."""

import ctypes
import sys
from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Bytes of text that a task works on at a time; a longer text is a block of its own.
BLOCK_BYTES = 1 << 20
#: Bytes of rows that Spark hands to a Python worker at a time; a larger row goes alone.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Bound the batches sent to Python by size, not by rows alone, unless the session does so."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(BATCH_BYTES))


def cached(key, make, large=False):
    """One object per key and Python worker, kept between tasks; of large ones, the last used."""
    store = sys.__dict__.setdefault("_newsflow_llm", {})
    if store.get("large") not in (None, key):
        store.pop(store.pop("large"), None)
    if key not in store:
        store[key] = make()
    if large:
        store["large"] = key
    return store[key]


def trim():
    """Give freed memory back to the machine, which other workers on it may need."""
    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not in every C library
    if give_back:
        give_back(0)


def release():
    """Drop the large object of an earlier stage, and give freed memory back."""
    store = sys.__dict__.setdefault("_newsflow_llm", {})
    store.pop(store.pop("large", None), None)
    trim()


def held_out(id_column):
    """Rows of the test fold: crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(id_column.cast("string")) % 5 == 0, F.lit(False))


def blocks(texts, limit=BLOCK_BYTES):
    """Lists of texts as bytes (null: empty), each list of ``limit`` bytes or one text."""
    release()
    block, size = [], 0
    for text in texts:
        raw = (text.as_py() or "").encode() if hasattr(text, "as_py") else (text or "").encode()
        if block and size + len(raw) > limit:
            yield block
            block, size = [], 0
        block.append(raw)
        size += len(raw)
    if block:
        yield block
    trim()


def word_codes(block):
    """Words (runs without ASCII white space) of a block: codes, words per text, distinct words."""
    codes = defaultdict(count().__next__)  # its own length would be a cycle, kept till the next collection
    counts, parts = np.zeros(len(block), np.int64), []
    for i, raw in enumerate(block):
        words = raw.split()
        counts[i] = len(words)
        parts.append(np.fromiter(map(codes.__getitem__, words), np.int64, len(words)))
    return np.concatenate(parts), counts, list(codes)


def per_row(values, rows, n):
    """Sums of values by row number."""
    return np.bincount(rows, values, n).astype(np.int64)
