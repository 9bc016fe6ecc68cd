"""Quality rules on repeated passages, found with a suffix array over each text's words."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from newsflow.llm.common import blocks, bounded_batches, per_row, table, word_codes

SYMBOLS = b"#*$%&|<>"
WHITE = b" \t\n\x0b\x0c\r"
#: Repeats shorter than this many words do not count as covered.
MIN_REPEAT_WORDS = 8
#: A text is refused if repeats cover more than this share of its words ...
MAX_COVERED = 0.5
#: ... or one repeat is longer than this many words.
MAX_REPEAT_WORDS = 100

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
            "n_covered_words", "longest_repeat")


def _grouped(keys):
    """Start of each run of equal values, as a mask and as one index per value."""
    first = np.r_[True, keys[1:] != keys[:-1]]
    starts = np.flatnonzero(first)
    return first, starts[np.cumsum(first) - 1]


def suffix_array(codes, doc, end):
    """Suffix array and its LCP array, in words, of many texts at once.

    ``doc`` and ``end`` give each position's text and the end of that text. The order is by
    text first, so suffixes of different texts never share a prefix. Ranks by the first h words
    are refined to 2h words, and only groups that still hold several suffixes are sorted again.
    The kept ranks of each round then give LCP values by halving steps.
    """
    n = len(codes)
    keys = doc * (int(codes.max()) + 1) + codes
    order = np.argsort(keys, kind="stable")
    first, start = _grouped(keys[order])
    rank = np.empty(n, np.int64)
    rank[order] = start
    levels, step = [rank], 1
    open_ = order[np.bincount(start, minlength=n)[start] > 1]
    while len(open_):
        rank, ahead = rank.copy(), open_ + step
        follow = np.where(ahead < end[open_], rank[np.minimum(ahead, n - 1)] + 1, 0)
        keys = rank[open_] * (n + 1) + follow
        resort = np.argsort(keys, kind="stable")
        open_, keys = open_[resort], keys[resort]
        old = rank[open_]
        _, old_start = _grouped(old)
        _, start = _grouped(keys)
        rank[open_] = old + start - old_start
        levels.append(rank)
        open_ = open_[np.bincount(start, minlength=len(start))[start] > 1]
        step *= 2
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    lcp = np.zeros(n, np.int64)
    at = np.flatnonzero(levels[0][order[1:]] == levels[0][order[:-1]]) + 1
    left, right, length = order[at - 1], order[at], np.zeros(len(at), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        a, b = left + length, right + length
        inside = np.maximum(a, b) < end[left]
        same = inside & (levels[level][np.minimum(a, n - 1)] == levels[level][np.minimum(b, n - 1)])
        length += same << level
    lcp[at] = length
    return order, lcp


def _covered(starts, lengths, n):
    """Mask of the positions inside the union of spans."""
    edges = np.bincount(starts, minlength=n + 1) - np.bincount(starts + lengths, minlength=n + 1)
    return np.cumsum(edges)[:n] > 0


def measure_block(block):
    """One array per name of MEASURES for a list of texts in bytes."""
    n_docs = len(block)
    codes, counts, _ = word_codes(block)
    out = {"n_words": counts,
           "word_chars": np.array([len(raw.translate(None, WHITE).decode()) for raw in block]),
           "n_symbols": np.array([len(raw) - len(raw.translate(None, SYMBOLS)) for raw in block])}
    lines = ([line for line in raw.split(b"\n") if line.strip(WHITE)] for raw in block)
    out["n_dup_lines"] = np.array([len(found) - len(set(found)) for found in lines])
    for name in MEASURES[4:]:
        out[name] = np.zeros(n_docs, np.int64)
    n = len(codes)
    if n:
        doc = np.repeat(np.arange(n_docs), counts)
        end = np.repeat(np.cumsum(counts), counts)
        order, lcp = suffix_array(codes, doc, end)
        # The deepest LCP interval around a suffix is the longest repeat that starts there; the
        # spans of all maximal repeats have the same union as these.
        repeat = np.empty(n, np.int64)
        repeat[order] = np.maximum(lcp, np.r_[lcp[1:], 0])
        three = np.flatnonzero(repeat >= 3)
        out["n_repeat_words"] = per_row(_covered(three, np.full(len(three), 3), n), doc, n_docs)
        long = np.flatnonzero(repeat >= MIN_REPEAT_WORDS)
        out["n_covered_words"] = per_row(_covered(long, repeat[long], n), doc, n_docs)
        np.maximum.at(out["longest_repeat"], doc, repeat)
    return out


@F.arrow_udf(T.StructType([T.StructField(name, T.LongType()) for name in MEASURES]))
def _measure(texts: pa.Array) -> pa.Array:
    found = [measure_block(block) for block in blocks(texts)]
    columns = [np.concatenate([part[name] for part in found]) if found else np.zeros(0, np.int64)
               for name in MEASURES]
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], list(MEASURES))


def repetition(text: Column) -> Column:
    """Struct of word, symbol, line and repeat counts of a text; null counts as empty."""
    return _measure.asNondeterministic()(text)


def base_failed(m: str = "_m") -> Column:
    return ((F.col(f"{m}.n_words") < 50)
            | (100 * F.col(f"{m}.n_repeat_words") > 50 * F.col(f"{m}.n_words")))


def passes(m: str = "_m", max_covered=MAX_COVERED, max_repeat=MAX_REPEAT_WORDS) -> Column:
    """Verdict: the base rules hold, repeats cover little and none is very long."""
    return (~base_failed(m)
            & (F.col(f"{m}.n_covered_words") <= max_covered * F.col(f"{m}.n_words"))
            & (F.col(f"{m}.longest_repeat") <= max_repeat))


def keep_unrepetitive(docs: DataFrame, text_col: str = "text", **limits) -> DataFrame:
    """The rows whose text passes, with the columns they came with.

    Rows with null, empty or very short text fail. Repeated rows are judged alike, each by itself.
    """
    bounded_batches(docs.sparkSession)
    columns = [F.col(f"_row.`{c}`") for c in docs.columns]
    return (docs.select(F.struct("*").alias("_row"), repetition(F.col(text_col)).alias("_m"))
            .filter(passes(**limits)).select(*columns))


def op1_quality_rules(spark, sf_dir):
    bounded_batches(spark)
    return (table(spark, sf_dir, "documents")
            .select("doc_id", repetition(F.col("text")).alias("_m"))
            .select("doc_id", *[F.col(f"_m.{name}") for name in MEASURES],
                    base_failed().alias("base_failed"), passes().alias("kept")))
