"""Quality classifier: a linear-chain conditional random field labels every line good or bad.

The features of a line are its own and its neighbours' character and word shares. Forward-backward
marginals, weighted by line length, make the score of a document. The field is fitted on a bounded
sample of labelled documents whose lines all carry the document's label.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from newsflow.llm.common import blocks, bounded_batches, held_out, table, word_codes

#: Labelled documents the field is fitted on, taken in the order of a hash of their ids.
SAMPLE_DOCS = 3000
#: Score from which a document counts as good.
THRESHOLD = 0.3
#: Score of a text without any line, which gives no evidence, and of every text if the sample
#: holds a single class.
NO_EVIDENCE = 0.5
STEPS, RATE, PENALTY = 300, 0.1, 1e-4

N_OWN = 11
N_FEATURES = 3 * N_OWN + 3
SHAPES = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz",
          "digit": b"0123456789", "shout": b"!?", "symbol": b"#*$%&<>@^~=+\\/_{}[]", "bar": b"|",
          "stop": b".,;:'\"()-", "space": b" \t\x0b\x0c\r"}


def _line_spans(block):
    """Bytes of a block, and begin, end and text number of each of its lines with a word."""
    flat = np.frombuffer(b"".join(raw + b"\n" for raw in block), np.uint8)
    white = np.isin(flat, np.frombuffer(b" \t\n\x0b\x0c\r", np.uint8))
    ends = np.flatnonzero(flat == 10)
    begins = np.r_[0, ends[:-1] + 1]
    doc_ends = np.cumsum([len(raw) + 1 for raw in block])
    doc = np.searchsorted(doc_ends, ends, side="right")
    dark = np.r_[0, np.cumsum(~white)]
    keep = dark[ends] > dark[begins]
    return flat, begins[keep], ends[keep], doc[keep]


def _shares(flat, begins, ends):
    """Share of each kind of byte in each line, and upper-case letters among letters."""
    length = np.maximum(ends - begins, 1)
    kind = np.zeros(256, np.uint8)
    for i, chars in enumerate(SHAPES.values(), 1):
        kind[np.frombuffer(chars, np.uint8)] = i
    kinds = kind[flat]
    accent = np.flatnonzero((flat[:-1] == 0xC3) & (flat[1:] >= 0x80)) + 1
    kinds[accent] = np.where(flat[accent] < 0x9F, 1, 2)  # Latin capitals and small letters
    edges = np.stack([begins, ends], 1).ravel()
    count = {}
    for i, name in enumerate(SHAPES, 1):
        count[name] = np.add.reduceat((np.r_[kinds, 0] == i).astype(np.int32), edges)[::2]
    letters = np.maximum(count["upper"] + count["lower"], 1)
    shares = [count["upper"] / letters]
    shares += [count[name] / length for name in ("digit", "shout", "symbol", "bar", "stop")]
    return np.sqrt(np.stack(shares, 1)), length  # roots spread out small shares


def _word_shares(block, flat, begins, ends):
    """Mean word length, repeats of the word before, and distinct words, per line."""
    codes, _, _ = word_codes(block)
    dark = ~np.isin(flat, np.frombuffer(b" \t\n\x0b\x0c\r", np.uint8))
    heads = np.flatnonzero(dark & ~np.r_[False, dark[:-1]])
    line = np.searchsorted(ends, heads, side="right")
    n = len(begins)
    words = np.maximum(np.bincount(line, minlength=n), 1)
    again = np.r_[False, (codes[1:] == codes[:-1]) & (line[1:] == line[:-1])]
    pairs = np.unique(line * (int(codes.max()) + 1) + codes) // (int(codes.max()) + 1)
    distinct = np.bincount(pairs, minlength=n) / words
    dark_bytes = np.r_[0, np.cumsum(dark)]
    mean = (dark_bytes[ends] - dark_bytes[begins]) / words
    return np.stack([np.minimum(mean / 20, 2), np.bincount(line, again, n) / words, distinct], 1)


def line_features(block):
    """Features, weights and text numbers of all lines of a block."""
    flat, begins, ends, doc = _line_spans(block)
    n = len(begins)
    if not n:
        return np.zeros((0, N_FEATURES)), np.zeros(0), doc
    shares, length = _shares(flat, begins, ends)
    lines = [flat[b:e].tobytes() for b, e in zip(begins, ends)]
    known, again = set(), np.zeros(n)
    for i, key in enumerate(zip(doc.tolist(), lines)):
        again[i] = key in known
        known.add(key)
    own = np.column_stack([shares, _word_shares(block, flat, begins, ends),
                           np.log1p(length) / 8, again])
    first = np.r_[True, doc[1:] != doc[:-1]]
    last = np.r_[first[1:], True]
    before = np.where(first[:, None], 0, np.roll(own, 1, 0))
    after = np.where(last[:, None], 0, np.roll(own, -1, 0))
    return np.column_stack([own, before, after, first, last, np.ones(n)]), length, doc


def _chains(doc):
    """For each step t, the lines that are the t-th of their text: (lines, lines before them)."""
    first = np.r_[True, doc[1:] != doc[:-1]] if len(doc) else np.zeros(0, bool)
    starts = np.flatnonzero(first)
    sizes = np.diff(np.r_[starts, len(doc)])
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]
    alive = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1 if len(sizes) else 1), side="right")
    return [starts[:k] + t for t, k in enumerate(alive)]


def forward_backward(emission, trans, chains):
    """Log odds of good against bad ahead of and behind each line.

    ``emission`` is a line's score for good; ``trans[a, b]`` the score of label a before label b.
    """
    ahead, behind = np.array(emission, float), np.zeros(len(emission))
    for t in range(1, len(chains)):
        at = chains[t]
        r = ahead[at - 1]
        ahead[at] += (np.logaddexp(r + trans[1, 1], trans[0, 1])
                      - np.logaddexp(r + trans[1, 0], trans[0, 0]))
    for t in range(len(chains) - 1, 0, -1):
        at = chains[t]
        s = behind[at] + emission[at]
        behind[at - 1] = (np.logaddexp(s + trans[1, 1], trans[1, 0])
                          - np.logaddexp(s + trans[0, 1], trans[0, 0]))
    return ahead, behind


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def fit(features, doc, label):
    """Weights and transitions that maximise the penalised likelihood of the line labels.

    Features are brought to one scale for the fit; the weights returned are for raw features.
    """
    spread = features.std(0)
    scale = np.where(spread > 0, spread, 1)
    middle = np.where(spread > 0, features.mean(0), 0)
    features = (features - middle) / scale
    weights, trans = np.zeros(features.shape[1]), np.zeros((2, 2))
    chains = _chains(doc)
    later = np.concatenate(chains[1:]) if len(chains) > 1 else np.zeros(0, np.int64)
    seen = np.zeros((2, 2))
    np.add.at(seen, (label[later - 1], label[later]), 1)
    moment, square = np.zeros(len(weights) + 4), np.zeros(len(weights) + 4)
    for step in range(1, STEPS + 1):
        emission = features @ weights
        ahead, behind = forward_backward(emission, trans, chains)
        gap = label - _sigmoid(ahead + behind)
        pair = np.zeros((2, 2))
        s = behind[later] + emission[later]
        joint = np.stack([np.stack([np.full(len(later), trans[0, 0]), trans[0, 1] + s]),
                          np.stack([trans[1, 0] + ahead[later - 1],
                                    trans[1, 1] + ahead[later - 1] + s])])
        if len(later):
            joint = np.exp(joint - joint.max((0, 1)))
            pair = (joint / joint.sum((0, 1))).sum(2)
        gradient = np.r_[features.T @ gap, (seen - pair).ravel()] / len(label)
        gradient -= PENALTY * np.r_[weights, trans.ravel()]
        moment = 0.9 * moment + 0.1 * gradient
        square = 0.99 * square + 0.01 * gradient ** 2
        move = RATE * (moment / (1 - 0.9 ** step)) / (np.sqrt(square / (1 - 0.99 ** step)) + 1e-9)
        weights, trans = weights + move[:-4], trans + move[-4:].reshape(2, 2)
    weights = weights / scale
    weights[-1] -= middle @ weights  # the last feature is 1 in every line
    return weights, trans


def score_block(block, weights, trans):
    """Length-weighted mean of the lines' probability of good, per text."""
    features, length, doc = line_features(block)
    ahead, behind = forward_backward(features @ weights, trans, _chains(doc))
    total = np.bincount(doc, length, len(block))
    good = np.bincount(doc, length * _sigmoid(ahead + behind), len(block))
    return np.where(total > 0, good / np.maximum(total, 1), NO_EVIDENCE)


@F.arrow_udf(T.BinaryType())
def _features(texts: pa.Array) -> pa.Array:
    """The line features of each text, as the bytes of single-precision rows."""
    out = []
    for block in blocks(texts):
        features, _, doc = line_features(block)
        cuts = np.searchsorted(doc, np.arange(1, len(block)))
        out += [part.tobytes() for part in np.split(features.astype(np.float32), cuts)]
    return pa.array(out, pa.binary())


def train(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS):
    """Fit on at most ``sample_docs`` labelled documents outside the test fold.

    A document with several labels counts as bad. None if there are not both classes.
    """
    bounded_batches(docs.sparkSession)
    sample = (labels.filter(~held_out(F.col("doc_id")) & F.col("quality").isNotNull()
                            & F.col("doc_id").isNotNull())
              .groupBy("doc_id").agg(F.min("quality").alias("_good"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs))
    rows = (docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
            .select("doc_id", "_good", _features(F.col("text")).alias("_x"))
            .filter(F.length("_x") > 0).collect())
    rows.sort(key=lambda row: row["doc_id"])
    goods = [int(row["_good"] > 0) for row in rows]
    if len(set(goods)) < 2:
        return None
    parts = [np.frombuffer(row["_x"], np.float32).reshape(-1, N_FEATURES) for row in rows]
    sizes, features = [len(part) for part in parts], np.concatenate(parts).astype(float)
    return fit(features, np.repeat(np.arange(len(rows)), sizes), np.repeat(goods, sizes))


def quality_score(text: Column, model) -> Column:
    """Probability that a text is good, from 0 to 1; 0.5 for null and for texts without a word."""
    @F.arrow_udf(T.DoubleType())
    def score(texts: pa.Array) -> pa.Array:
        if model is None:
            return pa.array(np.full(len(texts), NO_EVIDENCE))
        parts = [score_block(block, *model) for block in blocks(texts)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())

    return score.asNondeterministic()(text)


def keep_good(docs: DataFrame, labels: DataFrame, text_col="text", threshold=THRESHOLD,
              sample_docs=SAMPLE_DOCS) -> DataFrame:
    """The rows with a score of ``threshold`` or more, with the columns they came with."""
    model = train(docs.select("doc_id", F.col(text_col).alias("text")), labels, sample_docs)
    columns = [F.col(f"_row.`{c}`") for c in docs.columns]
    return (docs.select(F.struct("*").alias("_row"),
                        quality_score(F.col(text_col), model).alias("_score"))
            .filter(F.col("_score") >= threshold).select(*columns))


def op4_quality_classifier(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    return (docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"),
                        quality_score(F.col("text"), model).alias("score"))
            .withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int")))
