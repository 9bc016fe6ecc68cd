"""Ranked word search of many items over all documents, by two trees.

A document has a coordinate per term, which grows with the term's part of it, and an item one, which
is the term's weight times its occurrences; the score is their inner product. Nodes of both trees
hold the maxima of their coordinates, so the product of two nodes bounds the scores of all their
pairs. Where it is below the weakest of the item node's k-th best scores, the pairs are left out
together. All is in whole numbers, so the bounds and the ranking are exact.

Items are taken in blocks of stated size. Of each block all documents are counted once, then
searched by the tasks that hold them; a task's best per item meet at the end. A part of the
documents, by a hash of their ids, goes first: the k-th scores it reaches are where the others start.
"""

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from newsflow.llm.common import bounded_batches, cached, table, trim
from newsflow.scratch import scratch_path, temporary

TOP = 20
#: Items, and bytes of their texts, of a block; an item that is longer is a block by itself.
ITEMS, ITEM_BYTES = 512, 1 << 16
#: Children of a node, and bytes of the coordinates that a task holds at a time.
FAN, DENSE_BYTES = 4, 16 << 20
#: One of so many documents goes first.
FIRST = 64
#: Whole numbers below this are exact in doubles.
EXACT = 1 << 53

# Term characters are ASCII letters and digits and all that is not ASCII.
_TERM = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256)).lower()
MOST = 1_000_000  # a coordinate is below this, or equal

COUNTED = "doc bigint, n bigint, codes binary, tfs binary"
FOUND = "item int, doc_id bigint, score bigint"
RESULT = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("rank", T.IntegerType()),
                       T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())])


def terms(text):
    """Terms of a text, as bytes."""
    return (text or "").encode().translate(_TERM).split()


def count(vocabulary, batches):
    """Length, and codes and counts of the vocabulary's terms, of each text that has a term."""
    for batch in batches:
        out = []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            words = terms(text.as_py())
            if words:
                codes = [c for c in map(vocabulary.get, words) if c is not None]
                codes, tfs = np.unique(np.array(codes, np.uint32), return_counts=True)
                out.append((doc, len(words), codes.tobytes(), tfs.astype(np.uint32).tobytes()))
        columns = list(zip(*out)) or [()] * 4
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, kind) for c, kind in zip(columns, (pa.int64(), pa.int64(), pa.binary(),
                                                            pa.binary()))],
            names=["doc", "n", "codes", "tfs"])
    trim()


def document_counts(size, batches):
    """Per term: how many of a task's documents hold it."""
    total = np.zeros(size, np.int64)
    for batch in batches:
        for codes in batch.column(0).to_pylist():
            total[np.frombuffer(codes, np.uint32)] += 1
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["code", "df"])


def weight(n_docs, df):
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(tf, n, n_docs, n_terms):
    """Coordinates from term counts and the length of their document."""
    tf = tf.astype(np.int64)
    m = 100 - 25 + 25 * n * n_docs // n_terms
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


# -- trees -----------------------------------------------------------------------------------

def chain(rows):
    """An order of the rows in which each follows one that it shares most with."""
    rows = rows.astype(np.float64)
    alike = rows @ rows.T
    left = np.ones(len(rows), bool)
    at, order = 0, []
    for _ in range(len(rows)):
        left[at] = False
        order.append(at)
        at = int(np.where(left, alike[at], -1).argmax())
    return np.array(order, np.int64)


def maxima(rows):
    """Largest coordinates of each FAN rows."""
    return np.maximum.reduceat(rows, np.arange(0, len(rows), FAN)) if len(rows) else rows


class Items:
    """A block of items as a tree: rows, leaves and nodes of leaves, of whole coordinates."""

    def __init__(self, rows):
        self.order = chain(rows)
        exact = np.float64 if len(rows) == 0 or int(rows.sum(1).max()) * MOST < EXACT else np.int64
        self.rows = rows[self.order].astype(exact)
        self.leaves = maxima(self.rows)
        self.nodes = maxima(self.leaves)

    def weakest(self, worst):
        """Least of the items' k-th scores in each leaf and each node."""
        leaves = np.minimum.reduceat(worst, np.arange(0, len(worst), FAN))
        return leaves, np.minimum.reduceat(leaves, np.arange(0, len(leaves), FAN))


class Search:
    """Best documents of each item so far; ``least`` is the score from which one matters."""

    def __init__(self, items, least, k):
        self.items, self.k = items, k
        self.worst = np.maximum(np.asarray(least, np.int64), 1)[items.order]
        self.best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in self.worst]
        self.scored = 0

    def add(self, docs, rows):
        """Search a batch of documents, given by ids and coordinates."""
        items = self.items
        rows = rows.astype(items.rows.dtype)
        # documents that mean most to the same leaf of items go together, the best of them first
        near = rows @ items.leaves.T
        order = np.lexsort((-near.max(1), near.argmax(1)))
        docs, rows = docs[order], rows[order]
        leaves = maxima(rows)
        for first in range(0, len(leaves), FAN):
            own = leaves[first:first + FAN]
            weak_leaves, weak_nodes = items.weakest(self.worst)
            nodes = np.flatnonzero(own.max(0) @ items.nodes.T >= weak_nodes)
            if not len(nodes):
                continue
            which = np.concatenate([np.arange(i * FAN, min((i + 1) * FAN, len(items.leaves)))
                                    for i in nodes])
            pairs = own @ items.leaves[which].T >= weak_leaves[which]
            at, which = np.flatnonzero(pairs.any(1)), which[pairs.any(0)]
            if len(at):
                self._score(docs, rows, first + at, which)

    def _score(self, docs, rows, doc_leaves, item_leaves):
        at = np.concatenate([np.arange(i * FAN, min((i + 1) * FAN, len(docs)))
                             for i in doc_leaves])
        which = np.concatenate([np.arange(i * FAN, min((i + 1) * FAN, len(self.worst)))
                                for i in item_leaves])
        scores = (rows[at] @ self.items.rows[which].T).astype(np.int64)
        self.scored += scores.size
        good = scores >= self.worst[which]
        for column in np.flatnonzero(good.any(0)):
            item, some = which[column], np.flatnonzero(good[:, column])
            old = self.best[item]
            score = np.r_[old[0], scores[some, column]]
            doc = np.r_[old[1], docs[at[some]]]
            top = np.lexsort((doc, -score))[:self.k]
            self.best[item] = score[top], doc[top]
            if len(top) == self.k:
                self.worst[item] = max(self.worst[item], score[top[-1]])


def _sparse(rows):
    """An item matrix, small enough to travel with a task."""
    return rows.shape, *(zlib.compress(a.tobytes(), 1) for a in (*np.nonzero(rows), rows[rows > 0]))


def _dense(shape, *parts):
    rows = np.zeros(shape, np.int64)
    i, j, values = (np.frombuffer(zlib.decompress(p), np.int64) for p in parts)
    rows[i, j] = values
    return rows


def _search(key, packed, least, k, n_docs, n_terms):
    """A task's best documents for each item of a block."""
    width = packed[0][1]
    height = max(FAN, DENSE_BYTES // (8 * max(1, width)))

    def search(batches):
        items = cached(key, lambda: Items(_dense(*packed)), large=True)
        found = Search(items, least, k)
        rows, docs = np.zeros((height, width), np.int64), []
        for batch in batches:
            for doc, n, codes, tfs in zip(*(c.to_pylist() for c in batch.columns)):
                codes = np.frombuffer(codes, np.uint32)
                rows[len(docs), codes] = impacts(np.frombuffer(tfs, np.uint32), n, n_docs, n_terms)
                docs.append(doc)
                if len(docs) == height:
                    found.add(np.array(docs, np.int64), rows)
                    rows[:], docs = 0, []
        if docs:
            found.add(np.array(docs, np.int64), rows[:len(docs)])
        item = np.repeat(items.order, [len(s) for s, _ in found.best])
        score, doc = (np.concatenate([pair[i] for pair in found.best]) for i in (0, 1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(item.astype(np.int32)), pa.array(doc), pa.array(score)],
            names=["item", "doc_id", "score"])
        trim()
    return search


# -- search ----------------------------------------------------------------------------------

def _item_blocks(items: DataFrame):
    """Lists of (id, terms), of bounded size, of the items that have a term."""
    block, size = [], 0
    for row in items.toLocalIterator():
        own = terms(row[1])
        if not own:
            continue
        n = sum(map(len, own)) + len(own)
        if block and (len(block) == ITEMS or size + n > ITEM_BYTES):
            yield block
            block, size = [], 0
        block.append((row[0], own))
        size += n
    if block:
        yield block


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _rank_block(docs: DataFrame, block, k: int, keep):
    spark = docs.sparkSession
    vocabulary = {term: i for i, term in
                  enumerate(dict.fromkeys(t for _, own in block for t in own))}
    counted = keep(docs.mapInArrow(lambda rows: count(vocabulary, rows), COUNTED), "counted")
    totals = counted.agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
    n_docs, n_terms = totals["docs"], totals["terms"]
    if not n_docs:
        return None
    size = len(vocabulary)
    df = np.zeros(size, np.int64)
    for row in (counted.select("codes").mapInArrow(
            lambda rows: document_counts(size, rows), "code bigint, df bigint")
            .groupBy("code").agg(F.sum("df").alias("df")).collect()):
        df[row["code"]] = row["df"]
    rows = np.zeros((len(block), size), np.int64)
    weights = np.array([weight(n_docs, int(n)) for n in df], np.int64)
    for i, (_, own) in enumerate(block):
        codes, times = np.unique([vocabulary[t] for t in own], return_counts=True)
        rows[i, codes] = times * weights[codes]
    packed, key = _sparse(rows), scratch_path(spark, "items")
    ranked = counted.filter("doc IS NOT NULL")
    part = ranked.filter(F.pmod(F.xxhash64("doc"), F.lit(FIRST)) == 0)
    start = np.ones(len(block), np.int64)
    first = _best(part.mapInArrow(_search(key, packed, start, k, n_docs, n_terms), FOUND), k)
    for row in first.filter(F.col("rank") == k).collect():
        start[row["item"]] = row["score"]
    return _best(ranked.mapInArrow(_search(key, packed, start, k, n_docs, n_terms), FOUND), k)


def rank_documents(docs: DataFrame, items: DataFrame, k: int = TOP, id_col="doc_id",
                   text_col="text", item_col="item_id", item_text="text") -> DataFrame:
    """The ``k`` best documents of each item: ``item_id``, ``rank``, ``doc_id``, ``score``.

    Only scores above 0 count. Rows are documents: those of one id are ranked each, one after the
    other, and equal item rows are one item. Rows without an id count among the documents but are
    not ranked. Null texts have no term.
    """
    bounded_batches(docs.sparkSession)
    spark, out = docs.sparkSession, scratch_path(docs.sparkSession, "ranked")
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).alias("text"))
    asked = items.select(F.col(item_col).cast("bigint"), item_text).distinct()
    blocks = 0
    for block in _item_blocks(asked):
        with temporary(spark) as keep:
            best = _rank_block(texts, block, k, keep)
            if best is None:
                break
            ids = spark.createDataFrame([(i, row[0]) for i, row in enumerate(block)],
                                        "item int, item_id bigint")
            (best.join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score")
             .write.parquet(f"{out}/block={blocks}"))
            blocks += 1
    if not blocks:
        return spark.createDataFrame([], RESULT)
    return spark.read.schema(RESULT).parquet(*[f"{out}/block={i}" for i in range(blocks)])


def op13_dual_tree_search(spark, sf_dir):
    return rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP13_SQL = r"""
WITH terms AS (
  SELECT 0 AS kind, doc_id AS id, list_transform(regexp_extract_all(text,
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: translate(x,
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS t FROM documents
  UNION ALL SELECT 1, item_id, list_transform(regexp_extract_all(text,
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: translate(x,
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) FROM benchmark),
corpus AS (SELECT count(*) AS n_docs, sum(len(t))::BIGINT AS n_terms FROM terms
  WHERE kind = 0 AND len(t) > 0),
docs AS (SELECT id, 75 + (25 * len(t) * n_docs) // n_terms AS m FROM terms, corpus
  WHERE kind = 0 AND len(t) > 0),
item_terms AS (SELECT id AS item_id, term, count(*) AS times FROM (
  SELECT id, unnest(t) AS term FROM terms WHERE kind = 1) GROUP BY ALL),
counts AS (SELECT id, term, count(*) AS tf FROM (
  SELECT id, unnest(t) AS term FROM terms WHERE kind = 0)
  WHERE term IN (SELECT term FROM item_terms) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
  FROM counts, corpus GROUP BY term, n_docs),
scores AS (SELECT i.item_id, c.id AS doc_id,
    sum(i.times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
  FROM item_terms i JOIN counts c USING (term) JOIN weights USING (term) JOIN docs d ON d.id = c.id
  GROUP BY i.item_id, c.id),
ranked AS (SELECT item_id, row_number() OVER (
    PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
  FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20"""
