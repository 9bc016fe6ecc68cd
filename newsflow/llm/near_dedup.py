"""Near-duplicate detection: banded MinHash, sequential Bayesian pruning, exact verification.

Texts with the same shingle set are one class from the start. Class representatives meet in the
buckets of their signature bands. Each is first compared with its bucket's smallest id; what those
links leave apart is compared block by block, and pairs that are connected already are skipped. A
pair's signatures are compared batch after batch, until the chance that it is similar enough falls
below the miss probability; the rest is decided on full shingle sets.
"""

import hashlib
from functools import lru_cache
from math import lgamma, log1p, log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from newsflow.llm.common import blocks, bounded_batches, cached, table, trim, word_codes
from newsflow.llm.components import components
from newsflow.scratch import materialise, temporary

WORDS, PERCENT = 5, 85
#: A pair at the threshold shares no band with a probability below 3e-7.
BANDS, ROWS = 32, 6
#: Signature values compared at a time, and chance of losing a similar pair at each stop.
BATCH, MISS = 32, 1e-7
#: Members of a bucket that meet in one task.
BLOCK = 512
#: Rows of a few numbers up to which a table is sent to all executors, 30 MB or so; beyond it, both
#: sides of its join are exchanged.
SENT_ROWS = 300_000

PARTNERED = ("g bigint, i int, j int, bucket bigint, block int, component bigint, id bigint, "
             "signature binary, first boolean")
SKETCH = T.StructType([T.StructField("n_shingles", T.LongType()),
                       T.StructField("set_key", T.BinaryType()),
                       T.StructField("signature", T.BinaryType())])


def _word_hashes(words):
    """64-bit hash of each distinct word, from the words alone."""
    return np.array([int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little")
                     for w in words], np.uint64)


def shingle_sets(block, n_words=WORDS):
    """Sorted distinct 64-bit shingle hashes of each text of a block."""
    codes, counts, words = word_codes([raw.lower() for raw in block])  # lowers A-Z only
    hashes = _word_hashes(words)[codes] if len(codes) else np.zeros(0, np.uint64)
    out, begin = [], 0
    for n in counts.tolist():
        own, width = hashes[begin:begin + n], min(n, n_words)
        begin += n
        total = np.full(max(n - width + 1, 0) if n else 0, width, np.uint64)
        for i in range(width):
            total = (total ^ own[i:i + len(total)]) * np.uint64(0x9E3779B97F4A7C15)
            total ^= total >> np.uint64(29)
        out.append(np.unique(total))
    return out


def _permutations():
    draw = np.random.default_rng(20240601)
    n = BANDS * ROWS
    return (draw.integers(0, 2 ** 32, n, np.uint64).astype(np.uint32) | np.uint32(1),
            draw.integers(0, 2 ** 32, n, np.uint64).astype(np.uint32))


def signature(shingles):
    """Low halves of the least values of the shingles under each permutation."""
    times, plus = cached("permutations", _permutations)
    low = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
    least = np.full(len(times), 0xFFFFFFFF, np.uint32)
    for begin in range(0, len(low), 512):
        part = low[begin:begin + 512, None] * times + plus
        least = np.minimum(least, part.min(0))
    mixed = least * np.uint32(0x85EBCA6B)
    return (mixed ^ (mixed >> np.uint32(15))).astype(np.uint16)


@F.arrow_udf(SKETCH)
def _sketch(texts: pa.Array) -> pa.Array:
    sizes, keys, signatures = [], [], []
    for block in blocks(texts):
        for shingles in shingle_sets(block):
            sizes.append(len(shingles))
            empty = not len(shingles)
            keys.append(None if empty else hashlib.md5(shingles.tobytes()).digest())
            signatures.append(None if empty else signature(shingles).tobytes())
    return pa.StructArray.from_arrays([pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()),
                                       pa.array(signatures, pa.binary())], SKETCH.names)


def sketch(text: Column) -> Column:
    """Number of distinct shingles, key of the set, and signature; the last two are null for null
    texts and texts without a word."""
    return _sketch.asNondeterministic()(text)


@lru_cache(maxsize=None)
def least_matches(percent=PERCENT, miss=MISS, batch=BATCH, total=BANDS * ROWS):
    """For 1, 2, ... batches compared: matches with which a pair goes on.

    With a uniform prior, similarity given m of n matches follows Beta(m+1, n-m+1), and its chance
    to reach s is that of at most m successes in n+1 draws of probability s.
    """
    s, out = percent / 100, []
    for n in range(batch, total + 1, batch):
        chance, m = 0.0, -1
        while chance < miss:
            m += 1
            chance += np.exp(lgamma(n + 2) - lgamma(m + 1) - lgamma(n + 2 - m)
                             + m * log(s) + (n + 1 - m) * log1p(-s))
        out.append(m)
    return tuple(out)


def likely(left, right):
    """Mask of the signature pairs (rows of two matrices) that are not ruled out."""
    alive, matches = np.arange(len(left)), np.zeros(len(left), np.int64)
    for i, least in enumerate(least_matches()):
        part = slice(i * BATCH, (i + 1) * BATCH)
        matches[alive] += (left[alive, part] == right[alive, part]).sum(1)
        alive = alive[matches[alive] >= least]
    mask = np.zeros(len(left), bool)
    mask[alive] = True
    return mask


def similar(a, b, percent=PERCENT):
    """Whether two shingle sets (sorted arrays) reach the threshold."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if not len(small) or 100 * len(small) < percent * len(large):
        return False
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    both = int((large[at] == small).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _matrix(signatures: pa.Array):
    return np.frombuffer(b"".join(signatures.to_pylist()), np.uint16).reshape(len(signatures), -1)


@F.arrow_udf(T.BooleanType())
def _likely(left: pa.Array, right: pa.Array) -> pa.Array:
    if not len(left):
        return pa.array([], pa.bool_())
    return pa.array(likely(_matrix(left), _matrix(right)))


@F.arrow_udf(T.ArrayType(T.LongType()))
def _buckets(signatures: pa.Array) -> pa.Array:
    """One 64-bit key per band of a signature."""
    rows = _matrix(signatures).reshape(-1, BANDS, ROWS).astype(np.uint64)
    key = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(rows), 1))
    for i in range(ROWS):
        key = (key ^ rows[:, :, i]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(32)
    flat = pa.array(key.view(np.int64).ravel())
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * BANDS, pa.int32()), flat)


def _with_partner(pdf: pd.DataFrame) -> pd.DataFrame:
    """Rows of two blocks whose signatures leave a chance to be similar to a row of another
    component in the same bucket."""
    keep = np.zeros(len(pdf), bool)
    pdf = pdf.reset_index(drop=True)
    for _, rows in pdf.groupby("bucket", sort=False):
        left, right = rows["i"].iloc[0], rows["j"].iloc[0]
        at, block = rows.index.to_numpy(), rows["block"].to_numpy()
        part, size = rows["component"].to_numpy(), rows["n_shingles"].to_numpy()
        signatures = np.frombuffer(b"".join(rows["signature"]), np.uint16).reshape(len(rows), -1)
        for a in np.flatnonzero(block == left):
            others = np.flatnonzero((block == right) & (part != part[a]) & (
                100 * np.minimum(size, size[a]) >= PERCENT * np.maximum(size, size[a])))
            if left == right:
                others = others[others > a]
            if len(others):
                others = others[likely(np.broadcast_to(signatures[a], signatures[others].shape),
                                       signatures[others])]
                keep[at[others]] = True
                keep[at[a]] |= len(others) > 0
    pdf = pdf.loc[keep, ["g", "i", "j", "bucket", "block", "component", "id", "signature"]]
    pdf["first"] = ~pdf["id"].duplicated()
    pdf["signature"] = pdf["signature"].where(pdf["first"], None)
    trim()
    return pdf


def _link_block(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links that join up the components of each bucket's members in two of its blocks.

    A member of several buckets has its signature and text in the row that is its first.
    """
    links = []
    held = pdf[pdf["first"]].drop_duplicates("id").set_index("id")[["signature", "text"]]
    pdf = pdf.drop(columns=["signature", "text"]).join(held, on="id")
    for _, rows in pdf.groupby("bucket", sort=False):
        rows = rows.drop_duplicates("id").reset_index(drop=True)
        left, right = rows["i"].iloc[0], rows["j"].iloc[0]
        ids, block = rows["id"].to_numpy(), rows["block"].to_numpy()
        root = {c: c for c in rows["component"]}

        def find(c, root=root):
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c

        part = rows["component"].to_numpy()
        signatures = np.frombuffer(b"".join(rows["signature"]), np.uint16).reshape(len(rows), -1)
        sets = {}

        def shingles(k, rows=rows, sets=sets):
            if k not in sets:
                sets[k] = shingle_sets([(rows["text"].iloc[k] or "").encode()])[0]
            return sets[k]

        for a in np.flatnonzero(block == left):
            others = np.flatnonzero((block == right) & (part != part[a]))
            if left == right:
                others = others[others > a]
            others = others[likely(np.broadcast_to(signatures[a], signatures[others].shape),
                                   signatures[others])] if len(others) else others
            for b in others.tolist():
                if find(part[a]) != find(part[b]) and similar(shingles(a), shingles(b)):
                    root[find(part[a])] = find(part[b])
                    links.append((ids[a], ids[b]))
    trim()
    return pd.DataFrame(links, columns=["a", "b"]).astype("int64")


def _link_star(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links of each leader with the rows that come with it."""
    links = []
    for leader, rows in pdf.groupby("a", sort=False):
        own = rows["id"] == leader
        head = shingle_sets([(rows["text"][own].iloc[0] or "").encode()])[0]
        for id_, text in zip(rows["id"][~own], rows["text"][~own]):
            if similar(head, shingle_sets([(text or "").encode()])[0]):
                links.append((leader, id_))
    trim()
    return pd.DataFrame(links, columns=["a", "b"]).astype("int64")


def _sent(table_: DataFrame) -> DataFrame:
    """A written table, marked for broadcast if it is small."""
    return F.broadcast(table_) if table_.count() <= SENT_ROWS else table_


def _star_links(pairs: DataFrame, signatures: DataFrame, docs: DataFrame, keep) -> DataFrame:
    """Links between a bucket's smallest id and its others, the pairs (a, b).

    The texts of a leader and of those that are likely similar to it meet in one exchange, a leader
    with many of them in several parts.
    """
    of_a, of_b = (signatures.select(F.col("id").alias(k), F.col("signature").alias(f"s{k}"),
                                    F.col("n_shingles").alias(f"n{k}")) for k in "ab")
    close = 100 * F.least("na", "nb") >= PERCENT * F.greatest("na", "nb")
    pairs = keep(pairs.join(of_a, "a").join(of_b, "b").filter(close).filter(_likely("sa", "sb"))
                 .select("a", "b"), "pairs")
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    stars = pairs.join(parts, "a").select(
        "a", F.col("b").alias("id"), F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"))
    heads = parts.select("a", F.col("a").alias("id"),
                         F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    groups = max(1, -(-pairs.count() // BLOCK))
    met = docs.join(_sent(keep(stars.unionAll(heads), "stars")), "id").withColumn(
        "g", F.pmod("a", F.lit(groups)))
    # as many leaders go together as make a block; a part of a large one is a block by itself
    return (met.withColumn("big", F.when(F.col("part") > 0, F.col("a")).otherwise(F.lit(-1)))
            .groupBy("g", "big", "part").applyInPandas(_link_star, "a bigint, b bigint"))


def _block_links(members: DataFrame, parts: DataFrame, signatures: DataFrame, texts: DataFrame,
                 keep) -> DataFrame:
    """Links between different components that share a bucket, whatever its size.

    A large bucket is dealt into blocks, and each pair of blocks is a task's work; small ones of one
    leader, which are as many as bands at most, go together. Every pair of members meets in exactly
    one place. They meet by signature first: a text goes only where it has a likely partner, once
    for all buckets that are there.
    """
    known = members.join(parts, "id", "left").select(
        "bucket", "leader", "id", "n", F.coalesce("component", "id").alias("component"))
    ids = [F.sum(F.xxhash64("id", F.lit(seed)).cast("decimal(38,0)")).alias(f"_ids{seed}")
           for seed in (0, 1)]
    open_ = known.filter("n > 2").groupBy("bucket").agg(
        F.count("*").alias("_rows"), F.min("component").alias("_least"),
        F.max("component").alias("_most"), *ids).filter("_least <> _most")
    # copies share many buckets; of those with the same members, told by 128 bits, one is enough
    open_ = open_.groupBy("_rows", "_ids0", "_ids1").agg(F.min("bucket").alias("bucket"))
    known = keep(known.join(open_.select("bucket"), "bucket"), "unresolved")
    groups = max(1, -(-known.count() // BLOCK))
    n_blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    dealt = (known.join(signatures, "id").withColumn("_blocks", n_blocks)
             .withColumn("block", F.pmod(F.xxhash64("id", "bucket"), F.col("_blocks")).cast("int"))
             .withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
             .withColumn("i", F.least("block", "_o")).withColumn("j", F.greatest("block", "_o"))
             .withColumn("g", F.when(F.col("_blocks") == 1, F.pmod(
                 F.xxhash64("leader"), F.lit(groups))).otherwise(F.col("bucket")))
             .select("g", "i", "j", "bucket", "block", "component", "id", "n_shingles",
                     "signature"))
    partnered = keep(dealt.groupBy("g", "i", "j").applyInPandas(_with_partner, PARTNERED),
                     "partnered")
    if partnered.isEmpty():
        return partnered.select(F.col("id").alias("a"), F.col("id").alias("b"))
    # rows of one id are copies, and a bucket takes each id once
    wanted = keep(partnered.select("id").distinct(), "wanted")
    with_text = texts.join(_sent(wanted), "id", "left_semi").join(partnered.filter("first"), "id")
    return (with_text.unionByName(partnered.filter("not first")
                                  .withColumn("text", F.lit(None).cast("string")))
            .groupBy("g", "i", "j").applyInPandas(_link_block, "a bigint, b bigint"))


def near_duplicates(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` for each row.

    The component is the smallest id reachable over links; texts that are null or have no word are
    linked with nothing. A row without an id is linked with nothing either and has no component.
    Rows of one id should be copies of each other: the id counts once.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    with temporary(docs.sparkSession) as keep:
        sketches = keep(docs.select("doc_id", sketch(F.col("text")).alias("_s"))
                        .select("doc_id", "_s.*"), "sketches")
        linked = sketches.filter(F.col("set_key").isNotNull() & F.col("doc_id").isNotNull())
        # equal sets have equal signatures
        classes = keep(linked.groupBy("set_key").agg(
            F.min("doc_id").alias("id"), F.first("n_shingles").alias("n_shingles"),
            F.first("signature").alias("signature")), "classes")
        dealt = classes.select("id", F.explode(_buckets("signature")).alias("bucket"))
        shared = keep(dealt.groupBy("bucket").agg(F.min("id").alias("leader"),
                                                  F.count("*").alias("n")).filter("n > 1"), "shared")
        members = keep(dealt.join(_sent(shared), "bucket"), "members")
        pairs = keep(members.filter(F.col("id") != F.col("leader"))
                     .select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct(), "met")
        wanted = keep(pairs.select(F.col("a").alias("id")).unionAll(
            pairs.select(F.col("b").alias("id"))).distinct(), "wanted")
        # only ids that met another have a use for their signatures
        signatures = keep(classes.select("id", "n_shingles", "signature").join(
            _sent(wanted), "id", "left_semi").dropDuplicates(["id"]), "signatures")
        texts = docs.withColumnRenamed("doc_id", "id")
        links = keep(_star_links(pairs, signatures, texts, keep), "star-links")
        parts = keep(components(links, keep), "parts")
        more = keep(_block_links(members, parts, signatures, texts, keep), "block-links")
        if not more.isEmpty():
            parts = components(links.unionAll(more), keep)
        ids = linked.select("doc_id", "set_key").join(classes.select("set_key", "id"), "set_key")
        of_id = ids.join(parts, "id", "left").groupBy("doc_id").agg(
            F.min(F.coalesce("component", "id")).alias("component_id"))
        return materialise(
            sketches.select("doc_id", "n_shingles").join(of_id, "doc_id", "left")
            .withColumn("component_id", F.coalesce("component_id", "doc_id")), "near-duplicates")


def keep_first(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """The rows whose id is the smallest of its component, with the columns they came with; rows
    without an id stay."""
    found = near_duplicates(docs, id_col, text_col)
    # written, so that its number is known: the rows with their texts stay in place if it is small
    gone = _sent(materialise(found.filter("doc_id <> component_id").select(
        F.col("doc_id").alias("_gone")).distinct(), "near-copies"))
    return docs.join(gone, docs[id_col] == gone["_gone"], "left_anti")


def op10_minhash_near_dedup(spark, sf_dir):
    return (near_duplicates(table(spark, sf_dir, "documents"))
            .withColumn("kept", F.col("doc_id") == F.col("component_id")))


OP10_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 3, 2)),
    lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM words WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id
  JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n
  HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (
  SELECT DISTINCT a AS id, a AS other FROM both_ways
  UNION SELECT r.id, l.b FROM reached r JOIN both_ways l ON l.a = r.other),
parts AS (SELECT id, min(other) AS component_id FROM reached GROUP BY id)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles,
  coalesce(p.component_id, d.doc_id) AS component_id,
  coalesce(p.component_id, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN sizes s USING (doc_id) LEFT JOIN parts p ON p.id = d.doc_id"""
