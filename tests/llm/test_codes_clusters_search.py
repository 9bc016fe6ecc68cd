"""Direct codes, centroid clusters and word search against brute force, and their edge cases."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from newsflow.llm import centroids, lexical, token_store
from newsflow.scratch import scratch_path

SF = "/root/testdata/sf0.001"
WORD_BPE = str(public_tokenizers.path("word_bpe_49k.json"))


# -- direct codes

@pytest.mark.parametrize("n", [0, 1, 63, 64, 511, 512, 513, 70000])
@pytest.mark.parametrize("most", [1, 256, 70000, 1 << 32])
def test_codes_at_any_place(n, most):
    draw = np.random.default_rng(n)
    ids = draw.integers(0, most, n, np.uint64).astype(np.uint32)
    codes = token_store.Codes(token_store.encode_levels(ids))
    assert (codes.between(0, n) == ids).all()
    places = draw.integers(0, n, 500) if n else np.zeros(0, np.int64)
    assert (codes.at(places) == ids[places]).all()


def test_encoder_equals_the_library():
    draw = np.random.default_rng(5)
    parts = ["a", "B", "Σ", " ", "\n", "\t", "\x0b", "\x1c", "\x85", "\xa0", " ", "é", "é",
             "<|endoftext|>", "'s", "1", "!", ",", "中", "İ", "ß", "\x00", "क़"]
    library, encode = Tokenizer.from_file(WORD_BPE), token_store.Encoder(WORD_BPE)
    for _ in range(4000):
        text = "".join(draw.choice(parts, draw.integers(0, 14)))
        assert encode(text) == np.array(
            library.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), repr(text)


def want_tokens(rows):
    """(id, start, n, crc) of rows in the order of their ids, those of one id in any order."""
    library, start, out = Tokenizer.from_file(WORD_BPE), 0, []
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("segment", [1, 5000, 1 << 20])
def test_token_files(spark, edge_docs, segment):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").filter(
        "doc_id > 12").unionByName(edge_docs.select("doc_id", "text"))
    path = scratch_path(spark, "tokens")
    token_store.write_tokens(docs, path, WORD_BPE, segment=segment)
    got = [tuple(r) for r in token_store.documents(spark, path).collect()]
    want = want_tokens([tuple(r) for r in docs.collect()])
    assert sorted(got, key=lambda r: r[1]) == want
    library = Tokenizer.from_file(WORD_BPE)
    in_order = sorted((tuple(r) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    ids = np.concatenate([np.array([*library.encode(t or "", add_special_tokens=False).ids, 1])
                          for _, t in in_order])
    places = [*range(0, len(ids), 997), len(ids) - 1, len(ids), -1, 0]
    at = token_store.tokens_at(spark, path, spark.createDataFrame(
        [(p, "x") for p in places], "place long, segment string"))
    assert at.columns == ["place", "segment", "id"]
    assert sorted((r.place, -1 if r.id is None else r.id) for r in at.collect()) == sorted(
        (p, int(ids[p]) if 0 <= p < len(ids) else -1) for p in places)


def test_token_files_edges(spark, no_docs):
    path = scratch_path(spark, "tokens")
    token_store.write_tokens(no_docs, path, WORD_BPE)
    assert token_store.documents(spark, path).count() == 0
    long = spark.createDataFrame([(2, "word " * 400_000), (1, "x" * 300_000), (3, " " * 2_000_000)],
                                 "doc_id long, text string")
    path = scratch_path(spark, "tokens")
    token_store.write_tokens(long, path, WORD_BPE)
    rows = {r.doc_id: (r.start, r.n_tokens) for r in token_store.documents(spark, path).collect()}
    first = len(Tokenizer.from_file(WORD_BPE).encode("x" * 300_000, add_special_tokens=False).ids) + 1
    assert rows == {1: (0, first), 2: (first, 400_001), 3: (first + 400_001, 1)}
    twice = spark.createDataFrame([(1, f"w{i}") for i in range(50)] * 2, "doc_id long, text string")
    path = scratch_path(spark, "tokens")
    token_store.write_tokens(twice, path, WORD_BPE, segment=7)
    rows = sorted((r.start, r.n_tokens) for r in token_store.documents(spark, path).collect())
    assert [s for s, _ in rows] == list(np.cumsum([0] + [n for _, n in rows[:-1]]))


# -- clusters

def brute_clusters(rows, k, rounds, dim):
    whole = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows
             if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in whole
                   if i is not None)[:k]
    centres = [v for _, v in first]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centres))
    for _ in range(rounds):
        groups = {}
        for _, v in whole:
            groups.setdefault(nearest(v)[1], []).append(v)
        for n, members in groups.items():
            centres[n] = [sum(x) // len(members) for x in zip(*members)]
    found = [(i, *nearest(v)) for i, v in whole]
    sums = Counter()
    for _, d, n in found:
        sums[n] += d
    return sorted([(i, n, d, sums[n], sum(sums.values()),
                    hashlib.sha256(",".join(map(str, centres[n])).encode()).hexdigest())
                   for i, d, n in found], key=str)


def got_clusters(vectors, **options):
    return sorted(map(tuple, centroids.cluster(vectors, **options).collect()), key=str)


def test_clusters_match_brute_force(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert got_clusters(table, rounds=2) == brute_clusters(rows, 40, 2, 64)


def test_clusters_edges(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [0.5, 0.0]), (3, [0.5, 0.0]), (4, None), (5, [1.0]),
            (6, [nan, 0.0]), (7, [inf, 0.0]), (8, [None, 0.0]), (9, []), (10, [-0.001, 300.0]),
            (None, [9.0, 9.0]), (11, [0.5, 0.0])]
    table = spark.createDataFrame([(*r, 1, [1]) for r in rows],
                                  "vec_id long, embedding array<double>, cluster int, v array<int>")
    for k in (1, 3, 40):
        assert got_clusters(table, k=k, dim=2) == brute_clusters(rows, k, 5, 2)
    assert got_clusters(table.limit(0)) == []
    far = spark.createDataFrame([(1, [1e300, 0.0]), (2, [0.0, 0.0])],
                                "vec_id long, embedding array<double>")
    by_id = {r[0]: r for r in got_clusters(far, dim=2)}
    assert by_id[1] == (1, None, None, None, None, None) and by_id[2][1:3] == (0, 0)
    assert got_clusters(far.filter("vec_id = 1"), dim=2) == [by_id[1]]
    one = spark.createDataFrame([(i, [2.0, 1.0]) for i in range(9)],
                                "vec_id long, embedding array<double>")
    assert {r[1:3] for r in got_clusters(one, dim=2)} == {(0, 0)}


@pytest.mark.parametrize("spread", [1, 1000, centroids.LIMIT])
def test_bounds_never_pass_distances_and_prune(spread):
    draw = np.random.default_rng(1)
    centres = draw.integers(-spread, spread + 1, (40, 8))
    vectors = np.clip(np.repeat(centres, 25, 0) + draw.integers(-spread // 20, spread // 20 + 1,
                                                               (1000, 8)), -spread, spread)
    pivots = centroids.pivots_among(centres)
    cached = centroids.to_pivots(vectors, pivots)
    low = centroids.bounds(cached, centroids.to_pivots(centres, pivots),
                           centroids.pivot_pairs(pivots))
    exact = ((vectors[:, None].astype(object) - centres[None].astype(object)) ** 2).sum(2)
    assert all(int(b) ** 2 <= d for b, d in zip(low.ravel().astype(object), exact.ravel()))
    cluster, nearest, measured = centroids.assign(vectors, cached, centres, pivots)
    assert (nearest == exact.min(1)).all() and (cluster == exact.argmin(1)).all()
    assert spread == 1 or measured < 0.5 * exact.size


# -- word search

def brute_ranks(docs, items, k):
    def terms(text):
        found = re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")
        return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in found]
    counted = [(d, Counter(terms(t)), len(terms(t))) for d, t in docs if terms(t)]
    n_docs, n_terms = len(counted), sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, tf, n in counted:
            m = 75 + 25 * n * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                        * (1_000_000_000 * tf[t] // (1000 * tf[t] + 12 * m)) for t in terms(text))
            if score > 0 and d is not None:
                scores.append((-score, d))
        out += [(item, i + 1, d, -s) for i, (s, d) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def got_ranks(docs, items, **options):
    return sorted(map(tuple, lexical.rank_documents(docs, items, **options).collect()), key=str)


@pytest.mark.parametrize("small", [False, True])
def test_ranks_match_brute_force(spark, edge_docs, monkeypatch, small):
    if small:  # many blocks of items, many batches of documents, and a first part of some size
        for name, value in (("ITEMS", 7), ("DENSE_BYTES", 1), ("FAN", 3), ("FIRST", 4)):
            monkeypatch.setattr(lexical, name, value)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(
        edge_docs.select((F.col("doc_id") + 1000).alias("doc_id"), "text"))
    items = spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text")
    items = items.unionByName(spark.createDataFrame(
        [(900, None), (901, ""), (902, "word1 word2 one ONE"), (903, "Über <|turn|> 中文"),
         (904, "not_there"), (None, "three")], items.schema))
    rows, asked = ([tuple(r) for r in df.collect()] for df in (docs, items))
    assert got_ranks(docs, items, k=5) == brute_ranks(rows, asked, 5)


def test_ranks_edges(spark, edge_docs, no_docs):
    items = spark.createDataFrame([(1, "one two three", 7), (1, "one two three", 7)],
                                  "item_id long, text string, doc int")
    got = got_ranks(edge_docs, items)
    assert [(r[1], r[2]) for r in sorted(got, key=lambda r: r[1])[:3]] == [(1, 8), (2, 9), (3, 9)]
    assert got_ranks(no_docs, items) == [] and got_ranks(edge_docs, items.limit(0)) == []
    empty = spark.createDataFrame([(1, None), (2, " .,-")], "doc_id long, text string")
    assert got_ranks(empty, items) == []
    ties = spark.createDataFrame([(i, "same words here") for i in range(100, 0, -1)]
                                 + [(i, "other") for i in range(200, 400)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "same words " * 5000)], "item_id long, text string")
    assert [r[2] for r in sorted(got_ranks(ties, asked), key=lambda r: r[1])] == list(range(1, 21))


def test_node_pairs_are_pruned():
    draw = np.random.default_rng(2)
    items = np.zeros((64, 640), np.int64)
    for i in range(64):  # four groups of items, with terms of their own
        items[i, i % 4 * 160 + draw.integers(0, 160, 50)] = draw.integers(1, 9000, 50)
    docs = np.zeros((2048, 640), np.int64)
    for i in range(2048):
        at = draw.integers(0, 4) * 160 + draw.integers(0, 160, 5)
        docs[i, at] = draw.integers(1, 10 ** 6, 5)
    search = lexical.Search(lexical.Items(items), np.ones(64), 5)
    for begin in range(0, 2048, 512):
        search.add(np.arange(begin, begin + 512), docs[begin:begin + 512])
    exact = docs @ items.T
    for item, (score, doc) in zip(search.items.order, search.best):
        order = np.lexsort((np.arange(2048), -exact[:, item]))[:5]
        assert (doc == order).all() and (score == exact[order, item]).all()
    assert search.scored < 0.4 * exact.size
