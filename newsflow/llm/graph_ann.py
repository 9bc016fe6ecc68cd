"""Approximate nearest neighbours on robust-pruned directed graphs, one per shard of the vectors.

Nodes are added in growing batches: greedy beam searches on the graph so far propose neighbours, and
pruning with a relaxed distance keeps those that lead in different directions. A query runs a beam
search on every shard; the scores of what it finds are exact.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from newsflow.llm.common import bounded_batches, table
from newsflow.scratch import materialise

SHARD_SIZE, QUERY_BLOCK = 4096, 1024
DEGREE, BEAM, RELAX = 32, 64, 1.2
QUERY_BEAM, STARTS = 128, 16
#: Nodes added, or queries run, in step with each other; and beam entries followed per step.
STRIDE, FOLLOW = 256, 4

GRAPH = "shard int, dim int, members array<array<bigint>>, vectors binary, edges binary"
FOUND = "query_id bigint, vec_id bigint, score double"


def beam_search(unit, edges, queries, beam):
    """Nodes in each query's final beam, nearest first, and all nodes its search followed.

    Starts at the first nodes. ``edges`` has a row per node, filled up with -1. All queries move in step.
    """
    n, m = len(unit), len(queries)
    rows = np.arange(m)[:, None]
    ids, open_ = np.full((m, beam), -1), np.zeros((m, beam), bool)
    far = np.full((m, beam), np.inf)
    starts = min(n, STARTS, beam)
    ids[:, :starts], open_[:, :starts] = np.arange(starts), True
    far[:, :starts] = 2 - 2 * queries @ unit[:starts].T
    seen = np.zeros((m, n + 1), bool)  # the last column stands for -1
    seen[:, :starts] = seen[:, n] = True
    followed = []
    while open_.any():
        pick = np.argsort(~open_, axis=1, kind="stable")[:, :FOLLOW]
        picked = np.where(np.take_along_axis(open_, pick, 1), np.take_along_axis(ids, pick, 1), -1)
        np.put_along_axis(open_, pick, False, 1)
        followed.append(picked)
        near = np.where(picked[:, :, None] >= 0, edges[picked], -1).reshape(m, -1)
        near = np.sort(near, 1)
        fresh = ~seen[rows, near]
        fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
        seen[rows, near] = True
        width = max(1, int(fresh.sum(1).max()))
        order = np.argsort(~fresh, axis=1, kind="stable")[:, :width]
        near, fresh = np.take_along_axis(near, order, 1), np.take_along_axis(fresh, order, 1)
        distance = 2 - 2 * np.einsum("mkd,md->mk", unit[near], queries)
        distance = np.where(fresh, distance, np.inf)
        ids, open_ = np.hstack([ids, np.where(fresh, near, -1)]), np.hstack([open_, fresh])
        far = np.hstack([far, distance])
        best = np.argsort(far, axis=1, kind="stable")[:, :beam]
        ids, open_, far = (np.take_along_axis(a, best, 1) for a in (ids, open_, far))
    return ids, np.hstack(followed)


def prune(unit, nodes, candidates, degree, relax):
    """Neighbours kept for each node of ``nodes``: rows of node numbers filled up with -1.

    The nearest candidate is kept again and again; one goes when a kept one is nearer to it, by the
    factor ``relax``, than the node itself.
    """
    candidates = np.sort(np.where(candidates == nodes[:, None], -1, candidates), 1)
    valid = candidates >= 0
    valid[:, 1:] &= candidates[:, 1:] != candidates[:, :-1]
    width = max(1, int(valid.sum(1).max()))
    order = np.argsort(~valid, axis=1, kind="stable")[:, :width]
    candidates, valid = (np.take_along_axis(a, order, 1) for a in (candidates, valid))
    points = unit[candidates]
    own = 2 - 2 * np.einsum("mkd,md->mk", points, unit[nodes])
    own = np.where(valid, own, np.inf)
    mutual = 2 - 2 * np.matmul(points, points.transpose(0, 2, 1))
    kept, rows = np.full((len(nodes), degree), -1), np.arange(len(nodes))
    for i in range(degree):
        best = own.argmin(1)
        alive = np.isfinite(own[rows, best])
        if not alive.any():
            break
        kept[alive, i] = candidates[rows, best][alive]
        gone = relax ** 2 * mutual[rows, best] <= own
        own[gone] = np.inf
        own[rows, best] = np.inf
    return kept


def _prune_in_chunks(unit, nodes, candidates, degree, relax):
    size = max(1, int(4e6) // candidates.shape[1] ** 2)
    return np.vstack([prune(unit, nodes[i:i + size], candidates[i:i + size], degree, relax)
                      for i in range(0, len(nodes), size)])


def build(vectors, degree=DEGREE, beam=BEAM, relax=RELAX):
    """Edges of the graph over unit vectors. The first nodes, where searches start, should be
    a central one and others in random order, lest a dense cluster holds all starts."""
    n = len(vectors)
    edges, done, step = np.full((n, degree), -1), 1, 1
    while done < n:
        nodes = np.arange(done, min(n, done + step))
        found = np.hstack(beam_search(vectors[:done], edges[:done], vectors[nodes], beam))
        edges[nodes] = _prune_in_chunks(vectors, nodes, found, degree, relax)
        heads, tails = edges[nodes].ravel(), np.repeat(nodes, degree)
        heads, tails = heads[heads >= 0], tails[heads >= 0]
        order = np.argsort(heads, kind="stable")
        heads, tails = heads[order], tails[order]
        targets, begins, counts = np.unique(heads, return_index=True, return_counts=True)
        for wide in np.unique(counts):  # those with as many new edges together
            at = counts == wide
            new = tails[begins[at][:, None] + np.arange(wide)]
            both = np.hstack([edges[targets[at]], new])
            full = (both >= 0).sum(1) > degree
            both[~full] = np.sort(both[~full], 1)[:, ::-1]
            edges[targets[at]] = both[:, :degree]
            if full.any():
                edges[targets[at][full]] = _prune_in_chunks(
                    vectors, targets[at][full], both[full], degree, relax)
        done, step = done + len(nodes), min(2 * step, STRIDE)
    return edges


def units(vectors):
    """Vectors at length one; scaled first, so that squares neither overflow nor vanish."""
    vectors = vectors / np.abs(vectors).max(1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def cosines(a, b):
    """Cosine of each pair of rows, in double precision."""
    a, b = (x.astype(np.float64) for x in (a, b))
    a, b = (x / np.abs(x).max(1, keepdims=True) for x in (a, b))
    dot = np.einsum("nd,nd->n", a, b)
    return dot / (np.sqrt(np.einsum("nd,nd->n", a, a)) * np.sqrt(np.einsum("nd,nd->n", b, b)))


def _build_shard(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("key", ignore_index=True)
    vectors = np.stack(pdf["vector"].to_numpy()).astype(np.float64)
    unit = units(vectors)
    order = np.arange(len(pdf))
    centre = int((unit @ unit.mean(0)).argmax())
    order[[0, centre]] = order[[centre, 0]]
    edges = build(unit[order])
    return pd.DataFrame({"shard": pdf["shard"].iloc[:1], "dim": pdf["dim"].iloc[:1],
                         "members": [[pdf["members"].iloc[i].tolist() for i in order]],
                         "vectors": [vectors[order].tobytes()],
                         "edges": [edges.astype(np.int32).tobytes()]})


def _search_shard(k, beam):
    def search(graph: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(graph) and len(queries):
            row = graph.iloc[0]
            members = row["members"]
            vectors = np.frombuffer(row["vectors"], np.float64).reshape(len(members), -1)
            edges = np.frombuffer(row["edges"], np.int32).reshape(len(members), -1)
            unit = units(vectors)
            sizes = np.array([len(m) for m in members])
            begins, flat = np.cumsum(sizes) - sizes, np.concatenate(members)
            for begin in range(0, len(queries), STRIDE):
                part = queries.iloc[begin:begin + STRIDE]
                raw = np.stack(part["vector"].to_numpy()).astype(np.float64)
                found, _ = beam_search(unit, edges, units(raw), max(beam, k + 1))
                who, at = np.nonzero(found >= 0)
                node = found[who, at]
                score = cosines(raw[who], vectors[node])
                one = np.repeat(np.arange(len(who)), sizes[node])
                nth = np.arange(len(one)) - np.repeat(np.cumsum(sizes[node]) - sizes[node],
                                                      sizes[node])
                hits = pd.DataFrame({"query_id": part["query_id"].to_numpy()[who][one],
                                     "vec_id": flat[begins[node][one] + nth], "score": score[one]})
                hits = hits[hits["query_id"] != hits["vec_id"]]
                hits = hits.sort_values(["query_id", "score", "vec_id"],
                                        ascending=[True, False, True])
                out.append(hits.groupby("query_id").head(k))
        return pd.concat(out) if out else pd.DataFrame(
            {"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"),
             "score": pd.Series(dtype="float64")})
    return search


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id`` and ``vector`` in double precision, of the rows that can be compared."""
    vector = F.col(vector_col)
    fine = (F.col(id_col).isNotNull() & (F.size(vector) > 0)
            & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x)
                       & (F.abs(x) != float("inf")))
            & F.exists(vector, lambda x: x != 0))
    return vectors.filter(F.coalesce(fine, F.lit(False))).select(
        F.col(id_col).cast("bigint").alias("id"), vector.cast("array<double>").alias("vector"))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col="vec_id",
            vector_col="embedding", shard_size: int = SHARD_SIZE, beam: int = QUERY_BEAM) -> DataFrame:
    """The ``k`` nearest of ``vectors`` found for each row of ``queries``, except itself.

    Equal vectors are one node that stands for its k + 1 smallest ids, which is all that an answer
    can hold of them. Vectors of another dimension are never compared; those that are null, zero or
    hold null or non-finite components take no part, as queries neither.
    """
    bounded_batches(vectors.sparkSession)
    all_ = usable(vectors, id_col, vector_col).withColumn("key", F.xxhash64("vector"))
    smallest = Window.partitionBy("key", "vector").orderBy("id")
    nodes = materialise(
        all_.distinct().withColumn("_n", F.row_number().over(smallest)).filter(F.col("_n") <= k + 1)
        .groupBy("key", "vector").agg(F.sort_array(F.collect_list("id")).alias("members")), "nodes")
    asked = materialise(usable(queries, id_col, vector_col).distinct()
                        .withColumnRenamed("id", "query_id"), "queries")
    shards = max(1, -(-nodes.count() // shard_size))
    parts = max(1, -(-asked.count() // QUERY_BLOCK))
    dim = F.size("vector").alias("dim")
    graphs = materialise(
        nodes.select(F.pmod(F.xxhash64("key", F.lit(7)), F.lit(shards)).cast("int").alias("shard"),
                     dim, "key", "vector", "members")
        .repartition(shards, "shard", "dim").groupBy("shard", "dim")
        .applyInPandas(_build_shard, GRAPH), "graphs")
    each_part = graphs.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    each_shard = asked.select(
        F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), dim,
        F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int").alias("part"),
        "query_id", "vector")
    keys = ["shard", "dim", "part"]
    found = (each_part.repartition(shards * parts, *keys).groupBy(*keys)
             .cogroup(each_shard.repartition(shards * parts, *keys).groupBy(*keys))
             .applyInPandas(_search_shard(k, beam), FOUND))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def op7_graph_neighbours(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors.filter(F.col("vec_id") % 50 == 0))
