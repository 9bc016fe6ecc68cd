"""Centroid clustering with Ptolemaic lower bounds, in whole numbers.

For a vector x, a centroid c and two pivots p and s, Ptolemy's inequality gives
d(x, c) >= |d(x, p) d(c, s) - d(x, s) d(c, p)| / d(p, s). The vectors' distances to the pivots are
cached with them, once for all rounds. In each, a vector's centroids are taken in the order of their
bounds, and those whose bound is above the best distance so far are left out; the others are
measured exactly. Bounds are rounded down by more than their arithmetic can err.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from newsflow.llm.common import bounded_batches, table
from newsflow.scratch import materialise, temporary

K, ROUNDS, DIM, SCALE, SEED = 40, 5, 64, 256, "2:"
PIVOTS = 8
#: Whole components up to this give squared distances that fit in 64 bits.
LIMIT = 1 << 27
#: Vectors compared at a time, and parts of a bound taken off for rounding.
ROWS, SLACK = 2048, 2.0 ** -46
NO_LONG = 1 << 63


def distances(a, b):
    """Squared distance of each pair of rows, exactly."""
    apart = a - b
    return np.einsum("nd,nd->n", apart, apart)


def pivots_among(vectors, n=PIVOTS):
    """Up to ``n`` different ones of the vectors: the first, then each time the farthest from all."""
    chosen, far = [0], distances(vectors, vectors[:1])
    while len(chosen) < n and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, distances(vectors, vectors[chosen[-1]:chosen[-1] + 1]))
    return vectors[chosen]


def pivot_pairs(pivots):
    """Each pivot with the next and with the one after it, and how far apart they are."""
    n = len(pivots)
    pairs = sorted({tuple(sorted((i, (i + step) % n))) for i in range(n) for step in (1, 2)
                    if i != (i + step) % n})
    p, s = (np.array([pair[i] for pair in pairs], np.int64) for i in (0, 1))
    return p, s, np.sqrt(distances(pivots[p], pivots[s]).astype(np.float64))


def to_pivots(vectors, pivots):
    """Distance of each vector to each pivot."""
    return np.sqrt(np.stack([distances(vectors, p[None]) for p in pivots], 1).astype(np.float64))


def bounds(cached, of_centroids, pairs):
    """A lower bound for each vector and centroid, from distances to the pivots."""
    best = np.zeros((len(cached), len(of_centroids)))
    for p, s, apart in zip(*pairs):
        one = cached[:, p, None] * of_centroids[None, :, s]
        other = cached[:, s, None] * of_centroids[None, :, p]
        bound = (np.abs(one - other) - SLACK * (one + other)) / (apart * (1 + SLACK))
        np.maximum(best, bound, out=best)
    return best


def assign(vectors, cached, centroids, pivots):
    """Nearest centroid of each vector, of equally near ones the first, its squared distance, and
    how many distances were measured."""
    low = bounds(cached, to_pivots(centroids, pivots), pivot_pairs(pivots))
    low *= low * (1 - SLACK)
    order = np.argsort(low, 1, kind="stable")
    cluster = order[:, 0].copy()
    nearest = distances(vectors, centroids[cluster])
    alive, measured = np.arange(len(vectors)), len(vectors)
    for i in range(1, len(centroids)):
        other = order[alive, i]
        go_on = low[alive, other] <= nearest[alive] * (1 + SLACK)
        alive, other = alive[go_on], other[go_on]
        if not len(alive):
            break
        distance = distances(vectors[alive], centroids[other])
        measured += len(alive)
        best = (distance < nearest[alive]) | (distance == nearest[alive]) & (other < cluster[alive])
        cluster[alive[best]], nearest[alive[best]] = other[best], distance[best]
    return cluster, nearest, measured


def usable(vectors: DataFrame, id_col="vec_id", vector_col="embedding", dim=DIM,
           scale=SCALE) -> DataFrame:
    """``id`` and ``v``, the whole components, of vectors with ``dim`` finite ones. ``v`` is null
    where one is too large for 64-bit distances."""
    vector = F.col(vector_col)
    fine = (F.size(vector) == dim) & F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * scale))
    small = F.forall(vector, lambda x: F.abs(x.cast("double") * scale) < LIMIT)
    return vectors.filter(F.coalesce(fine, F.lit(False))).select(
        F.col(id_col).alias("id"),
        F.when(small, F.transform(whole, lambda x: x.cast("int"))).alias("v"))


def _matrix(column):
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1)


def _with_cache(pivots):
    def add(batches):
        for batch in batches:
            if batch.num_rows:
                flat = to_pivots(_matrix(batch.column(1)).astype(np.int64), pivots)
                ends = pa.array(np.arange(len(flat) + 1) * flat.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1),
                     pa.ListArray.from_arrays(ends, pa.array(flat.ravel()))], names=["id", "v", "p"])
    return add


def _blocks(batches):
    for batch in batches:
        for begin in range(0, batch.num_rows, ROWS):
            part = batch.slice(begin, ROWS)
            yield part.column(0), _matrix(part.column(1)).astype(np.int64), _matrix(part.column(2))


def _sums(centroids, pivots):
    def add_up(batches):
        total = np.zeros(centroids.shape, np.int64)
        counts = np.zeros(len(centroids), np.int64)
        for _, vectors, cached in _blocks(batches):
            cluster, _, _ = assign(vectors, cached, centroids, pivots)
            order = np.argsort(cluster, kind="stable")
            which, begins = np.unique(cluster[order], return_index=True)
            total[which] += np.add.reduceat(vectors[order], begins)
            counts += np.bincount(cluster, minlength=len(counts))
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pylist(
            [{"cluster": int(i), "n": int(counts[i]), "total": total[i].tolist()} for i in at],
            pa.schema([("cluster", pa.int32()), ("n", pa.int64()),
                       ("total", pa.list_(pa.int64()))]))
    return add_up


def _nearest(centroids, pivots):
    def find(batches):
        for ids, vectors, cached in _blocks(batches):
            cluster, distance, _ = assign(vectors, cached, centroids, pivots)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(cluster.astype(np.int32)), pa.array(distance)],
                names=["id", "cluster", "distance"])
    return find


def _moved(cached: DataFrame, centroids, pivots):
    """The centroids after one more round. A task gives one sum per cluster, and a number per
    cluster and component comes back."""
    sums = (cached.mapInArrow(_sums(centroids, pivots), "cluster int, n bigint, total array<bigint>")
            .select("cluster", "n", F.posexplode("total").alias("place", "total"))
            .groupBy("cluster", "place")
            .agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")))
    out = centroids.copy()
    for row in sums.collect():
        out[row["cluster"], row["place"]] = int(row["total"]) // row["n"]
    return out


def cluster(vectors: DataFrame, id_col="vec_id", vector_col="embedding", k: int = K,
            rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: str = SEED) -> DataFrame:
    """``id_col``, ``cluster``, ``distance``, ``cluster_inertia``, ``inertia`` and
    ``centroid_sha256`` of each vector that takes part.

    The first centroids are the ``k`` vectors whose ids hash lowest with ``seed``, or all where there
    are fewer; a row without an id never is one. Rows of one id count each. Vectors that are null, of
    another length or not finite have no row. Those with a component of 2 ** 27 / ``scale`` or more
    take no part, for their distances have no 64 bits: their rows hold nulls. Sums that pass 64 bits
    are null as well.
    """
    bounded_batches(vectors.sparkSession)
    spark = vectors.sparkSession
    kept = usable(vectors, id_col, vector_col, dim, scale)
    id_type = kept.schema["id"].dataType
    digest = F.sha2(F.concat(F.lit(seed), F.col("id").cast("string")), 256)
    first = kept.filter("v IS NOT NULL AND id IS NOT NULL").orderBy(digest, "v").limit(k).collect()
    result = T.StructType([T.StructField("id", id_type), T.StructField("cluster", T.IntegerType()),
                           T.StructField("distance", T.LongType())])
    per_cluster = T.StructType([T.StructField("cluster", T.IntegerType()),
                                T.StructField("cluster_inertia", T.LongType()),
                                T.StructField("inertia", T.LongType()),
                                T.StructField("centroid_sha256", T.StringType())])
    no_part = kept.filter("v IS NULL" if first else "true").select(
        "id", F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("long").alias("distance"))
    assigned, rows = no_part, []
    if first:
        centroids = np.array([row["v"] for row in first], np.int64)
        pivots = pivots_among(centroids)
        with temporary(spark) as keep:
            cached = keep(kept.filter("v IS NOT NULL").mapInArrow(_with_cache(pivots), T.StructType(
                [T.StructField("id", id_type), T.StructField("v", T.ArrayType(T.IntegerType())),
                 T.StructField("p", T.ArrayType(T.DoubleType()))])), "cached")
            for _ in range(rounds):
                centroids = _moved(cached, centroids, pivots)
            assigned = materialise(cached.mapInArrow(_nearest(centroids, pivots), result),
                                   "assigned")
        sums = {row["cluster"]: int(row["s"]) for row in assigned.groupBy("cluster").agg(
            F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
        digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()
                   for c in centroids.tolist()]

        def in_long(n):
            return n if n < NO_LONG else None
        rows = [(i, in_long(s), in_long(sum(sums.values())), digests[i]) for i, s in sums.items()]
        assigned = assigned.unionAll(no_part)
    return (assigned.join(F.broadcast(spark.createDataFrame(rows, per_cluster)), "cluster", "left")
            .select(F.col("id").alias(id_col), *result.names[1:], *per_cluster.names[1:]))


def op12_ptolemaic_clusters(spark, sf_dir):
    return cluster(table(spark, sf_dir, "embeddings"))


def _sql():
    """The rounds one after the other, each component a row."""
    def nearest(name, centroids):
        return f"""{name} AS MATERIALIZED (
  SELECT vec_id, arg_min(c, (d, c)) AS cluster, min(d) AS distance FROM (
    SELECT v.vec_id, c.c, sum((v.x - c.x) * (v.x - c.x))::BIGINT AS d
    FROM v JOIN {centroids} c USING (place) GROUP BY v.vec_id, c.c) GROUP BY vec_id)"""
    steps = [f"""v AS MATERIALIZED (
  SELECT vec_id, unnest(range({DIM})) AS place,
    unnest(list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT)) AS x
  FROM embeddings WHERE len(embedding) = {DIM}
    AND len(list_filter(embedding, lambda x: isfinite(x))) = {DIM})""", f"""c0 AS MATERIALIZED (
  SELECT c, place, x FROM v JOIN (
    SELECT vec_id, row_number() OVER (ORDER BY sha256('{SEED}' || vec_id)) - 1 AS c
    FROM (SELECT DISTINCT vec_id FROM v) ORDER BY c LIMIT {K}) USING (vec_id))"""]
    for i in range(ROUNDS):
        steps += [nearest(f"a{i}", f"c{i}"), f"""c{i + 1} AS MATERIALIZED (
  SELECT o.c, o.place, coalesce((n.s - ((n.s % n.n) + n.n) % n.n) // n.n, o.x)::BIGINT AS x
  FROM c{i} o LEFT JOIN (
    SELECT a.cluster AS c, v.place, sum(v.x)::BIGINT AS s, count(*) AS n
    FROM a{i} a JOIN v USING (vec_id) GROUP BY a.cluster, v.place) n
  ON n.c = o.c AND n.place = o.place)"""]
    steps.append(nearest("final", f"c{ROUNDS}"))
    return "WITH " + ",\n".join(steps) + f"""
SELECT f.vec_id, f.cluster::INTEGER AS cluster, f.distance,
  (sum(f.distance) OVER (PARTITION BY f.cluster))::BIGINT AS cluster_inertia,
  (sum(f.distance) OVER ())::BIGINT AS inertia, h.centroid_sha256
FROM final f JOIN (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY place)) AS centroid_sha256
  FROM c{ROUNDS} GROUP BY c) h ON h.c = f.cluster"""


OP12_SQL = _sql()
