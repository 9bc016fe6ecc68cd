"""Connected components of a table of links, by alternating large and small stars."""

from pyspark.sql import DataFrame, functions as F

from newsflow.scratch import materialise


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("least"))
    return (both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), "least")
            .toDF("a", "b").filter("a <> b").distinct())


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("least"))
    joined = down.join(least, "a")
    return (joined.select(F.col("b").alias("a"), F.col("least").alias("b"))
            .unionAll(least.toDF("a", "b")).filter("a <> b").distinct())


def _print(links: DataFrame):
    """Number and checksum of the links."""
    row = links.agg(F.count("*").alias("n"),
                    F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]


def components(links: DataFrame, keep=materialise) -> DataFrame:
    """``id`` and ``component``, the smallest id reachable, of all that ``links`` (a, b) join.

    Each round is written to the shared folder, by ``keep``. A node's smallest neighbour is aggregated before
    rows meet, and a hot node's links join its one value, which Spark splits where it is skewed.
    """
    links = keep(links.filter("a <> b").distinct(), "links")
    seen = _print(links)
    while seen[0]:
        links = keep(_small_star(_large_star(links)), "links")
        now = _print(links)
        if now == seen:
            break
        seen = now
    return links.select(F.col("a").alias("id"), F.col("b").alias("component")).unionAll(
        links.select(F.col("b").alias("id"), F.col("b").alias("component"))).distinct()
