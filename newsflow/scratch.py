"""Intermediate tables in the folder the cluster shares between its nodes."""

import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_open = threading.local()


def _folder(spark: SparkSession) -> str:
    """This application's folder below ``spark.checkpoint.dir``; where that is unset, below the
    warehouse, unless that is on the driver's own disk while executors are elsewhere."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        warehouse = spark.conf.get("spark.sql.warehouse.dir", None)
        if not warehouse:
            raise ValueError("set spark.checkpoint.dir to a folder shared by all nodes")
        master = spark.conf.get("spark.master", None) or "local"
        if warehouse.startswith(("file:", "/")) and not (master == "local"
                                                         or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir: the warehouse is on a local disk")
        root = warehouse.rstrip("/") + "/_scratch"
    return f"{root.rstrip('/')}/newsflow/{spark.conf.get('spark.app.id')}"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the application's folder."""
    return f"{_folder(spark)}/{label}-{uuid.uuid4().hex}"


def matching(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a pattern, in order."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(status.getPath().toString() for status in files.globStatus(path) or [])


def drop(spark: SparkSession, path: str) -> None:
    """Delete a table, once nothing reads it any more."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def drop_scratch(spark: SparkSession) -> None:
    """Delete all of the application's intermediate tables, once its results are stored."""
    drop(spark, _folder(spark))


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and return the written table.

    Used where a result is costly or would differ when computed again (model
    answers, positions within a range partitioning) but is read several times.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    for paths in getattr(_open, "scopes", [])[-1:]:
        paths.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scoped(spark: SparkSession):
    """Delete at the end of the block what :func:`materialise` wrote in it, in this thread; for
    jobs whose results are stored by then."""
    paths = []
    scopes = _open.__dict__.setdefault("scopes", [])
    scopes.append(paths)
    try:
        yield
    finally:
        scopes.pop()
        for path in paths:
            drop(spark, path)


@contextmanager
def temporary(spark: SparkSession):
    """Gives a :func:`materialise` whose tables are deleted at the end of the block."""
    paths = []

    def keep(df: DataFrame, label: str) -> DataFrame:
        path = scratch_path(spark, label)
        paths.append(path)
        df.write.option("compression", "zstd").parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    try:
        yield keep
    finally:
        for path in paths:
            drop(spark, path)
