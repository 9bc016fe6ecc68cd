"""Where the keys of a message table are: key to day, in buckets, with Bloom filters ahead of them.

The index lies beside the data, in a folder that readers of the table skip. Its entries are dealt
into buckets by a hash of the message id. Each write adds blocked Bloom filters of its new entries,
one 64-bit word per row: a key looks up one word of its bucket in each size of filter there is, and
only buckets in which some word holds all of a key's bits are read at all.

The index may know more than the data, never less: entries are written before the rows they are for,
and one for a day that a message has left stays until the next rebuild.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from newsflow.operators.merge import join_on_key, keep_matching
from newsflow.schema import KEY
from newsflow.scratch import drop, matching

FOLDER = "_keys"
#: Buckets of a new index. A table of many millions of messages wants more.
BUCKETS = 16
#: Files of entries per bucket after which a write rebuilds the index.
MOST_FILES = 100
#: Keys that a task writes, about.
KEYS_PER_TASK = 1_000_000
#: Keys per filter word, and bits that a key sets in its word.
KEYS_PER_WORD, BITS = 4, 4
#: The smallest and the most filter words per bucket.
LEAST_WORDS, MOST_WORDS = 16, 1 << 30

ENTRY = T.StructType([T.StructField("source", T.StringType()),
                      T.StructField("message_id", T.StringType()),
                      T.StructField("day", T.DateType()), T.StructField("bucket", T.IntegerType())])
FILTER = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("word", T.LongType()),
                       T.StructField("bits", T.LongType()), T.StructField("words", T.LongType())])


# -- places of the index ---------------------------------------------------------------------

def _named(path: str, name: str) -> int:
    """The number in a folder's name, as in ``bucket=7``."""
    return int(path.split(f"{name}=")[1].split("/")[0])


def _current(spark: SparkSession, store: str) -> tuple[str, int] | None:
    """Folder and number of buckets of the last complete version."""
    root = f"{store.rstrip('/')}/{FOLDER}"
    ready = matching(spark, f"{root}/version=*/buckets=*/filters/_SUCCESS")
    if not ready:
        return None
    last = max(ready, key=lambda path: _named(path, "version"))
    version, buckets = _named(last, "version"), _named(last, "buckets")
    return f"{root}/version={version}/buckets={buckets}", buckets


def exists(spark: SparkSession, store: str) -> bool:
    return _current(spark, store) is not None


# -- entries and filters ---------------------------------------------------------------------

def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("message_id"), F.lit(buckets)).cast("int")


def _mixed() -> Column:
    """A second hash of the id; its parts choose a word and the bits in it."""
    return F.xxhash64("message_id", F.lit("filter"))


def _word(words) -> Column:
    return F.pmod(F.shiftright(_mixed(), 24), words)


def _mask() -> Column:
    places = [F.shiftright(_mixed(), 6 * i).bitwiseAND(F.lit(63)).cast("int") for i in range(BITS)]
    return reduce(lambda a, b: a.bitwiseOR(b), [
        F.call_function("shiftleft", F.lit(1).cast("long"), place) for place in places])


def _write(entries: DataFrame, folder: str, buckets: int, n: int, mode: str) -> None:
    """Write entries, then their filters, sized for ``n`` entries in all."""
    per_bucket = max(1, n // buckets // KEYS_PER_WORD)
    words = min(MOST_WORDS, max(LEAST_WORDS, 1 << (per_bucket - 1).bit_length()))
    dealt = entries.select("source", "message_id", "day", _bucket(buckets).alias("bucket"))
    tasks = min(buckets, 1 + n // KEYS_PER_TASK)
    (dealt.repartition(tasks, "bucket").write.mode(mode).partitionBy("bucket")
     .parquet(f"{folder}/entries"))
    filters = (dealt.select("bucket", _word(F.lit(words)).alias("word"), _mask().alias("mask"))
               .repartition(tasks, "bucket").groupBy("bucket", "word")
               .agg(F.bit_or("mask").alias("bits"))
               .select("bucket", "word", "bits", F.lit(words).cast("long").alias("words")))
    (filters.sortWithinPartitions("bucket", "word").write.mode(mode).partitionBy("words")
     .parquet(f"{folder}/filters"))


def add(spark: SparkSession, store: str, entries: DataFrame) -> None:
    """Add entries (``source``, ``message_id``, ``day``), which may be there already."""
    folder, buckets = _current(spark, store)
    n = entries.count()
    if not n:
        return
    _write(entries, folder, buckets, n, "append")
    if len(matching(spark, f"{folder}/entries/bucket=*/*.parquet")) > MOST_FILES * buckets:
        rebuild(spark, store, _entries(spark, folder).drop("bucket").distinct(), buckets)


def rebuild(spark: SparkSession, store: str, entries: DataFrame, buckets: int | None = None) -> None:
    """A new version of the index from ``entries``; older versions go once it is complete."""
    now = _current(spark, store)
    root = f"{store.rstrip('/')}/{FOLDER}"
    old = matching(spark, f"{root}/version=*")
    version = max((_named(path, "version") for path in old), default=-1) + 1
    buckets = buckets or (now[1] if now else BUCKETS)
    _write(entries, f"{root}/version={version}/buckets={buckets}", buckets, entries.count(),
           "overwrite")
    for path in old:
        drop(spark, path)


def _entries(spark: SparkSession, folder: str, buckets=None) -> DataFrame:
    """All entries, or those of some buckets: other folders are not even listed."""
    if buckets is None:
        return spark.read.schema(ENTRY).parquet(f"{folder}/entries")
    if not buckets:
        return spark.createDataFrame([], ENTRY)
    return spark.read.schema(ENTRY).option("basePath", f"{folder}/entries").parquet(
        *[f"{folder}/entries/bucket={n}" for n in buckets])


# -- lookup ----------------------------------------------------------------------------------

def possible_buckets(spark: SparkSession, store: str, keys: DataFrame) -> list[int]:
    """Buckets in which one of the keys may be: at most as many numbers as there are buckets."""
    folder, buckets = _current(spark, store)
    sizes = sorted({_named(path, "words") for path in matching(spark, f"{folder}/filters/words=*")})
    if not sizes:
        return []
    asked = (keys.select("message_id").distinct()
             .select("message_id", _bucket(buckets).alias("bucket"), _mask().alias("mask"),
                     F.explode(F.array([F.lit(n).cast("long") for n in sizes])).alias("words"))
             .select("bucket", "words", _word(F.col("words")).alias("word"), "mask"))
    filters = spark.read.schema(FILTER).parquet(f"{folder}/filters")
    # both sides grow with the messages, and files say little about what they hold: no broadcast
    met = asked.join(filters.hint("merge"), ["words", "bucket", "word"]).filter(
        F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask"))
    return sorted(row["bucket"] for row in met.select("bucket").distinct().collect())


def lookup(spark: SparkSession, store: str, keys: DataFrame, key_cols=KEY) -> DataFrame:
    """``source``, ``message_id`` and ``day`` of the entries whose ``key_cols`` are among ``keys``.

    ``key_cols`` must hold ``message_id``. Reads only the buckets that the filters leave.
    """
    folder, _ = _current(spark, store)
    near = _entries(spark, folder, possible_buckets(spark, store, keys))
    return keep_matching(near, keys.hint("merge"), key_cols).select("source", "message_id", "day").distinct()


def not_indexed(entries: DataFrame, found: DataFrame) -> DataFrame:
    """Entries that ``found`` does not have."""
    return join_on_key(entries, found, ("source", "message_id", "day"), "left_anti")
