"""Token ids on disk as directly addressable codes.

An id is split into chunks of eight bits, lowest first. The first level holds the first chunk of all
ids, the next level the second chunk of those that have one, and so on; a level's bitmap says which
of its ids go on, and a directory of ranks counts those before each 512 bits. So the token at any
place is read with one rank per level, and no block is decoded.

A file is a table of segments, each some documents long and readable by itself: places of its
documents, then its levels. Segments are numbered within parts, and parts in the order of documents.
"""

import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from newsflow.llm.bpe import _byte_letters
from newsflow.llm.common import bounded_batches, cached, table, trim
from newsflow.scratch import scratch_path

END_ID = 1
#: Tokens after which a segment ends with its last document, and bits between two known ranks.
SEGMENT, RANK_BITS = 1 << 18, 512
#: Bytes of runs and their ids that a worker remembers, with what a dictionary takes for each.
REMEMBER_BYTES, ENTRY_BYTES = 256 << 20, 170
#: Places read at a time.
READ = 1 << 16

SEGMENTS = T.StructType([
    T.StructField("part", T.IntegerType()), T.StructField("segment", T.IntegerType()),
    T.StructField("first", T.LongType()), T.StructField("n", T.LongType()),
    T.StructField("doc_ids", T.ArrayType(T.LongType())),
    T.StructField("doc_starts", T.ArrayType(T.LongType())),
    *[T.StructField(c, T.ArrayType(T.BinaryType())) for c in ("chunks", "bitmaps", "ranks")]])
DOCUMENT = T.StructType([
    T.StructField("part", T.IntegerType()), T.StructField("doc_id", T.LongType()),
    T.StructField("place", T.LongType()), T.StructField("n_tokens", T.LongType()),
    T.StructField("ids_crc32", T.LongType())])


# -- codes -----------------------------------------------------------------------------------

def encode_levels(ids):
    """Chunks, continuation bitmap and rank directory of each level; the last has no bitmap."""
    left, levels = np.asarray(ids, np.uint32), []
    while True:
        chunk, left = (left & np.uint32(0xFF)).astype(np.uint8), left >> np.uint32(8)
        goes_on = left > 0
        if not goes_on.any():
            return [*levels, (chunk.tobytes(), b"", b"")]
        bits = np.packbits(goes_on, bitorder="little")
        bits = np.r_[bits, np.zeros(-len(bits) % (RANK_BITS // 8), np.uint8)]
        ones = np.bitwise_count(bits.reshape(-1, RANK_BITS // 8)).sum(1, dtype=np.int64)
        levels.append((chunk.tobytes(), bits.tobytes(), (np.cumsum(ones) - ones).astype("<u4").tobytes()))
        left = left[goes_on]


class Codes:
    """The ids of a segment, by place."""

    def __init__(self, levels):
        self.levels = []
        for chunks, bitmap, ranks in levels:
            self.levels.append((np.frombuffer(chunks, np.uint8), np.frombuffer(bitmap, "<u8"),
                                np.frombuffer(ranks, "<u4")))

    @staticmethod
    def _rank(words, ranks, at):
        """Set bits before each place: those the directory knows, and those of the words between."""
        count = ranks[at // RANK_BITS].astype(np.int64)
        word, inside = at >> 6, at & (RANK_BITS - 1)
        first = word & ~(RANK_BITS // 64 - 1)
        for i in range(RANK_BITS // 64 - 1):
            before = np.flatnonzero(inside >= 64 * (i + 1))
            if not len(before):
                break
            count[before] += np.bitwise_count(words[first[before] + i])
        low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return count + np.bitwise_count(words[word] & low)

    def at(self, places):
        """Ids at an array of places, in any order."""
        at = np.asarray(places, np.int64)
        ids, alive = np.zeros(len(at), np.uint32), np.arange(len(at))
        for level, (chunks, words, ranks) in enumerate(self.levels):
            ids[alive] |= chunks[at].astype(np.uint32) << np.uint32(8 * level)
            if not len(words):
                break
            goes_on = words[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1) > 0
            alive, at = alive[goes_on], self._rank(words, ranks, at[goes_on])
            if not len(at):
                break
        return ids

    def between(self, begin, end):
        """Ids at the places of a range."""
        return np.concatenate([np.zeros(0, np.uint32), *[
            self.at(np.arange(i, min(i + READ, end))) for i in range(begin, end, READ)]])


# -- ids -------------------------------------------------------------------------------------

def _latin(raw):
    """A word of Latin letters, lower-cased; None for anything else.

    Letters of these ranges are composed already, and each has one lower-case letter.
    """
    if raw.isascii():
        return raw.lower() if raw.isalpha() else None
    word = raw.decode()
    word = word.lower() if max(word) < "\u0250" else ""
    return word.encode() if word.isalpha() else None


class Encoder(dict):
    """Ids by the tokenizers library, as little-endian unsigned 32-bit bytes.

    The vocabulary drops white space and joins nothing over it, so a text's ids are those of its
    runs of other characters, one after the other. A run met before is not encoded again, and a run
    that is one word, with or without marks, skips the library's normaliser and word pattern. When
    the entries take too many bytes, those used again since the last time stay.
    """

    # What separates runs for the vocabulary; str.split() would take more.
    BLANK = "\t\n\v\f\r "
    #: Marks that often follow a word; the vocabulary's word pattern parts letters from them.
    MARKS = b".,;:!?)"

    def __init__(self, path):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.letters = {byte: letter for byte, letter in _byte_letters().items() if byte > 127}
        self.to_blank = bytes.maketrans(self.BLANK.encode(), b" " * len(self.BLANK))
        self.older, self.size = {}, 0

    def _encode(self, run):
        body = run.rstrip(self.MARKS)
        word = _latin(body) if body else None
        if word is None:
            ids = self.tokenizer.encode(run.decode(), add_special_tokens=False).ids
        elif word != run:
            return self[word] + self[run[len(body):]]
        else:
            symbols = word.decode("latin-1").translate(self.letters)
            ids = [token.id for token in self.model.tokenize(symbols)]
        return np.array(ids, "<u4").tobytes()

    def __missing__(self, run):
        found = self.older.get(run)
        if found is None:
            found = self._encode(run) if run else b""
        self[run] = found
        self.size += ENTRY_BYTES + len(run) + len(found)
        return found

    def __call__(self, text):
        """Ids of a text."""
        if self.size > REMEMBER_BYTES // 2:
            self.older, self.size = dict(self), 0
            self.clear()
        return b"".join([self[run] for run in text.encode().translate(self.to_blank).split(b" ")])


def _segments(path, end_id, segment):
    """Turn sorted rows into segments, one part per task."""
    def write(batches):
        from pyspark import TaskContext

        encode = cached(("ids", path), lambda: Encoder(path), large=True)
        part, end = TaskContext.get().partitionId(), np.array([end_id], "<u4").tobytes()
        docs, starts, ids, n, first, number = [], [], [], 0, 0, 0

        def close():
            levels = encode_levels(np.frombuffer(b"".join(ids), "<u4"))
            return pa.RecordBatch.from_pylist([{
                "part": part, "segment": number, "first": first, "n": n, "doc_ids": docs,
                "doc_starts": starts, "chunks": [x[0] for x in levels],
                "bitmaps": [x[1] for x in levels], "ranks": [x[2] for x in levels]}], ARROW)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = encode(text.as_py() or "") + end
                docs.append(doc)
                starts.append(n)
                ids.append(own)
                n += len(own) // 4
                if n >= segment:
                    yield close()
                    first, number, docs, starts, ids, n = first + n, number + 1, [], [], [], 0
        if docs:
            yield close()
        trim()
    return write


ARROW = pa.schema([("part", pa.int32()), ("segment", pa.int32()), ("first", pa.int64()),
                   ("n", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
                   ("doc_starts", pa.list_(pa.int64())), ("chunks", pa.list_(pa.binary())),
                   ("bitmaps", pa.list_(pa.binary())), ("ranks", pa.list_(pa.binary()))])


def write_tokens(docs: DataFrame, path: str, vocabulary: str, id_col="doc_id", text_col="text",
                 end_id: int = END_ID, segment: int = SEGMENT) -> None:
    """Write the ids of all texts to ``path``, in ascending order of document ids.

    Each document ends with ``end_id``; a null text counts as empty and is the end id alone. Rows
    without an id come first; rows of one id stay one after the other, in an order by their texts. A
    text may be of any length: it is a segment by itself if it is long. Rows of one id are spread
    over parts too, however many they are.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).alias("text"),
                       F.xxhash64(text_col).alias("_h"))
    (rows.repartitionByRange("doc", "_h").sortWithinPartitions("doc", "_h").select("doc", "text")
     .mapInArrow(_segments(vocabulary, end_id, segment), SEGMENTS).write.parquet(path))


# -- reading ---------------------------------------------------------------------------------

def scan_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The segments of a token file."""
    return spark.read.schema(SEGMENTS).parquet(path)


def _codes(row):
    return Codes(list(zip(row["chunks"], row["bitmaps"], row["ranks"])))


def _documents(batches):
    for batch in batches:
        for row in batch.to_pylist():
            codes, starts = _codes(row), row["doc_starts"]
            ends = [*starts[1:], row["n"]]
            sums = [zlib.crc32(codes.between(a, b).astype("<u4").tobytes())
                    for a, b in zip(starts, ends)] if row["n"] > READ * len(starts) else None
            if sums is None:  # short documents: read the segment's places in larger pieces
                raw = codes.between(0, row["n"]).astype("<u4").tobytes()
                sums = [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(starts, ends)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["part"]] * len(starts), pa.int32()),
                 pa.array(row["doc_ids"], pa.int64()),
                 pa.array([row["first"] + s for s in starts], pa.int64()),
                 pa.array([b - a for a, b in zip(starts, ends)], pa.int64()),
                 pa.array(sums, pa.int64())], names=DOCUMENT.names)
    trim()


def _part_starts(segments: DataFrame) -> DataFrame:
    """Tokens before each part. One number per part is read back, never one per segment."""
    sizes = sorted((r["part"], r["n"]) for r in
                   segments.groupBy("part").agg(F.sum("n").alias("n")).collect())
    starts, total = [], 0
    for part, n in sizes:
        starts.append((part, total))
        total += n
    return segments.sparkSession.createDataFrame(starts, "part int, before long")


def documents(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens`` and ``ids_crc32`` of each document of a token file."""
    bounded_batches(spark)
    segments = scan_tokens(spark, path)
    return (segments.mapInArrow(_documents, DOCUMENT)
            .join(F.broadcast(_part_starts(segments)), "part")
            .select("doc_id", (F.col("before") + F.col("place")).alias("start"), "n_tokens",
                    "ids_crc32"))


def tokens_at(spark: SparkSession, path: str, places: DataFrame) -> DataFrame:
    """Adds ``id`` to a table of ``place`` (from 0 over the whole file); null for places outside.

    Each segment is sent the places that lie in it, and reads no other.
    """
    segments = scan_tokens(spark, path)
    starts = _part_starts(segments)
    spans = segments.select("part", "segment", "first", "n").join(F.broadcast(starts), "part") \
        .select("part", "segment", (F.col("before") + F.col("first")).alias("_begin"), "n")
    cell = F.lit(SEGMENT)
    # a place and a span meet in a cell of places, of which a span of one long document has several
    cells = spans.withColumn("_cell", F.explode(F.sequence(
        F.floor(F.col("_begin") / cell), F.floor((F.col("_begin") + F.col("n") - 1) / cell))))
    asked = places.select(F.col("place").cast("bigint").alias("place")).distinct() \
        .withColumn("_cell", F.floor(F.col("place") / cell))
    found = asked.join(cells, "_cell").filter(
        (F.col("place") >= F.col("_begin")) & (F.col("place") < F.col("_begin") + F.col("n")))
    lists = found.groupBy("part", "segment").agg(
        F.collect_list(F.col("place") - F.col("_begin")).alias("_places"),
        F.first("_begin").alias("_begin"))

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                at = np.array(row["_places"], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(at + row["_begin"]), pa.array(_codes(row).at(at).astype(np.int64))],
                    names=["place", "id"])

    ids = (segments.select("part", "segment", "chunks", "bitmaps", "ranks")
           .join(lists, ["part", "segment"]).mapInArrow(read, "place bigint, id bigint"))
    return places.join(ids, "place", "left")


def op11_direct_codes(spark, sf_dir):
    import public_tokenizers

    path = scratch_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path,
                 str(public_tokenizers.path("word_bpe_49k.json")))
    return documents(spark, path)
