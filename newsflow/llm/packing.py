"""Best-two-fit packing of tokenised documents into sequences of bounded length.

A plan is made for the histogram of piece lengths, which has at most one entry per length however
many pieces there are. A bin is filled greedily, then its smallest piece is replaced by two unpacked
pieces that fit the gap so widened more tightly. Pieces of one length are alike to the plan, so each
is numbered among its length and looks its place up by that number.
"""

import json
import re
import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from newsflow.llm.common import bounded_batches, cached, table, trim
from newsflow.scratch import materialise

CAPACITY, END_ID = 2048, 0
#: Bytes of words and ids, with the objects that hold them, that a worker remembers before it
#: starts anew.
REMEMBER_BYTES, ENTRY_BYTES = 64 << 20, 150
# What the word pattern counts as white space. Its matcher cannot go over a run of
# a million, so runs from this length on are cut out before.
LONG_BLANK = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{4096,}")
PIECE = T.StructType([T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
                      T.StructField("length", T.LongType()),
                      T.StructField("ids_crc32", T.LongType())])


class Runs(dict):
    """Ids, as little-endian unsigned 32-bit bytes, of a blank and the word after it.

    A byte-level vocabulary begins a new word at each blank ahead of something else, so a text is
    the concatenation of such runs, and a run met before needs no second encoding.
    """

    odd = re.compile(r" (\s|$)")

    def __init__(self, path):
        import tiktoken

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        pretokenizer = spec["pre_tokenizer"]
        if (spec["model"]["type"], spec["normalizer"], pretokenizer["type"],
                pretokenizer["add_prefix_space"]) != ("BPE", None, "ByteLevel", False):
            raise ValueError("not a byte-level BPE vocabulary")
        letters = {c: byte for byte, c in _byte_letters().items()}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items()
                 if token not in special}
        # Fixed value: the word pattern of byte-level vocabularies.
        pattern = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+"
                   r"|\s+(?!\S)|\s+")
        self.encoding = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks,
                                          special_tokens=special)
        self.piece = tiktoken.Encoding("piece", pat_str=r"(?s).+", mergeable_ranks=ranks,
                                       special_tokens={})
        self.size = 0
        self.sizes = np.zeros(max([*ranks.values(), *special.values()]) + 1, np.int64)
        for token, i in ranks.items():
            self.sizes[i] = len(token)
        self.special = re.compile("|".join(map(re.escape, special)) or r"(?!)")

    def whole(self, text):
        """Ids of a text by the vocabulary's words; of a long blank run, the word pattern leaves the
        last character to what follows."""
        ids, begin = [], 0
        for blank in LONG_BLANK.finditer(text):
            end = blank.end() if blank.end() == len(text) else blank.end() - 1
            ids += self.encoding.encode(text[begin:blank.start()], allowed_special="all")
            ids += self.piece.encode_ordinary(text[blank.start():end])
            begin = end
        ids += self.encoding.encode(text[begin:], allowed_special="all")
        return np.array(ids, "<u4").tobytes()

    def learn(self, words):
        """Encode new words in one call; token lengths tell where each word's ids end."""
        ids = np.array(self.encoding.encode_ordinary("".join([" " + w for w in words])), "<u4")
        ends = np.cumsum(self.sizes[ids])
        cuts = np.searchsorted(ends, np.cumsum([len(w.encode()) + 1 for w in words])) + 1
        raw, begin = ids.tobytes(), 0
        for word, cut in zip(words, cuts.tolist()):
            self[word] = raw[4 * begin:4 * cut]
            self.size += ENTRY_BYTES + 2 * len(word) + 4 * (cut - begin)
            begin = cut

    def encode(self, text):
        """Ids of a text, as bytes."""
        if self.odd.search(text) or self.special.search(text) or LONG_BLANK.search(text):
            return self.whole(text)
        if self.size > REMEMBER_BYTES:
            self.clear()
            self.size = 0
        first, *words = text.split(" ")
        unknown = [word for word in dict.fromkeys(words) if word not in self]
        if unknown:
            self.learn(unknown)
        return self.whole(first) + b"".join([self[word] for word in words])


def _byte_letters():
    from newsflow.llm.bpe import _byte_letters as letters

    return letters()


def pieces(text: Column, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> Column:
    """A text's pieces: its ids and the end id, cut so that only the first may be shorter.

    Null counts as empty, which is one piece that holds the end id alone. A text may be of any
    length, and so may its words and runs of blanks.
    """
    @F.arrow_udf(T.ArrayType(PIECE))
    def cut(texts: pa.Array) -> pa.Array:
        runs = cached(("runs", path), lambda: Runs(path), large=True)
        end, out = np.array([end_id], "<u4").tobytes(), []
        for text in texts:
            ids = runs.encode(text.as_py() or "") + end
            n = len(ids) // 4
            cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
            out.append([{"piece": i, "start": a, "length": b - a,
                         "ids_crc32": zlib.crc32(ids[4 * a:4 * b])}
                        for i, (a, b) in enumerate(zip(cuts, cuts[1:]))])
        done = pa.array(out, pa.list_(pa.struct(
            [("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
             ("ids_crc32", pa.int64())])))
        trim()
        return done

    return cut.asNondeterministic()(text)


class Stock:
    """Unpacked pieces by length."""

    def __init__(self, counts, capacity):
        self.left = np.zeros(capacity + 1, np.int64)
        for length, n in counts.items():
            self.left[length] = n
        self.lengths = [int(i) for i in np.flatnonzero(self.left)]

    def most(self, room, taken):
        """The longest piece of at most ``room`` left beside what is taken, or 0."""
        at = bisect_right(self.lengths, room)
        while at:
            length = self.lengths[at - 1]
            if self.left[length] > taken.get(length, 0):
                return length
            at -= 1
        return 0

    def take(self, taken):
        """Remove as many times these pieces as are left; the number of times."""
        times = int(min(self.left[length] // n for length, n in taken.items()))
        for length, n in taken.items():
            self.left[length] -= times * n
            if not self.left[length]:
                del self.lengths[bisect_right(self.lengths, length) - 1]
        return times


def _best_two(stock, taken, room):
    """Two unpacked pieces of at most ``room`` together, as much as there can be."""
    best, pair = 0, None
    for first in reversed(stock.lengths):
        if first >= room or 2 * first <= best:
            if first < room:
                break
            continue
        if stock.left[first] <= taken.get(first, 0):
            continue
        second = stock.most(min(first, room - first), {**taken, first: taken.get(first, 0) + 1})
        if second and first + second > best:
            best, pair = first + second, (first, second)
            if best == room:
                break
    return pair


def plan(counts, capacity=CAPACITY):
    """Patterns of bins for a histogram of lengths: (times, lengths in the bin), longest first.

    A pattern is used until one of its lengths runs short, as packing bin by bin would.
    """
    stock, patterns = Stock(counts, capacity), []
    while stock.lengths:
        taken, bin_, room = {}, [], capacity
        while length := stock.most(room, taken):
            taken[length] = taken.get(length, 0) + 1
            bin_.append(length)
            room -= length
        if room and len(bin_) > 1:
            small = bin_[-1]
            taken[small] -= 1
            pair = _best_two(stock, taken, room + small)
            if pair and sum(pair) > small:
                bin_[-1:] = pair
                for length in pair:
                    taken[length] = taken.get(length, 0) + 1
            else:
                taken[small] += 1
        patterns.append((stock.take({k: n for k, n in taken.items() if n}), bin_))
    return patterns


def _places(patterns, capacity):
    """For each length, where its pieces go: first number, bins, first bin and offset per slot."""
    slots, bins, used = [], 0, np.zeros(capacity + 1, np.int64)
    for times, lengths in patterns:
        offset = 0
        for length in lengths:
            slots.append((length, used[length], bins, offset))
            used[length] += times
            offset += length
        bins += times
    table_ = np.array(slots, np.int64).reshape(-1, 4)
    return table_[np.lexsort((table_[:, 1], table_[:, 0]))]


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces, which have a ``length`` from 1 to capacity.

    Rows that are equal in all columns get places of their own.
    """
    numbered = materialise(cut.withColumn("_part", F.spark_partition_id()), "pieces")
    tally = materialise(numbered.groupBy("length", "_part").agg(F.count("*").alias("n")), "tally")
    counts = {row["length"]: row["n"]
              for row in tally.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = _places(plan(counts, capacity), capacity)
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = tally.select("length", "_part",
                           F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("length", "_part").orderBy("doc_id", "piece")
    keys = slots[:, 0] << 40 | slots[:, 1]

    @F.arrow_udf(T.StructType([T.StructField("sequence_id", T.LongType()),
                               T.StructField("offset", T.LongType())]))
    def place(lengths: pa.Array, numbers: pa.Array) -> pa.Array:
        length, number = lengths.to_numpy(False), numbers.to_numpy(False)
        at = np.searchsorted(keys, length.astype(np.int64) << 40 | number, side="right") - 1
        sequence = slots[at, 2] + number - slots[at, 1]
        return pa.StructArray.from_arrays([pa.array(sequence), pa.array(slots[at, 3])],
                                          ["sequence_id", "offset"])

    return (numbered.withColumn("_n", F.row_number().over(inside) - 1)
            .join(offsets, ["length", "_part"])
            .withColumn("_p", place("length", F.col("_n") + F.col("_before")))
            .select(*cut.columns, "_p.sequence_id", "_p.offset"))


def packed_pieces(docs: DataFrame, path: str, text_col="text", capacity=CAPACITY) -> DataFrame:
    """One row per piece of each document with its place. Without rows, none come back."""
    bounded_batches(docs.sparkSession)
    cut = (docs.select("doc_id", F.explode(pieces(F.col(text_col), path, capacity)).alias("_c"))
           .select("doc_id", *[F.col(f"_c.{name}") for name in PIECE.names]))
    return pack(cut, capacity)


def op5_best_fit_packing(spark, sf_dir):
    import public_tokenizers

    return packed_pieces(table(spark, sf_dir, "documents"),
                         str(public_tokenizers.path("byte_bpe_50k.json")))
