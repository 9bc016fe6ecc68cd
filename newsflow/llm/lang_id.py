"""Language identification with n-gram Bloom filters of all languages, kept as bit slices.

Word j of the filter holds bit j of every language's Bloom filter, so the words at an n-gram's
hash positions, taken together with AND, are the mask of all languages that contain the n-gram.
Every 64 languages have words of their own, one array of them after the other.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from newsflow.llm.common import BLOCK_BYTES, bounded_batches, cached, held_out, table

#: Training documents per language, taken in the order of a hash of their ids.
SAMPLE_DOCS = 400
#: A language contains an n-gram that is this often, of the largest share any language has ...
RELATIVE_SHARE = 0.3
#: ... and that so many of its sampled documents have at least, or all where there are fewer.
MIN_DOCS = 3
LENGTHS, HASHES = (2, 3, 4), 2
UNKNOWN = "und"
WORD_BITS = 64
_MULTIPLIERS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def _letters():
    return np.array([chr(i).isalpha() for i in range(1 << 16)])


def normalised(text):
    """Code points of the lower-cased text between two blanks; what is no letter is a blank."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    letters = cached("letters", _letters)
    letter = letters[np.minimum(points, 0xFFFF)]
    for i in np.flatnonzero(points > 0xFFFF):
        letter[i] = chr(points[i]).isalpha()
    return np.where(letter, points, np.uint32(32)), bool(letter.any())


def grams(points, length):
    """64-bit key of the n-gram at each position; n-grams that begin with two blanks are left out."""
    n = len(points) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    key = np.full(n, length, np.uint64)
    for i in range(length):  # a code point has 21 bits, so keys of up to three points are exact
        key = key * np.uint64(0x200001 if length < 4 else 0x9E3779B1) + points[i:n + i]
    return key[(points[:n] != 32) | (points[1:n + 1] != 32)]


def positions(keys, size):
    """HASHES filter positions for each key; ``size`` is a power of two."""
    shift = np.uint64(64 - int(size).bit_length() + 1)
    mixed = keys ^ (keys >> np.uint64(31))
    return [((mixed * m) ^ ((mixed * m) >> np.uint64(29))) * m >> shift for m in _MULTIPLIERS]


def build(members, n_languages):
    """Bit-sliced filter from (language number, key) arrays, about 16 words per distinct key."""
    language, keys = members
    size = 1 << max(10, int(16 * max(1, len(np.unique(keys)))).bit_length())
    words = np.zeros((-(-n_languages // WORD_BITS), size), np.uint64)
    bits = np.uint64(1) << (language % WORD_BITS).astype(np.uint64)
    for at in positions(keys, size):
        np.bitwise_or.at(words, (language // WORD_BITS, at), bits)
    fill = np.array([((words[i // WORD_BITS] >> np.uint64(i % WORD_BITS)) & np.uint64(1)).mean()
                     for i in range(n_languages)])
    return words.ravel(), fill ** HASHES


def hits(texts, words, n_languages):
    """Per text: n-grams, n-grams in each language's filter, and whether it has a letter."""
    total, found = np.zeros(len(texts)), np.zeros((len(texts), n_languages))
    has_letter = np.zeros(len(texts), bool)
    slices = words.reshape(-(-n_languages // WORD_BITS), -1)
    for i, text in enumerate(texts):
        for begin in range(0, len(text), BLOCK_BYTES):  # pieces overlap by what an n-gram needs
            piece = text[max(0, begin - max(LENGTHS) + 1):begin + BLOCK_BYTES]
            points, letter = normalised(piece)
            has_letter[i] |= letter
            for length in LENGTHS if letter else ():
                keys = grams(points, length)
                total[i] += len(keys)
                at_all = list(positions(keys, slices.shape[1]))
                for first, slice_ in zip(range(0, n_languages, WORD_BITS), slices):
                    mask = np.full(len(keys), ~np.uint64(0))
                    for at in at_all:
                        mask &= slice_[at]
                    last = min(first + WORD_BITS, n_languages)
                    found[i, first:last] += [np.count_nonzero(mask & (np.uint64(1) << np.uint64(k)))
                                             for k in range(last - first)]
    return total, found, has_letter


def decide(total, found, false_rate):
    """Best language and its part of all languages' shares, corrected for false positives.

    Where no corrected share is above 0, the best raw share decides, with score 0; of equal
    languages the first in order.
    """
    share = found / np.maximum(total, 1)[:, None]
    true = np.clip((share - false_rate) / np.maximum(1 - false_rate, 1e-9), 0, 1)
    all_ = true.sum(1)
    best = np.where(all_ > 0, true.argmax(1), share.argmax(1))
    top = true[np.arange(len(best)), best]
    return best, np.where(all_ > 0, top / np.maximum(all_, 1e-300), 0.0)


@F.arrow_udf(T.ArrayType(T.LongType()))
def _counted(texts: pa.Array) -> pa.Array:
    """Distinct n-gram keys of a text, each followed by its count."""
    out = []
    for text in texts.to_pylist():
        points, letter = normalised(text or "")
        keys = np.concatenate([grams(points, n) for n in LENGTHS]) if letter else []
        keys, counts = np.unique(np.array(keys, np.uint64), return_counts=True)
        out.append(np.column_stack([keys.view(np.int64), counts]).ravel())
    return pa.array(out, pa.list_(pa.int64()))


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS):
    """Languages in order, filter words and false positive rates; None without training rows.

    The n-grams that come to the driver number a few times those of ``sample_docs`` texts a language.
    """
    bounded_batches(docs.sparkSession)
    by_hash = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    sample = (docs.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull()
                          & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
              .select("doc_id", "lang", F.row_number().over(by_hash).alias("_n"))
              .filter(F.col("_n") <= sample_docs).select("doc_id", "lang").distinct())
    sampled = {row["lang"]: row["count"] for row in sample.groupBy("lang").count().collect()}
    languages = sorted(sampled)
    if not languages:
        return None
    few = {lang: n for lang, n in sampled.items() if n < MIN_DOCS}
    least = F.lit(MIN_DOCS)
    if few:
        fewer = F.create_map(*[F.lit(x) for pair in few.items() for x in pair])
        least = F.coalesce(fewer[F.col("lang")].cast("int"), least)
    pairs = F.col("_keys")
    counted = (docs.select("doc_id", "lang", "text").join(F.broadcast(sample), ["doc_id", "lang"])
               .select("lang", _counted(F.col("text")).alias("_keys"))
               .select("lang", F.explode(F.transform(
                   F.sequence(F.lit(0), F.greatest(F.size(pairs) / 2 - 1, F.lit(0)).cast("int")),
                   lambda i: F.struct(F.get(pairs, 2 * i).alias("key"),
                                      F.get(pairs, 2 * i + 1).alias("n")))).alias("g"))
               .filter("g.key IS NOT NULL")
               .groupBy("lang", F.col("g.key").alias("key"))
               .agg(F.sum("g.n").alias("n"), F.count("*").alias("docs")))
    in_lang, of_key = Window.partitionBy("lang"), Window.partitionBy("key")
    rows = (counted.withColumn("share", F.col("n") / F.sum("n").over(in_lang))
            .withColumn("most", F.max("share").over(of_key))
            .filter((F.col("docs") >= least) & (F.col("share") >= RELATIVE_SHARE * F.col("most")))
            .select("lang", "key").toPandas())
    number = rows["lang"].map({name: i for i, name in enumerate(languages)}).to_numpy(np.int64)
    return languages, *build((number, rows["key"].to_numpy(np.int64).view(np.uint64)),
                             len(languages))


def language(text: Column, model) -> Column:
    """Struct of ``lang`` and ``score``; ``und`` and 0 for null, for texts without a letter and
    where no language was learned. A text in letters that no language has gets one with score 0."""
    kind = T.StructType([T.StructField("lang", T.StringType()),
                         T.StructField("score", T.DoubleType())])

    @F.arrow_udf(kind)
    def identify(texts: pa.Array) -> pa.Array:
        rows = [text or "" for text in texts.to_pylist()]
        if model is None:
            names, score = [UNKNOWN] * len(rows), np.zeros(len(rows))
        else:
            names_of, words, false_rate = model
            total, found, letter = hits(rows, words, len(names_of))
            best, score = decide(total, found, false_rate)
            score = np.where(letter, score, 0.0)
            names = [names_of[b] if has else UNKNOWN for b, has in zip(best, letter)]
        return pa.StructArray.from_arrays([pa.array(names, pa.string()),
                                           pa.array(score, pa.float64())], ["lang", "score"])

    return identify.asNondeterministic()(text)


def op8_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = train(docs)
    return (docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"),
                        language(F.col("text"), model).alias("_l"))
            .select("doc_id", "held_out", F.col("_l.lang").alias("lang_pred"), "_l.score"))
