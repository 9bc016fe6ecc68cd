"""A deterministic baseline for the enrichment steps, in native expressions.

It stands in for a text model where none is at hand. Its answers are its own:
they are not what a model would say.
"""

from pyspark.sql import Column, DataFrame, functions as F

from newsflow.functions.text import explode_words, let, times, words
from newsflow.operators.merge import join_on_key
from newsflow.schema import KEY

# What counts as noise, the characters a cleaned message keeps
# and the phrases that stand for an empty result.
LINK = r"(?:https?://|www\.)[^\s]+"
# an address begins where its run of characters does, or where the last match ended
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
TAG_OR_MENTION = r"[#@][\p{L}\p{N}_]+"
PHONE = r"\+[0-9][0-9 ().-]{7,}[0-9]"
EMOJI = r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}]"
CREDIT = r"(?:Фото|Відео|Джерело|Інфографіка): ?[^\n]*"
NOISE = "|".join([CREDIT, LINK, EMAIL, PHONE, TAG_OR_MENTION, EMOJI])
MAYBE_NOISE = r"[@#+:\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}]|www\."
BLANKS = r"[ \t\n\r\f]+"
NOT_CLEAN = r"[^\p{L}\p{N} \t\n\r\f?!.,\-–—]+"
CAPITALISED_RUN = r"[^.!?\n ] +(\p{Lu}[\p{L}\p{N}-]*(?: \p{Lu}[\p{L}\p{N}-]*)*+)"
TWO_SENTENCES = r"^[^.!?]*(?:[.!?]+(?:[^.!?]*[.!?]+)?|$)"
NO_MESSAGE = "повідомлення немає"
NO_SUMMARY = "самарі відсутнє"

#: Up to this many entries a lexicon is compiled into the expression, so that
#: scoring needs no shuffle (the work per text grows with the words it hits); up
#: to the second number it is broadcast.
INLINE_LEXICON = 500
BROADCAST_LEXICON = 1_000_000


def extract_noise(text: Column) -> Column:
    """Credits, links, addresses, phones, tags, mentions and emoji, in text order, by ``;``."""
    found = F.array_join(F.regexp_extract_all(text, F.lit(NOISE), F.lit(0)), ";")
    return F.when(text.rlike(MAYBE_NOISE), found).when(text.isNotNull(), "")


def without_noise(text: Column) -> Column:
    """Most texts hold none of the characters that noise needs, which a short test tells."""
    return F.when(text.rlike(MAYBE_NOISE), F.regexp_replace(text, NOISE, "")).otherwise(text)


def clean(text: Column) -> Column:
    """The text without noise and special characters."""
    kept = F.regexp_replace(without_noise(text), NOT_CLEAN, "")
    return F.regexp_replace(F.trim(F.regexp_replace(kept, BLANKS, " ")), "^$", NO_MESSAGE)


def entities(cleaned: Column) -> Column:
    """Distinct runs of capitalised words that do not open a sentence, sorted."""
    runs = F.regexp_extract_all(cleaned, F.lit(CAPITALISED_RUN), F.lit(1))
    return F.sort_array(F.array_distinct(F.filter(runs, lambda run: F.length(run) > 2)))


def summary(cleaned: Column) -> Column:
    """The first two sentences, lower-cased as parsed answers are."""
    opening = F.lower(F.trim(F.regexp_extract(cleaned, TWO_SENTENCES, 0)))
    return F.regexp_replace(opening, f"^{NO_MESSAGE}$", NO_SUMMARY)


def label_by_lexicon(messages: DataFrame, lexicon: DataFrame, values, default: str, name: str,
                     tokens: Column | None = None, key_cols=KEY,
                     inline_limit: int = INLINE_LEXICON) -> DataFrame:
    """Add column ``name``: the value whose lexicon words weigh most in the text.

    ``lexicon`` has columns ``word, value, weight`` (whole numbers); rows of one
    word and value add up, those without a weight count nothing. Ties go to the value that comes first in
    ``values``; without any hit, or if no sum is positive, ``default`` is given.
    ``tokens`` are the words to score, by default those of the initial text.
    """
    tokens = words(F.col("initial_text")) if tokens is None else tokens
    lexicon = (lexicon.filter(F.col("value").isin(list(values)) & F.col("word").isNotNull()
                              & F.col("weight").isNotNull() & ~F.col("word").contains("\n"))
               .groupBy("word", "value").agg(F.sum(F.col("weight").cast("long")).alias("weight")))
    entries = (lexicon.select("word", "value", "weight").limit(inline_limit + 1).collect())
    if len(entries) <= inline_limit:
        return messages.withColumn(
            name, _inline_label(tokens, entries, values, default))
    return _joined_label(messages, lexicon, values, default, name, tokens, key_cols)


def _inline_label(tokens: Column, entries, values, default: str) -> Column:
    """Score inside each row: array_intersect looks the words up by hash, the few found count."""
    weights = {}
    for e in entries:
        weights.setdefault(e.value, {})[e.word] = int(e.weight)
    if not weights:
        return F.lit(default)

    def listed(items):
        # one literal instead of one per word keeps the plan small
        return F.split(F.lit("\n".join(str(item) for item in items)), "\n")

    known = listed(sorted({e.word for e in entries}))

    def score(hits, value):
        weight = F.map_from_arrays(listed(weights[value]),
                                   listed(weights[value].values()).cast("array<bigint>"))
        return F.aggregate(hits, F.lit(0).cast("long"), lambda total, hit: total + hit["times"]
                           * F.coalesce(F.element_at(weight, hit["word"]), F.lit(0).cast("long")))

    def best(hits):
        return F.array_max(F.array(*[
            F.struct(score(hits, value).alias("score"), F.lit(-place).alias("place"),
                     F.lit(value).alias("value"))
            for place, value in enumerate(values) if value in weights]))

    def hits(tokens):
        return F.transform(F.array_intersect(tokens, known), lambda word: F.struct(
            word.alias("word"), times(tokens, word).alias("times")))

    label = let(tokens, lambda tokens: let(hits(tokens), lambda found: let(
        best(found), lambda top: F.when(top["score"] > 0, top["value"]))))
    return F.coalesce(label, F.lit(default))


def _joined_label(messages, lexicon, values, default, name, tokens, key_cols):
    """Score by join. A word that most texts hold is a hot key only if the lexicon is too large
    to broadcast; adaptive execution splits such a key, and sums are partial ahead of the shuffle.
    """
    places = F.create_map(*[F.lit(x) for place, value in enumerate(values)
                            for x in (value, -place)])
    lexicon = (lexicon.select("word", "value", F.col("weight").cast("long").alias("weight"),
                              places[F.col("value")].alias("place")))
    if lexicon.count() <= BROADCAST_LEXICON:
        lexicon = F.broadcast(lexicon)
    # one key may have several texts; equal texts of a key add up alike, which changes no order
    messages = messages.withColumn("_words_hash", F.xxhash64(tokens))
    row = [*key_cols, "_words_hash"]
    found = explode_words(messages.select(*row, tokens.alias("word")), "word")
    sums = (found.join(lexicon, "word").groupBy(*row, "place", "value")
            .agg(F.sum("weight").alias("score")))
    best = (sums.groupBy(*row)
            .agg(F.max(F.struct("score", "place", "value")).alias("best"))
            .filter(F.col("best.score") > 0)
            .select(*row, F.col("best.value").alias("_label")))
    return (join_on_key(messages, best, row, "left")
            .withColumn(name, F.coalesce("_label", F.lit(default))).drop("_label", "_words_hash"))
