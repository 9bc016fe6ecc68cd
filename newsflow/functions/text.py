"""Text, time and answer-parsing functions, all as native column expressions."""

from pyspark.sql import Column, DataFrame, functions as F

# Characters a cleaned text keeps, the markup that is unwrapped,
# characters not allowed in a file name, and the shapes of model answers.
SPACES = r" \t\n\x0B\f\r\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
TEXT = r"a-zA-Zа-яА-ЯІіЇїЄєҐґ—'/.,!?()\p{Nd}" + SPACES
BOLD = r"\*\*([^\n]+?)\*\*"
UNDERLINED = r"__([^\n]+?)__"
NOT_FILENAME = r'[/\\:*?"<>|]'
ZONE_SUFFIX = r"(Z|[+-]\d{2}:?\d{2})$"
TIMESTAMP_FORMAT = "yyyy-MM-dd'T'HH:mm:ss[XXX][XX]"
LOCAL_ZONE = "Europe/Kyiv"
BLANK_CHARACTERS = " \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004" \
    "\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
ANSWER_MARK = r"Текст #?(\d{1,2})\s?:"
BLOCK_SEPARATOR = r"\|\|\|"
BLOCK_MARK = r"^\s*Текст #?(\d{1,2})"
ACTION_MARK = r"Дія [12]:"
FAILED_EXACT = "Sorry, no answer was found."
FAILED_PATTERN = r"Error: 400|failed to (answer|get embeddings)\. Error:"
MIN_ENTITY_LENGTH = 3

# the look-ahead settles most characters by a short test instead of the long one
NOT_TEXT = "(?![a-zA-Zа-яА-Я ])[^" + TEXT + "]"


def clean_text(text: Column) -> Column:
    """Delete markup and every non-text character; a run of newlines becomes one space.

    ``*`` and ``_`` are no text characters, so deleting them also unwraps the markup.
    """
    return F.regexp_replace(F.regexp_replace(text, NOT_TEXT, ""), r"\n+", " ")


def clean_text_spaced(text: Column) -> Column:
    """Like :func:`clean_text`, with a space per removed character and runs collapsed."""
    unwrapped = F.regexp_replace(F.regexp_replace(text, BOLD, "$1"), UNDERLINED, "$1")
    spaced = F.regexp_replace(unwrapped, NOT_TEXT, " ")
    return F.regexp_replace(spaced, "[" + SPACES + r"]{2,}|\n", " ")


def sanitize_name(name: Column) -> Column:
    """Replace each character that a file name must not hold by ``_``."""
    return F.regexp_replace(name, NOT_FILENAME, "_")


def content_id(text: Column) -> Column:
    """Hex md5 of the raw text's UTF-8 bytes."""
    return F.md5(F.encode(text, "UTF-8"))


def parse_ts(value: Column) -> Column:
    """ISO time with a mandatory offset and whole seconds; anything else is null."""
    return F.when(value.rlike(ZONE_SUFFIX), F.try_to_timestamp(value, F.lit(TIMESTAMP_FORMAT)))


def kyiv_hms(seconds: Column) -> Column:
    """Epoch seconds as wall-clock ``HH:MM:SS`` (session time zone: UTC)."""
    return F.date_format(F.from_utc_timestamp(F.timestamp_seconds(seconds), LOCAL_ZONE), "HH:mm:ss")


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANK_CHARACTERS))


def blank_to_null(text: Column) -> Column:
    return F.when(text != "", text)


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def split_answers(answer: Column) -> Column:
    """``array<struct<n, value>>`` of the numbered answers in one reply.

    Text ahead of the first marker is ignored, and of two answers with one
    number the first counts.
    """
    marks = F.regexp_extract_all(answer, F.lit(ANSWER_MARK), F.lit(1)).cast("array<int>")
    pieces = F.split(answer, ANSWER_MARK, -1)

    def value(pieces, i):
        return blank_to_null(F.lower(strip(F.get(pieces, i + 1))))

    return let(marks, lambda marks: let(pieces, lambda pieces: _first_per_number(
        F.transform(marks, lambda n, i: F.struct(n.alias("n"), value(pieces, i).alias("value"))),
        marks)))


def split_blocks(answer: Column) -> Column:
    """``array<struct<n, block>>`` of the separated blocks that carry a number."""
    blocks = F.transform(F.split(answer, BLOCK_SEPARATOR, -1), lambda block: F.struct(
        F.regexp_extract(block, BLOCK_MARK, 1).try_cast("int").alias("n"),
        block.alias("block")))
    return let(F.filter(blocks, lambda b: b["n"].isNotNull()),
               lambda blocks: _first_per_number(blocks, blocks["n"]))


def _first_per_number(numbered: Column, numbers: Column) -> Column:
    return F.filter(numbered, lambda piece, i: F.array_position(numbers, piece["n"]) == i + 1)


def split_actions(block: Column) -> Column:
    """``struct<cleared_text, entities>``: the first and second part of a block."""
    parts = F.split(strip(block), ACTION_MARK, -1)
    return F.struct(blank_to_null(strip(F.get(parts, F.lit(1)))).alias("cleared_text"),
                    strip(F.get(parts, F.lit(2))).alias("entities"))


def entity_list(entities: Column) -> Column:
    """The ``;``-separated names longer than two characters; none gives an empty list."""
    names = F.filter(F.transform(F.split(entities, ";", -1), strip),
                     lambda name: F.length(name) >= MIN_ENTITY_LENGTH)
    return F.coalesce(names, F.array().cast("array<string>"))


def answer_failed(answer: Column) -> Column:
    """True where a reply is missing or one of the known failure texts."""
    return (answer.isNull() | (strip(answer) == FAILED_EXACT) | answer.rlike(FAILED_PATTERN))


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+", -1), "")


def times(tokens: Column, word: Column | str) -> Column:
    """How often ``word`` is among ``tokens``."""
    return (F.size(tokens) - F.size(F.array_remove(tokens, word))).cast("long")


def word_counts(tokens: Column) -> Column:
    """``array<struct<word, tf>>``: each of the words once, in order. Equal ones meet by sorting, so
    the work per text is hardly more than its words, and nothing is shuffled."""
    def starts(ordered):
        places = F.when(F.size(ordered) > 0, F.sequence(F.lit(0), F.size(ordered) - 1))
        return F.filter(places, lambda i: (i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1)))

    def counted(ordered, at):
        return F.transform(at, lambda place, i: F.struct(
            F.get(ordered, place).alias("word"),
            (F.coalesce(F.get(at, i + 1), F.size(ordered)) - place).cast("long").alias("tf")))

    return let(F.sort_array(tokens), lambda ordered: let(
        starts(ordered), lambda at: counted(ordered, at)))


def explode_words(df: DataFrame, name: str) -> DataFrame:
    """One row per element of column ``name``.

    The outer form keeps the optimizer from testing the array for elements
    ahead of the scan, which would compute an array of words twice.
    """
    return df.withColumn(name, F.explode_outer(name)).filter(F.col(name).isNotNull())
