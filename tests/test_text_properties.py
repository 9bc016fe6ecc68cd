"""Cleaning against a character-by-character model, on arbitrary texts."""

import re
import unicodedata

from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from newsflow.functions import text

LETTERS = set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
              "абвгдежзийклмнопрстуфхцчшщъыьэюяАБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯІіЇїЄєҐґ"
              "—'/.,!?()")
TRICKY = "ab АяїҐёéß09٣५ _*#@-–—:;%\"«»()!?.,/'\t\n\r\x0b\x0c\x1c\x1f\x85\xa0\u1680\u180e\u200b\u2003\u2028\u3000\ufeff🙂👩‍🚀"
PIECES = st.one_of(st.sampled_from(list(TRICKY)), st.sampled_from(["**", "__", "\n\n", "  "]),
                   st.characters(blacklist_categories=("Cs",), blacklist_characters="\x00",
                                max_codepoint=0xFFFF))
TEXTS = st.lists(PIECES, max_size=25).map("".join)


def kept(character):
    return (character in LETTERS or character.isspace()
            or unicodedata.category(character) == "Nd")


def deleted(value):
    return re.sub("\n+", " ", "".join(c for c in value if kept(c)))


def spaced(value):
    for mark in ("**", "__"):
        value = unwrap(value, mark)
    value = "".join(c if kept(c) else " " for c in value)
    value = re.sub("\n+", " ", value)
    result, run = [], ""
    for c in value + "\0":
        if c.isspace():
            run += c
            continue
        result.append(" " if len(run) > 1 else run)
        run = ""
        result.append(c)
    return "".join(result)[:-1]


def unwrap(value, mark):
    """Remove pairs of ``mark`` on one line with something between them, from the left."""
    result, at = "", 0
    while True:
        start = value.find(mark, at)
        if start < 0:
            return result + value[at:]
        end = value.find(mark, start + len(mark) + 1)
        if end >= 0 and "\n" not in value[start + len(mark):end]:
            result += value[at:start] + value[start + len(mark):end]
            at = end + len(mark)
        else:
            result += value[at:start + 1]
            at = start + 1


@settings(max_examples=8, deadline=None, derandomize=True,
          suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])
@given(st.lists(TEXTS, min_size=60, max_size=60))
def test_cleaning_follows_the_rule(spark, values):
    x = F.col("x")
    rows = spark.createDataFrame([(v,) for v in values], "x string").select(
        "x", text.clean_text(x).alias("d"), text.clean_text_spaced(x).alias("s"),
        text.strip(x).alias("t"), text.content_id(x).alias("m")).collect()
    import hashlib
    for row in rows:
        assert row.d == deleted(row.x), repr(row.x)
        assert row.s == spaced(row.x), repr(row.x)
        assert row.t == row.x.strip(), repr(row.x)
        assert row.m == hashlib.md5(row.x.encode()).hexdigest()
