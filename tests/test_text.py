import datetime

import pytest
from pyspark.sql import functions as F

from newsflow.functions import text


@pytest.mark.parametrize("raw, deleted, spaced", [
    ("**Увага!** https://a.ua/x #тег - Ґанок…", "Увага! https//a.ua/x тег  Ґанок",
     "Увага! https //a.ua/x тег Ґанок "),
    ("a\n\n\nb c — «x»: 5%", "a b c — x 5", "a b c — x 5 "),
    ("Березовый сок ёж", "Березовый сок ж", "Березовый сок ж"),
    ("**x**__y__z", "xyz", "xyz"),
    ("**a\nb** **", "a b ", " a b "),
    ("один\tдва\x1cтри чотири", "один\tдва\x1cтри чотири",
     "один\tдва\x1cтри чотири"),
    ("café Ñ 5٣ 🙂🙂 it's (ok)!", "caf  5٣  it's (ok)!", "caf 5٣ it's (ok)!"),
    ("\n", " ", " "), ("", "", ""), (None, None, None),
])
def test_clean_text(value, raw, deleted, spaced):
    assert value(text.clean_text, x=raw) == deleted
    assert value(text.clean_text_spaced, x=raw) == spaced


def test_clean_text_is_idempotent(value):
    once = value(text.clean_text, x="**a**\n\n\n-b- «c» №5")
    assert value(text.clean_text, x=once) == once


def test_sanitize_name(value):
    assert value(text.sanitize_name, x='a/b\\c:d*e?f"g<h>i|j') == "a_b_c_d_e_f_g_h_i_j"
    assert value(text.sanitize_name, x="канал 5") == "канал 5"


def test_content_id(value):
    assert value(text.content_id, x="Сніг уночі... Ні???") == "7422c23eee00a10b1035abc04729cdd8"


@pytest.mark.parametrize("raw, hour", [
    ("2024-03-23T12:40:27+00:00", 12), ("2024-03-23T12:40:27Z", 12),
    ("2024-03-23T12:40:27+0200", 10), ("2024-03-23T12:40:27+02:00", 10),
    ("2024-03-23T12:40:27", None), ("2024-03-23T12:40:27.5+00:00", None),
    ("2024-03-23", None), ("soon", None), ("", None), (None, None),
])
def test_parse_ts(value, raw, hour):
    parsed = value(
        lambda x: F.date_format(text.parse_ts(x), "yyyy-MM-dd HH:mm:ss"), x=raw)
    assert parsed == (hour and f"2024-03-23 {hour}:40:27")


def test_kyiv_hms(value):
    assert value(lambda x: text.kyiv_hms(F.lit(1711190427))) == "12:40:27"   # winter time
    assert value(lambda x: text.kyiv_hms(F.lit(1721190427))) == "07:27:07"   # summer time


@pytest.mark.parametrize("answer, expected", [
    ("Текст #1: Негативна\nТекст #2: Нейтральна", [(1, "негативна"), (2, "нейтральна")]),
    ("\n Текст #1 : A", [(1, "a")]),
    ("Текст #1: A\nТекст #3: C", [(1, "a"), (3, "c")]),
    ("Ось відповіді.\nТекст 1: А\nТекст 12: Б ", [(1, "а"), (12, "б")]),
    ("Текст #1: a Текст #1: b", [(1, "a")]),
    ("Текст #01: a Текст #1: b", [(1, "a")]),
    ("Текст #1:  \nТекст #2: b", [(1, None), (2, "b")]),
    ("Текст #123: a", []), ("", []),
])
def test_split_answers(value, answer, expected):
    got = value(text.split_answers, x=answer)
    assert [tuple(piece) for piece in got] == expected


BLOCKS = """
   |||Текст #1
   Дія 1: У місті відкрили міст. Рух
   відновлено.
   Дія 2: Дніпро; Олена Коваль ;UA; 

   |||Текст #2
   Дія 1: Новин немає.
   Дія 2:
   ||| без номера
   |||Текст #2
   Дія 1: повтор
"""


def test_split_blocks_and_actions(spark):
    got = (spark.createDataFrame([(BLOCKS,)], "answer string")
           .select(F.inline(text.split_blocks(F.col("answer"))))
           .select("n", text.split_actions(F.col("block")).alias("p"))
           .select("n", "p.cleared_text", text.entity_list(F.col("p.entities")).alias("e"))
           .collect())
    assert [tuple(row) for row in got] == [
        (1, "У місті відкрили міст. Рух\n   відновлено.", ["Дніпро", "Олена Коваль"]),
        (2, "Новин немає.", [])]


def test_actions_may_be_missing(value):
    parts = value(text.split_actions, x="Текст #1 нічого")
    assert tuple(parts) == (None, None)
    assert tuple(value(text.split_actions, x="Дія 1: a Дія ,: b")) == ("a Дія ,: b", None)


def test_entity_list(value):
    assert value(text.entity_list, x="a; ab; abc") == ["abc"]
    assert value(text.entity_list, x=None) == []


@pytest.mark.parametrize("answer, failed", [
    ("Sorry, no answer was found.", True), ("m failed to answer. Error: 400 bad", True),
    ("m failed to answer. Error: timed out", True), ("m failed to get embeddings. Error: x", True),
    ("... Error: 400 ...", True), (None, True), ("Текст #1: Error: 500", False), ("", False),
])
def test_answer_failed(value, answer, failed):
    assert value(text.answer_failed, x=answer) is failed


def test_words(value):
    assert value(text.words, x="«Йти — по-новому», 5 раз!") == ["йти", "по", "новому", "5", "раз"]
    assert value(text.words, x="...") == []
