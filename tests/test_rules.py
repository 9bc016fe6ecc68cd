import time

import pytest
from pyspark.sql import functions as F

from newsflow.functions import rules
from newsflow.plans import enrich
from newsflow.schema import CATEGORIES, TONALITIES


def test_extract_noise(value):
    raw = ("Новина дня. Деталі: https://news.ua/a?b=1#c та www.ua.ua/x #новини @редакція_1 "
           "пишіть ed.itor+1@mail.example.com або +380 (44) 555-66-77 🙂\nФото: агенція\nКінець.")
    assert value(rules.extract_noise, x=raw).split(";") == [
        "https://news.ua/a?b=1#c", "www.ua.ua/x", "#новини", "@редакція_1",
        "ed.itor+1@mail.example.com", "+380 (44) 555-66-77", "🙂", "Фото: агенція"]
    assert value(rules.extract_noise, x="Тиша.") == ""


def test_clean(value):
    raw = "**Увага!**  Міст — відкрито 🙂 https://a.ua\n\nФото: агенція\nЯкось так-то, «ура»: 5%?"
    assert value(rules.clean, x=raw) == "Увага! Міст — відкрито Якось так-то, ура 5?"
    assert value(rules.clean, x="#тег @хто 🙂") == rules.NO_MESSAGE
    assert value(rules.clean, x="") == rules.NO_MESSAGE


def test_entities_and_summary(value):
    cleaned = "Вчора Олена Коваль була у Києві. Потім Олена Коваль поїхала до Яремче! А далі Ок. Ні."
    assert value(rules.entities, x=cleaned) == ["Києві", "Олена Коваль", "Яремче"]
    assert value(rules.summary, x=cleaned) == \
        "вчора олена коваль була у києві. потім олена коваль поїхала до яремче!"
    assert value(rules.summary, x="Без крапки") == "без крапки"
    assert value(rules.summary, x=rules.NO_MESSAGE) == rules.NO_SUMMARY


def test_long_runs_do_not_exhaust_the_matcher(value):
    capitals = "x " + "Слово " * 50_000
    assert len(value(rules.entities, x=capitals)) == 1
    dotted = "a@" + "b." * 50_000 + "9"
    assert value(lambda x: F.length(rules.clean(x)), x=dotted) > 0
    assert value(lambda x: F.length(rules.extract_noise(x)), x="z" * 200_000) == 0


LEXICON = [("добре", "позитивна", 2), ("погано", "негативна", 2), ("дуже", "позитивна", 1),
           ("дуже", "негативна", 1), ("стріляє", "загрозлива", 5), ("ні", "негативна", -3)]
TEXTS = [("1", "Добре, дуже добре!"), ("2", "погано"), ("3", "дуже"), ("4", "нічого"), ("5", ""),
         ("6", "погано ні"), ("7", "добре погано"), ("8", "Стріляє добре добре"), ("9", None)]
EXPECTED = {"1": "позитивна", "2": "негативна", "3": "позитивна", "4": "нейтральна",
            "5": "нейтральна", "6": "нейтральна", "7": "позитивна", "8": "загрозлива",
            "9": "нейтральна"}


@pytest.mark.parametrize("inline_limit", [2000, 0])
def test_label_by_lexicon(spark, inline_limit):
    messages = spark.createDataFrame([("s", i, t) for i, t in TEXTS],
                                     "source string, message_id string, initial_text string")
    lexicon = spark.createDataFrame(LEXICON, "word string, value string, weight int")
    labelled = rules.label_by_lexicon(messages, lexicon, TONALITIES, "нейтральна", "tonality",
                                      inline_limit=inline_limit)
    assert {r.message_id: r.tonality for r in labelled.collect()} == EXPECTED


def test_both_ways_of_scoring_agree_on_real_texts(spark):
    from newsflow.plans.tables import CATEGORY_WORDS, lexicon, text_messages
    messages = text_messages(spark, "/root/testdata/sf0.001")
    words = lexicon(spark, CATEGORY_WORDS)
    inline, joined = (
        {tuple(r) for r in rules.label_by_lexicon(
            messages, words, CATEGORIES, "спорт", "category", inline_limit=limit)
         .select("message_id", "category").collect()} for limit in (2000, 0))
    assert inline == joined and len(inline) == 200


def test_inline_scoring_needs_no_shuffle(spark):
    messages = spark.createDataFrame([("s", "1", "добре")],
                                     "source string, message_id string, initial_text string")
    lexicon = spark.createDataFrame(LEXICON, "word string, value string, weight int")
    plan = enrich.tonality_by_rules(messages, lexicon)._jdf.queryExecution().toString()
    assert "Exchange" not in plan


def test_embeddings_are_unit_vectors_and_repeatable(spark):
    messages = spark.createDataFrame(
        [("1", "один два два"), ("2", "Один, два — два!"), ("3", None), ("4", "")],
        "message_id string, cleared_text string")
    rows = {r.message_id: r for r in enrich.embeddings_by_rules(messages, 64).collect()}
    assert rows["1"].embedding_sts == rows["2"].embedding_sts
    assert rows["1"].embedding_sts != rows["1"].embedding_clf
    assert len(rows["1"].embedding_sts) == 64
    assert abs(sum(v * v for v in rows["1"].embedding_sts) - 1) < 1e-6
    assert rows["3"].embedding_sts is None
    assert set(rows["4"].embedding_clf) == {0.0}


def test_noise_takes_linear_time(value):
    for text in ("see: " + "a1" * 500_000, "see: " + "a1." * 300_000 + "@", "+" + "1 " * 500_000,
                 "x@" + "a." * 400_000, "a@b@" * 200_000):
        begin = time.perf_counter()
        value(lambda x: F.length(rules.clean(x)), x=text)
        assert time.perf_counter() - begin < 5
    assert value(rules.extract_noise, x="see: a.b@c.de,f@g.hi @j.kl q@r.st.u@v.wx").split(";") == [
        "a.b@c.de", "f@g.hi", "@j", "q@r.st", ".u@v.wx"]


def test_words_are_hashed_once_for_both_vectors(spark, monkeypatch):
    made = []

    def noted(*args, make=enrich.HashingTF, **options):
        made.append(options)
        return make(*args, **options)

    monkeypatch.setattr(enrich, "HashingTF", noted)
    rows = spark.createDataFrame([("a a b",), ("",), (None,)], "cleared_text string")
    both, empty, none = enrich.embeddings_by_rules(rows, 64).collect()
    assert len(made) == 1
    assert sorted(x for x in both.embedding_sts if x) == pytest.approx([0.2 ** 0.5, 0.8 ** 0.5])
    assert sorted(x for x in both.embedding_clf if x) == pytest.approx([0.5 ** 0.5] * 2)
    assert not any(empty.embedding_sts) and not any(empty.embedding_clf)
    assert none.embedding_sts is None and none.embedding_clf is None
