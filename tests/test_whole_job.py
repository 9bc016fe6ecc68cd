"""The queries of the whole chain run all of its steps."""

import datetime

import pytest

from newsflow.functions import rules
from newsflow.plans import enrich, jobs, queries
from newsflow.schema import TONALITIES
from newsflow.sources import store

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["enrich_all", "enrich_by_source"])
def test_chain_by_rules_makes_both_vectors(spark, name):
    done = queries.QUERIES[name](spark, SF_DIR)
    written = spark.read.parquet(*done.inputFiles())
    assert written.filter("size(embedding_sts) = 768 AND size(embedding_clf) = 768").count() \
        == done.count() > 0


def test_chain_by_model_asks_for_every_step(spark, monkeypatch):
    asked = []
    run = enrich.enrich_by_model
    monkeypatch.setattr(enrich, "enrich_by_model", lambda messages, fns, **options: (
        asked.extend(fns), run(messages, fns, **options))[1])
    queries.enrich_by_model(spark, SF_DIR)
    assert set(asked) == set(enrich.CHAIN)


def _stored(spark, path, rows):
    store.write_messages(spark, path, spark.createDataFrame(
        rows, "source string, message_id string, publish_date timestamp, initial_text string, "
        "cleared_text string, named_entities array<string>, summary string, "
        "embedding_sts array<float>, embedding_clf array<float>"))


def test_failed_clean_ner_keeps_stored_vectors(spark, tmp_path):
    path, day = str(tmp_path / "store"), datetime.datetime(2024, 1, 1)
    _stored(spark, path, [("s", "1", day, "x", "old", [], None, [1.0], [2.0]),
                          ("s", "2", day, "x", None, None, None, [3.0], [4.0]),
                          ("s", "3", day, "x", None, None, None, None, None)])

    def down(requests, setup):
        raise RuntimeError("down")

    failed = jobs.run_model_steps(spark, path, {
        "clean_ner": down, "embeddings": lambda texts, kind: [[float(len(t))] for t in texts]})
    assert {r.message_id: r.embeddings_error for r in failed.collect()} == {
        "1": None, "2": "no cleared text", "3": "no cleared text"}
    got = {r.message_id: (r.cleared_text, r.embedding_sts, r.embedding_clf)
           for r in store.scan_store(spark, path).collect()}
    assert got == {"1": ("old", [3.0], [3.0]), "2": (None, [3.0], [4.0]), "3": (None, None, None)}


def test_without_reprocess_what_lacks_a_field_is_taken_up(spark, tmp_path):
    path, day = str(tmp_path / "store"), datetime.datetime(2024, 1, 1)
    _stored(spark, path, [("s", "1", day, "x", "old", [], None, [1.0], [2.0]),
                          ("s", "2", day, "x", "old", [], "had", [1.0], None)])
    sent = spark.sparkContext.accumulator(0)

    def answer(requests, setup):
        sent.add(len(requests))
        return ["Текст #1: Разом" for _ in requests]

    def stored(field):
        return {r.message_id: r[field] for r in store.scan_store(spark, path).collect()}

    jobs.run_model_steps(spark, path, {"summary": answer}, reprocess=False)
    assert stored("summary") == {"1": "разом", "2": "had"} and sent.value == 1
    jobs.run_step(spark, path, "embeddings", jobs.RULES["embeddings"], reprocess=False)
    assert {i: len(v) for i, v in stored("embedding_sts").items()} == {"1": 1, "2": 768}


@pytest.mark.parametrize("inline_limit", [500, 0])
def test_texts_of_one_key_have_their_own_labels(spark, inline_limit):
    texts = ["добре", "погано погано", "добре", "нічого", None]
    messages = spark.createDataFrame([("s", "1", t) for t in texts],
                                     "source string, message_id string, initial_text string")
    words = spark.createDataFrame([("добре", "позитивна", 1), ("погано", "негативна", 1)],
                                  "word string, value string, weight int")
    done = rules.label_by_lexicon(messages, words, TONALITIES, "нейтральна", "tonality",
                                  inline_limit=inline_limit)
    assert done.columns == [*messages.columns, "tonality"]
    assert sorted((r.initial_text or "", r.tonality) for r in done.collect()) == [
        ("", "нейтральна"), ("добре", "позитивна"), ("добре", "позитивна"),
        ("нічого", "нейтральна"), ("погано погано", "негативна")]
