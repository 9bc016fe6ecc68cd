import datetime
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from newsflow.operators import batches, scoring
from newsflow.plans import enrich
from newsflow.schema import KEY

# the workers cannot import this file, so its functions travel whole
cloudpickle.register_pickle_by_value(sys.modules[__name__])
START = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)


def make(spark, counts, same_time=False):
    rows = [(source, f"{i:05d}", START if same_time else START + datetime.timedelta(minutes=i * 7919 % 977),
             f"text {source} {i}") for source, count in counts.items() for i in range(count)]
    return spark.createDataFrame(
        rows, "source string, message_id string, publish_date timestamp, initial_text string")


def expected_places(messages, size):
    by_source = {}
    for r in messages.collect():
        by_source.setdefault(r.source, []).append((r.publish_date, r.message_id))
    return {(source, key): (i // size, i % size + 1) for source, rows in by_source.items()
            for i, (_, key) in enumerate(sorted(rows))}


@pytest.mark.parametrize("same_time", [False, True])
def test_chunk_matches_brute_force_with_a_hot_source(spark, same_time):
    messages = make(spark, {"hot": 5000, "a": 14, "b": 1, None: 9, "c": 6}, same_time)
    got = {(r.source, r.message_id): (r.batch_id, r.n)
           for r in batches.chunk(messages, 6).collect()}
    assert got == expected_places(messages, 6)


def test_chunk_sizes(spark):
    sizes = (batches.chunk(make(spark, {"s": 14})).groupBy("batch_id").count()
             .orderBy("batch_id").collect())
    assert [r["count"] for r in sizes] == [6, 6, 2]
    with pytest.raises(ValueError):
        batches.chunk(make(spark, {"s": 1}), 100)


def test_batch_texts(spark):
    request = batches.batch_texts(batches.chunk(make(spark, {"s": 2}, True))).first()
    assert request.texts == 2
    assert request.request == "Текст #1: text s 0\n\nТекст #2: text s 1\n"
    prompted = batches.to_prompt(
        batches.batch_texts(batches.chunk(make(spark, {"s": 2}, True))), "{count} тексти:\n{texts}")
    assert prompted.first().request.startswith("2 тексти:\nТекст #1: text s 0\n")


def numbers(request):
    return [int(part.split(":")[0]) for part in request.split("Текст #")[1:]]


def misbehaving(requests, setup):
    """Answers in reverse with a preamble, drops number 2, fails or raises for some sources."""
    assert setup["temperature"] == 0.8
    replies = []
    for request in requests:
        if "text bad" in request:
            raise RuntimeError("no connection")
        if "text sorry" in request:
            replies.append("Sorry, no answer was found.")
            continue
        lines = [line for line in request.splitlines() if line.startswith("Текст #")]
        replies.append("  \n Відповідь:\n" + "\n".join(
            line.replace(": text", ": про", 1) for line in reversed(lines)
            if not line.startswith("Текст #2")))
    return replies


def test_answers_find_their_messages(spark):
    messages = make(spark, {"good": 14, "bad": 7, "sorry": 3, "other": 2})
    chunked = batches.chunk(messages, 6)
    requests = batches.batch_texts(chunked)
    rows = enrich.model_step(chunked, requests, "summary", misbehaving, tasks=3).collect()
    assert len(rows) == 26
    places = expected_places(messages, 6)
    for r in rows:
        n = places[(r.source, r.message_id)][1]
        if r.source == "bad":
            assert r.summary is None and "no connection" in r.summary_error
        elif r.source == "sorry":
            assert r.summary is None and r.summary_error == "Sorry, no answer was found."
        elif n == 2:
            assert r.summary is None and r.summary_error == "not answered"
        else:
            assert r.summary == f"про {r.source} {int(r.message_id)}" and r.summary_error is None


def test_unknown_labels_are_refused(spark):
    chunked = batches.chunk(make(spark, {"s": 3}, True), 6)

    def answer(requests, setup):
        return ["Текст #1: Негативна\nТекст #2: дивна\nТекст 3: об'єктивна" for _ in requests]

    rows = enrich.model_step(chunked, batches.batch_texts(chunked), "tonality", answer) \
        .orderBy("message_id").collect()
    assert [r.tonality for r in rows] == ["негативна", None, "об'єктивна"]
    assert [r.tonality_error for r in rows] == [None, "unknown value: дивна", None]


def test_wrong_number_of_answers_fails_that_call_only(spark):
    requests = spark.createDataFrame([("s", i, f"r{i}") for i in range(4)],
                                     "source string, batch_id long, request string").coalesce(1)

    def answer(asked, _):
        return asked if "r0" in asked else asked[:-1]

    rows = scoring.score_batches(requests, answer, tasks=1, call_size=2).collect()
    with_r0 = [r for r in rows if r.error is None]
    assert len(with_r0) == 2 and "r0" in {r.answer for r in with_r0}
    assert {r.answer for r in rows if r.error} == {None}
    assert {r.error for r in rows if r.error} == {"ValueError: 2 requests but 1 answers"}


def test_pacing(spark):
    import time
    requests = spark.createDataFrame([("s", i, "r") for i in range(4)],
                                     "source string, batch_id long, request string")
    start = time.time()
    scoring.score_batches(requests, lambda asked, _: asked, tasks=1,
                          requests_per_minute=120).collect()
    assert time.time() - start >= 1.5


def test_enrich_by_model_runs_every_step(spark):
    messages = make(spark, {"a": 8, None: 3})

    def single(word):
        return lambda requests, _: ["\n".join(f"Текст #{n}: {word}" for n in numbers(r))
                                    for r in requests]

    def clean_ner(requests, setup):
        assert setup["top_k"] == 40
        return ["".join(f"|||Текст #{n}\nДія 1: новина\nДія 2: Київ; UA\n\n" for n in numbers(r))
                for r in requests]

    def embed(texts, kind):
        assert set(texts) == {"новина"}
        return [[1.0, 0.0] if kind == "similarity" else [0.0, 1.0]] * len(texts)

    done = enrich.enrich_by_model(messages, {
        "tonality": single("Позитивна"), "category": single("Спорт"), "summary": single("Так"),
        "clean_ner": clean_ner, "embeddings": embed}, tasks=2)
    rows = done.collect()
    assert len(rows) == 11
    for r in rows:
        assert (r.tonality, r.category, r.summary) == ("позитивна", "спорт", "так")
        assert (r.cleared_text, r.named_entities) == ("новина", ["Київ"])
        assert (r.embedding_sts, r.embedding_clf) == ([1.0, 0.0], [0.0, 1.0])
        assert not [v for k, v in r.asDict().items() if k.endswith("_error") and v]
    assert set(KEY) <= set(done.columns)


def test_failed_embeddings_leave_nulls(spark):
    messages = make(spark, {"a": 65}).withColumn("cleared_text", F.col("initial_text"))

    def embed(texts, kind):
        if kind == "classification" and any(t.endswith(" 7") for t in texts):
            raise RuntimeError("down")
        return [[float(len(t))] for t in texts]

    rows = scoring.embed_texts(messages.coalesce(1), embed, tasks=1).collect()
    assert len(rows) == 65
    failed = [r for r in rows if r.error]
    assert len(failed) == 30 and all(r.embedding_sts is None for r in failed)
    assert all(r.embedding_sts == [float(len(f"text a {int(r.message_id)}"))]
               for r in rows if not r.error)


def test_setup_comparison(spark):
    messages = make(spark, {"a": 3})
    setups = [{"setup": "x", "temperature": 0.1}, {"setup": "y", "temperature": 0.9}]
    rows = enrich.setup_comparison(
        messages, lambda asked, setup: [f"{setup['setup']}:{a}" for a in asked], setups).collect()
    assert {(r.message_id, r.x, r.y) for r in rows} == {
        (f"{i:05d}", f"x:text a {i}", f"y:text a {i}") for i in range(3)}


def test_text_steps_are_aligned_by_batch_alone(spark, monkeypatch):
    joined = []

    def noted(left, right, key_cols=enrich.KEY, how="inner", join=enrich.join_on_key):
        joined.append(how)
        return join(left, right, key_cols, how)

    monkeypatch.setattr(enrich, "join_on_key", noted)
    messages = spark.createDataFrame([("s", f"m{i}", i, f"text {i}") for i in range(9)],
                                     "source string, message_id string, publish_date long, "
                                     "initial_text string")
    done = enrich.enrich_by_model(messages, {
        "summary": lambda requests, _: ["Текст #1: one" for _ in requests],
        "category": lambda requests, _: ["Текст #2: спорт" for _ in requests]}, tasks=2)
    assert "left" not in joined
    assert {(r.message_id, r.summary, r.category, r.summary_error) for r in done.collect()} == {
        (f"m{i}", "one" if i in (0, 6) else None, "спорт" if i in (1, 7) else None,
         None if i in (0, 6) else "not answered") for i in range(9)}
