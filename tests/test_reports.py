import datetime
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsflow.operators import report, search, select, train


def messages(spark):
    rows = [("a", "1", "позитивна", "спорт", ["Київ", "Львів"]), ("a", "2", "позитивна", "освіта", ["Київ"]),
            ("b", "3", "негативна", "спорт", []), ("b", "4", None, None, None)]
    return spark.createDataFrame(rows, "source string, message_id string, tonality string, "
                                       "category string, named_entities array<string>")


def test_distributions(spark):
    assert {tuple(r) for r in report.category_distribution(messages(spark)).collect()} == {
        ("спорт", 2, 2 / 3), ("освіта", 1, 1 / 3)}
    assert {tuple(r) for r in report.tonality_distribution(messages(spark)).collect()} == {
        ("a", "позитивна", 2, 1.0), ("b", "негативна", 1, 1.0)}
    assert {tuple(r) for r in report.tonality_pivot(
        messages(spark), ["позитивна", "негативна"]).collect()} == {("a", 2, 0), ("b", 0, 1)}


def test_top_entities(spark):
    exact = report.top_entities(messages(spark), 5).collect()
    assert [tuple(r) for r in exact] == [("Київ", 2), ("Львів", 1)]
    assert {tuple(r) for r in report.top_entities(messages(spark), 5, approximate=True).collect()} \
        == {tuple(r) for r in exact}


def test_sources(spark):
    rows = [("b",), ("a",), ("b",), ("c",)]
    listed = report.unique_sources(spark.createDataFrame(rows, "source string")).collect()
    assert [r.source for r in listed] == ["b", "a", "c"]


@pytest.mark.parametrize("k", [1, 3, 1000])
def test_similar_topk_matches_brute_force(spark, k):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(700, 8)).astype("float32")
    vectors[5] = vectors[9] = vectors[200]           # ties
    vectors[3] = 0                                   # no direction
    rows = [(f"{i:04d}", vectors[i].tolist()) for i in range(700)] + [("none", None)]
    df = spark.createDataFrame(rows, "message_id string, embedding_sts array<float>").repartition(5)
    queries = [("q1", vectors[200].tolist()), ("q2", rng.normal(size=8).tolist())]
    got = {}
    for r in search.similar_topk(df, queries, k, id_cols=["message_id"]).collect():
        got.setdefault(r["query"], []).append((r["rank"], r.message_id, r.score))
    for name, query in queries:
        q = np.array(query, dtype="float64")
        q /= np.linalg.norm(q)
        norms = np.linalg.norm(vectors.astype("float64"), axis=1)
        scores = vectors.astype("float64") @ q / np.where(norms > 0, norms, 1)
        order = sorted(range(700), key=lambda i: (-round(scores[i], 9), i))[:k]
        mine = sorted(got[name])
        assert [rank for rank, _, _ in mine] == list(range(1, len(order) + 1))
        assert [int(key) for _, key, _ in mine][:3] == order[:3]
        assert np.allclose([score for _, _, score in mine], [scores[i] for i in order])
        assert {int(key) for _, key, _ in mine} == set(order)


def test_many_queries_in_blocks(spark):
    rng = np.random.default_rng(4)
    vectors, asked = rng.normal(size=(300, 6)), rng.normal(size=(90, 6))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)] + [(999, [1.0])],
                               "message_id long, embedding_sts array<double>")
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asked)] + [(900, None)],
                                    "query long, vector array<double>")
    found = search.similar_topk(df, queries, 4, id_cols=["message_id"], query_block=7,
                                message_block=40)
    got = {}
    for r in found.collect():
        got.setdefault(r["query"], {})[r["rank"]] = r.message_id
    scores = (asked / np.linalg.norm(asked, axis=1, keepdims=True)) @ \
        (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).T
    assert {q: [ranks[i] for i in range(1, 5)] for q, ranks in got.items()} == {
        q: np.argsort(-own)[:4].tolist() for q, own in enumerate(scores)}
    assert search.similar_topk(df, queries.limit(0), 4, id_cols=["message_id"]).count() == 0


def test_best_scores_in_groups_keep_ties_in_order():
    rng = np.random.default_rng(5)
    for width, k, values in ((3, 5, 2), (300, 3, 4), (2000, 3, 5), (2000, 7, 100_000)):
        scores = rng.integers(0, values, size=(20, width)).astype("float64")
        row, column = search._best(scores, k)
        assert [column[row == i].tolist() for i in range(20)] == [
            np.argsort(-own, kind="stable")[:k].tolist() for own in scores]


def test_vectors_are_sent_to_few_blocks(spark):
    vectors = spark.range(40_000).select("id", F.array(F.lit(1.0), F.col("id") + 1.0).alias("v"))
    assert search._blocks(vectors, "v", None) ** 2 <= 8 * spark.sparkContext.defaultParallelism + 16
    assert search._blocks(vectors.limit(0), "v", None) == 1


def test_text_search_matches_brute_force(spark):
    texts = ["Київ чекає на матч", "матч матч матч", "сьогодні у місті дощ", "Київ. Київ! дощ",
             "", "довгий текст про матч та ще багато інших слів поспіль"]
    df = spark.createDataFrame([("s", str(i), t) for i, t in enumerate(texts)],
                               "source string, message_id string, initial_text string")
    got = [(r.message_id, r.score) for r in search.text_search(df, ["КИЇВ", "матч"], 10).collect()]
    assert got == [(r.message_id, r.score)
                   for r in search.text_search(df, "Київ, матч?", 10).collect()]
    tokens = [[w for w in re.split(r"\W+", t.lower()) if w] for t in texts]
    average = sum(map(len, tokens)) / len(texts)
    want = {}
    for word in ("київ", "матч"):
        df_ = sum(word in t for t in tokens)
        idf = math.log(1 + (len(texts) - df_ + 0.5) / (df_ + 0.5))
        for i, t in enumerate(tokens):
            tf = t.count(word)
            if tf:
                want[str(i)] = want.get(str(i), 0) + idf * tf / (
                    tf + 1.2 * (0.25 + 0.75 * len(t) / average))
    assert [key for key, _ in got] == sorted(want, key=lambda i: (-want[i], i))
    assert all(abs(score - want[key]) < 1e-9 for key, score in got)


def test_date_filters(spark):
    rows = [(str(i), "s", datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
             + datetime.timedelta(hours=i)) for i in range(0, 96, 8)]
    df = spark.createDataFrame(rows, "message_id string, source string, publish_date timestamp")
    day = datetime.date(2024, 1, 2)
    assert [r.message_id for r in select.by_date_range(df, day, day).collect()] == ["24", "32", "40"]
    now = datetime.datetime(2024, 1, 4, 23, 0)
    assert {r.message_id for r in select.backfill(df, now, 1).collect()} == {
        "48", "56", "64", "72", "80", "88"}
    newest = select.newest_first(df, now, 0).collect()
    assert [r.message_id for r in newest] == ["88", "80", "72"]


def test_unprocessed_and_empty_texts(spark):
    df = spark.createDataFrame(
        [("1", None), ("2", ""), ("3", "є")], "message_id string, cleared_text string") \
        .withColumn("source", F.lit("s")).withColumn("publish_date", F.current_timestamp())
    assert [r.message_id for r in select.unprocessed(df, 1).collect()] == ["1"]
    assert {r.message_id for r in select.unprocessed(df, None).collect()} == {"1", "2"}
    assert select.skip_processed(df, reprocess=True).count() == 3
    feed = spark.createDataFrame([(1, "", ""), (2, None, "m"), (3, "t", "m"), (4, None, None)],
                                 "message_id long, text string, message string")
    assert {(r.message_id, r.message_text) for r in select.non_empty_text(feed).collect()} == {
        (2, "m"), (3, "t")}


def training(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(300):
        label = ("негативна", "нейтральна", "позитивна")[i % 3]
        centre = np.eye(3)[i % 3] * 3
        rows.append((str(i), label, (centre + rng.normal(size=3) * 0.3).tolist()))
    return spark.createDataFrame(rows, "message_id string, tonality string, "
                                       "embedding_clf array<float>")


@pytest.mark.parametrize("linear", [False, True])
def test_classifier_learns(spark, linear):
    learn, check = train.split(training(spark), ["message_id"])
    assert learn.count() + check.count() == 300 and 200 < learn.count() < 280
    model = train.train_classifier(learn, linear=linear)
    judged = train.predict(model, check)
    assert train.accuracy(judged).first().accuracy > 0.95
    matrix = train.confusion_matrix(judged, ["негативна", "нейтральна", "позитивна"])
    counts = {r.tonality: r for r in matrix.collect()}
    assert len(counts) == 3 and counts["позитивна"]["позитивна"] > 10


def test_labels_are_numbered_alphabetically(spark):
    labels = train.label_index(training(spark)).labels
    assert list(labels) == ["негативна", "нейтральна", "позитивна"]
