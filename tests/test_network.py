"""Mini-batch training on one task and on several."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsflow.operators import network, train

CLASSES = ["негативна", "нейтральна", "позитивна"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(3, 8))
    made = [(str(i), CLASSES[i % 3], (centres[i % 3] + rng.normal(size=8) * 0.3).tolist())
            for i in range(900)]
    return spark.createDataFrame(
        made, "message_id string, tonality string, embedding_clf array<float>")


def test_gradient_equals_differences():
    rng = np.random.default_rng(0)
    shape = (4, 5, 3)
    values = network._initial(*shape, seed=1) + rng.normal(size=4 * 5 + 5 + 5 * 3 + 3) * 0.1
    x, labels = rng.normal(size=(7, 4)), rng.integers(0, 3, 7)
    grad = network._gradient(values, shape, x, labels)[0]
    for k in range(len(values)):
        step = np.zeros_like(values)
        step[k] = 1e-6
        up, down = (network._gradient(values + s, shape, x, labels)[1] / 7 for s in (step, -step))
        assert abs(grad[k] - (up - down) / 2e-6) < 1e-6


@pytest.mark.parametrize("rows_per_task", [10_000, 40])
def test_learns_in_one_place_and_in_many(spark, rows, rows_per_task):
    learn, check = train.split(rows, ["message_id"])
    found = network.train_network(learn, check, hidden=16, rate=0.01, rows_per_task=rows_per_task)
    curve = found.curve_table(spark).orderBy("epoch").collect()
    assert curve[-1].loss < curve[0].loss and sum(point.kept for point in curve) == 1
    judged = network.predict_by_network(found, check)
    assert train.accuracy(judged).first().accuracy > 0.95
    assert judged.filter(~F.col("predicted").isin(CLASSES)).isEmpty()


def test_one_task_trains_as_a_plain_loop(spark, rows):
    found = network.train_network(rows, hidden=6, epochs=1, batch=900)
    x = np.array([r.embedding_clf for r in rows.collect()])
    labels = np.array([CLASSES.index(r.tonality) for r in rows.collect()])
    values, shape = network._initial(8, 6, 3, 42), (8, 6, 3)
    grad = network._gradient(values, shape, x, labels)[0]
    want = values - network.RATE * grad / (np.abs(grad) + network.FLOOR)  # Adam's first step
    assert np.allclose(found.weights, want, atol=1e-6)


def test_same_rows_give_the_same_network(rows):
    first, second = (network.train_network(rows.repartition(n), hidden=4, epochs=2)
                     for n in (2, 7))
    assert np.allclose(first.weights, second.weights)


def test_ends_without_gain(spark, rows):
    noise = rows.withColumn("tonality", F.when(F.xxhash64("message_id") % 2 == 0, "a").otherwise("b"))
    found = network.train_network(noise, noise, hidden=2, rate=1e-9, patience=2,
                                  watch="val_accuracy")
    assert [point[0] for point in found.curve] == [1, 2, 3]


def test_network_is_kept_in_a_table(spark, rows, tmp_path):
    found = network.train_network(rows, rows, hidden=4, epochs=2)
    found.save(spark, str(tmp_path / "net"))
    loaded = network.load_network(spark, str(tmp_path / "net"))
    assert loaded.classes == CLASSES and np.array_equal(loaded.weights, found.weights)
    assert loaded.curve_table(spark).collect() == found.curve_table(spark).collect()


def test_rows_that_take_no_part(spark, rows):
    odd = spark.createDataFrame([("x", None, [1.0] * 8), ("y", "нейтральна", None)], rows.schema)
    plain = network.train_network(rows, hidden=4, epochs=1)
    assert np.allclose(network.train_network(rows.unionByName(odd), hidden=4, epochs=1).weights,
                       plain.weights)
    other = spark.createDataFrame([("z", "інша", [1.0] * 8)], rows.schema)
    assert network.train_network(rows, other, hidden=4, epochs=1).curve[0][3:5] == (0.0, 0.0)
    judged = network.predict_by_network(plain, odd.unionByName(
        spark.createDataFrame([("s", "нейтральна", [1.0])], rows.schema)))
    assert {r.message_id: r.predicted is None for r in judged.collect()} == {
        "x": False, "y": True, "s": True}


def test_bad_input_is_named(spark, rows):
    for vector in ([1.0] * 7, [float("nan")] * 8, [None] * 8):
        bad = rows.unionByName(spark.createDataFrame([("b", "нейтральна", vector)], rows.schema))
        with pytest.raises(Exception, match="finite numbers"):
            network.train_network(bad, hidden=2, epochs=1)
    with pytest.raises(ValueError, match="no row"):
        network.train_network(rows.limit(0))
    with pytest.raises(ValueError, match="smaller hidden"):
        network.train_network(rows, hidden=10_000_000)
    with pytest.raises(ValueError, match="cannot watch"):
        network.train_network(rows, watch="val_accuracy")
