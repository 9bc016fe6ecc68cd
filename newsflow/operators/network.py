"""A classifier with one ReLU layer, trained in small batches on all executors at once.

Every epoch each task walks through its rows in batches of 32 with Adam, starting from the shared
state; the states are averaged by rows, in two steps, and only the average comes to the driver.
A table of one task is thus trained as a single machine would train it. What is sent around grows
with the model (its size is checked), never with the rows.
"""

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from newsflow.operators.train import BLOCK, EPOCHS, label_index
from newsflow.scratch import temporary

# The optimiser's rate, decays and floor, and epochs without gain before the end.
RATE = 0.001
DECAY, SQUARE_DECAY, FLOOR = 0.9, 0.999, 1e-7
PATIENCE = 3
#: Rows of a training task; up to this many are trained in one place.
ROWS_PER_TASK = 50_000
#: Most values in a network: with Adam's two averages 200 MB are sent to a task.
MODEL_VALUES = 8_000_000
#: Values of a state that are averaged in one row, and tasks that are averaged in the first step.
SLICE, FAN_IN = 16_384, 32

STATE = "part long, slice long, rows long, loss double, hits long, state binary"
CURVE = ("epoch int, loss double, accuracy double, val_loss double, val_accuracy double, "
         "kept boolean")


@dataclass
class Network:
    """A trained network: its class names in order, its layers' widths, weights and curve."""
    classes: list[str]
    width: int
    hidden: int
    weights: np.ndarray
    curve: list[tuple] = field(default_factory=list)

    def curve_table(self, spark: SparkSession) -> DataFrame:
        """A row per epoch; ``kept`` marks the one whose weights the network has."""
        return spark.createDataFrame(self.curve, CURVE)

    def save(self, spark: SparkSession, path: str) -> None:
        """Write the network as a table of one row; the curve goes with it."""
        spark.createDataFrame(
            [(self.classes, self.width, self.hidden, self.weights.tolist(), self.curve)],
            "classes array<string>, width int, hidden int, weights array<double>, "
            f"curve array<struct<{CURVE.replace(' ', ':').replace(',:', ', ')}>>",
        ).coalesce(1).write.mode("overwrite").parquet(path)


def load_network(spark: SparkSession, path: str) -> Network:
    row = spark.read.parquet(path).first()
    return Network(list(row.classes), row.width, row.hidden, np.array(row.weights),
                   [tuple(point) for point in row.curve])


# --- one batch --------------------------------------------------------------------------------

def _layers(values: np.ndarray, width: int, hidden: int, classes: int):
    """The two layers' matrices and offsets as views of one flat vector."""
    first, second = width * hidden, hidden * classes
    return (values[:first].reshape(width, hidden), values[first:first + hidden],
            values[first + hidden:first + hidden + second].reshape(hidden, classes),
            values[first + hidden + second:])


def _initial(width: int, hidden: int, classes: int, seed: int) -> np.ndarray:
    """Uniform within the bound that keeps the variance of both directions; offsets are 0."""
    values = np.zeros(width * hidden + hidden + hidden * classes + classes)
    rng = np.random.default_rng(seed)
    first, _, second, _ = _layers(values, width, hidden, classes)
    for matrix in (first, second):
        bound = np.sqrt(6 / sum(matrix.shape))
        matrix[:] = rng.uniform(-bound, bound, matrix.shape)
    return values


def _forward(values, shape, x):
    """Hidden activations, and log-probabilities of the classes."""
    first, first_off, second, second_off = _layers(values, *shape)
    inner = np.maximum(x @ first + first_off, 0)
    logits = inner @ second + second_off
    logits -= logits.max(axis=1, keepdims=True)
    return inner, logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))


def _gradient(values, shape, x, labels):
    """The mean gradient of a batch as a flat vector, the summed loss and the right answers."""
    inner, logs = _forward(values, shape, x)
    at = np.arange(len(labels))
    loss, hits = -logs[at, labels].sum(), int((logs.argmax(axis=1) == labels).sum())
    wrong = np.exp(logs)
    wrong[at, labels] -= 1
    wrong /= len(labels)
    grad = np.empty_like(values)
    first, first_off, second, second_off = _layers(grad, *shape)
    second[:], second_off[:] = inner.T @ wrong, wrong.sum(axis=0)
    back = (wrong @ _layers(values, *shape)[2].T) * (inner > 0)
    first[:], first_off[:] = x.T @ back, back.sum(axis=0)
    return grad, loss, hits


def _matrix(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    flat = batch.column("vector").flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(-1, width).astype(float), batch.column("label").to_numpy()


# --- one epoch --------------------------------------------------------------------------------

def _epoch(rows: DataFrame, state: np.ndarray, steps: int, shape, batch: int, rate: float,
           seed: int):
    """The averaged state after every task went through its rows once, with the epoch's figures.

    A task that is run again goes through the same rows in the same order.
    """
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        rng = np.random.default_rng((seed, steps, part))
        values, mean, square = state.copy()
        at, seen, loss, hits = steps, 0, 0.0, 0
        left_x, left_labels = np.empty((0, shape[0])), np.empty(0, dtype=int)

        def learn(x, labels):
            nonlocal at, seen, loss, hits
            grad, lost, right = _gradient(values, shape, x, labels)
            at, seen, loss, hits = at + 1, seen + len(labels), loss + lost, hits + right
            mean[:] = DECAY * mean + (1 - DECAY) * grad
            square[:] = SQUARE_DECAY * square + (1 - SQUARE_DECAY) * grad * grad
            values[:] -= rate * (mean / (1 - DECAY ** at)) / (
                np.sqrt(square / (1 - SQUARE_DECAY ** at)) + FLOOR)

        for arrow in batches:
            x, labels = _matrix(arrow, shape[0])
            order = rng.permutation(len(labels))
            x, labels = np.concatenate([left_x, x[order]]), np.concatenate(
                [left_labels, labels[order]])
            whole = len(labels) // batch * batch
            for start in range(0, whole, batch):
                learn(x[start:start + batch], labels[start:start + batch])
            left_x, left_labels = x[whole:], labels[whole:]
        if len(left_labels):
            learn(left_x, left_labels)
        if seen:
            flat = np.concatenate([values, mean, square])
            pieces = [flat[i:i + SLICE].tobytes() for i in range(0, len(flat), SLICE)]
            yield pa.RecordBatch.from_pylist([
                {"part": part, "slice": n, "rows": seen, "loss": loss, "hits": hits,
                 "state": piece} for n, piece in enumerate(pieces)])

    def average(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("part")
        total = int(frame["rows"].sum())
        mixed = sum(np.frombuffer(state) * (rows / total)
                    for state, rows in zip(frame["state"], frame["rows"]))
        return pd.DataFrame([{"part": frame["part"].iloc[0], "slice": frame["slice"].iloc[0],
                              "rows": total, "loss": frame["loss"].sum(),
                              "hits": int(frame["hits"].sum()), "state": mixed.tobytes()}])

    walked = rows.mapInArrow(walk, STATE)
    some = walked.groupBy("slice", (F.col("part") / FAN_IN).cast("long").alias("some")) \
        .applyInPandas(average, STATE)
    got = some.groupBy("slice").applyInPandas(average, STATE).collect()  # one state in slices
    got.sort(key=lambda row: row["slice"])
    mixed = np.frombuffer(b"".join(row["state"] for row in got)).reshape(3, -1)
    return mixed, got[0]["rows"], got[0]["loss"], got[0]["hits"]


def _judge(rows: DataFrame, values: np.ndarray, shape) -> tuple[float, float]:
    """Mean loss and accuracy over all rows; 0 and 0 where there are none."""
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for arrow in batches:
            x, labels = _matrix(arrow, shape[0])
            logs = _forward(values, shape, x)[1]
            lost = -logs[np.arange(len(labels)), labels].sum()
            yield pa.RecordBatch.from_pylist([{
                "rows": len(labels), "loss": float(lost),
                "hits": int((logs.argmax(axis=1) == labels).sum())}])

    total = rows.mapInArrow(sums, "rows long, loss double, hits long") \
        .agg(F.sum("rows").alias("n"), F.sum("loss").alias("loss"), F.sum("hits").alias("hits")) \
        .first()
    return (total.loss / total.n, total.hits / total.n) if total.n else (0.0, 0.0)


# --- training ---------------------------------------------------------------------------------

def train_network(training: DataFrame, validation: DataFrame | None = None,
                  label_col: str = "tonality", vector_col: str = "embedding_clf",
                  hidden: int | None = None, epochs: int = EPOCHS, batch: int = BLOCK,
                  rate: float = RATE, patience: int = PATIENCE, watch: str = "accuracy",
                  seed: int = 42, rows_per_task: int = ROWS_PER_TASK) -> Network:
    """Fit dense(ReLU) and dense(classes) by cross-entropy; ends early without gain.

    Training ends after ``patience`` epochs in which ``watch`` did not rise: the ``accuracy`` over
    the training rows as they went by, or with ``val_accuracy`` the one on ``validation``. The best
    epoch's weights are kept, of equals the one with the smaller loss. ``validation`` rows are
    judged after every epoch in any case. Rows without a label or vector take no part, nor do
    validation rows of a class that training lacks. All vectors have the width of the first;
    another width, a missing or non-finite component, or no training row at all raises. The
    network may have ``MODEL_VALUES`` values. Rows are dealt to tasks by a hash of the vector.
    """
    if watch not in ("accuracy", "val_accuracy") or (watch != "accuracy" and validation is None):
        raise ValueError(f"cannot watch {watch!r}: accuracy, or val_accuracy of validation rows")
    usable = training.filter(F.col(label_col).isNotNull() & F.col(vector_col).isNotNull())
    head = usable.select(F.size(vector_col).alias("width")).first()
    if head is None:
        raise ValueError("no row has a label and a vector")
    width, classes = head.width, list(label_index(usable, label_col).labels)
    shape = (width, hidden or width, len(classes))
    values = _initial(*shape, seed)
    if len(values) > MODEL_VALUES:
        raise ValueError(f"{len(values)} values in the network, {MODEL_VALUES} are the most: "
                         "choose a smaller hidden layer")

    def prepared(df: DataFrame) -> DataFrame:
        known = df.filter(F.col(vector_col).isNotNull() & F.col(label_col).isin(classes))
        vector = F.col(vector_col).cast("array<float>")
        # a null component makes the check null, which is no true either
        sound = (F.size(vector) == width) & F.forall(
            vector, lambda v: v.isNotNull() & (F.abs(v) < float("inf")) & ~F.isnan(v))
        return known.select(
            (F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(label_col)) - 1)
            .cast("int").alias("label"),
            F.when(sound, vector).otherwise(F.raise_error(F.lit(
                f"a vector is not {width} finite numbers"))).alias("vector"))

    spark = training.sparkSession
    with temporary(spark) as keep:
        tasks = max(1, -(-usable.count() // rows_per_task))
        mixed = F.xxhash64("vector", F.lit(seed))
        # one file a task, so epochs read what one task wrote and no more
        rows = keep(prepared(usable).repartition(tasks, mixed)
                    .sortWithinPartitions(mixed, "label"), "training")
        checks = keep(prepared(validation), "validation") if validation is not None else None
        state, steps, curve = np.stack([values, 0 * values, 0 * values]), 0, []
        best, best_weights, idle = None, values, 0
        for epoch in range(1, epochs + 1):
            state, seen, loss, hits = _epoch(rows.coalesce(tasks), state, steps, shape, batch,
                                             rate, seed)
            steps += -(-seen // (batch * tasks))
            val_loss, val_right = _judge(checks, state[0], shape) if checks is not None \
                else (None, None)
            curve.append((epoch, loss / seen, hits / seen, val_loss, val_right))
            told = (hits / seen, -loss / seen) if watch == "accuracy" else (val_right, -val_loss)
            idle = 0 if best is None or told[0] > best[0] else idle + 1
            if best is None or told > best:
                best, best_weights, kept = told, state[0].copy(), epoch
            if idle >= patience:
                break
    return Network(classes, *shape[:2], best_weights,
                   [(*point, point[0] == kept) for point in curve])


def predict_by_network(network: Network, messages: DataFrame,
                       vector_col: str = "embedding_clf") -> DataFrame:
    """Adds ``predicted`` and ``probability``; both null without a vector of the network's width."""
    shape = (network.width, network.hidden, len(network.classes))
    values, classes = network.weights, np.array(network.classes, dtype=object)

    @F.pandas_udf(T.StructType([T.StructField("predicted", T.StringType()),
                                T.StructField("probability", T.DoubleType())]))
    def label(vectors: pd.Series) -> pd.DataFrame:
        done = pd.DataFrame({"predicted": pd.Series(None, index=vectors.index, dtype=object),
                             "probability": pd.Series(np.nan, index=vectors.index)})
        fits = vectors.map(lambda v: v is not None and len(v) == shape[0])
        if fits.any():
            logs = _forward(values, shape, np.stack(vectors[fits]).astype(float))[1]
            done.loc[fits, "predicted"] = classes[logs.argmax(axis=1)]
            done.loc[fits, "probability"] = np.exp(logs.max(axis=1))
        return done

    judged = messages.withColumn("_judged", label(F.col(vector_col)))
    return judged.select(*messages.columns, "_judged.predicted", F.when(
        F.col("_judged.predicted").isNotNull(), F.col("_judged.probability")).alias("probability"))
