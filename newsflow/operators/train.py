"""Training and judging a tonality classifier on message vectors."""

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import IndexToString, StringIndexer, StringIndexerModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, functions as F

# Passes over the data, rows per step and the training share.
EPOCHS = 20
BLOCK = 32
TRAINING_TENTHS = 8


def label_index(df: DataFrame, label_col: str = "tonality") -> StringIndexerModel:
    """Numbers for the class names, in alphabetical order; adds ``label`` on transform.

    A class that was not seen, or none, gets the number after the last.
    """
    return StringIndexer(inputCol=label_col, outputCol="label",
                         stringOrderType="alphabetAsc", handleInvalid="keep").fit(df)


def in_training(*key: Column, tenths: int = TRAINING_TENTHS) -> Column:
    """True for a fixed share of keys, chosen by hash: the same rows in every run."""
    digest = F.md5(F.concat_ws("|", *[k.cast("string") for k in key]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % 10 < tenths


def split(df: DataFrame, key_cols) -> tuple[DataFrame, DataFrame]:
    """Training and validation rows."""
    chosen = in_training(*[F.col(c) for c in key_cols])
    return df.filter(chosen), df.filter(~chosen)


def train_classifier(training: DataFrame, label_col: str = "tonality",
                     vector_col: str = "embedding_clf", hidden: int | None = None,
                     epochs: int = EPOCHS, linear: bool = False, seed: int = 42) -> PipelineModel:
    """Fit a network with one hidden layer as wide as the vector, or a linear model.

    The vector's width and the number of classes are the only values read back.
    """
    usable = training.filter(F.col(label_col).isNotNull() & F.col(vector_col).isNotNull())
    indexer = label_index(usable, label_col)
    rows = indexer.transform(usable).select(
        "label", array_to_vector(vector_col).alias("features"))
    width = usable.select(F.size(vector_col)).first()[0]
    classes = len(indexer.labels)
    if linear:
        learner = LogisticRegression(maxIter=epochs, probabilityCol="", rawPredictionCol="raw")
    else:
        learner = MultilayerPerceptronClassifier(
            layers=[width, hidden or width, classes], maxIter=epochs, blockSize=BLOCK, seed=seed)
    names = IndexToString(inputCol="prediction", outputCol="predicted", labels=indexer.labels)
    return PipelineModel(stages=[learner.fit(rows), names])


def predict(model: PipelineModel, messages: DataFrame,
            vector_col: str = "embedding_clf") -> DataFrame:
    """Adds ``predicted``, the most likely class name."""
    with_vector = messages.filter(F.col(vector_col).isNotNull()) \
        .withColumn("features", array_to_vector(vector_col))
    return model.transform(with_vector).select(*messages.columns, "predicted")


def confusion_matrix(predictions: DataFrame, classes, label_col: str = "tonality",
                     predicted_col: str = "predicted") -> DataFrame:
    """One row per true class, one column per predicted class."""
    return (predictions.groupBy(label_col).pivot(predicted_col, list(classes))
            .agg(F.count(F.lit(1))).fillna(0))


def accuracy(predictions: DataFrame, label_col: str = "tonality",
             predicted_col: str = "predicted") -> DataFrame:
    """The share of correct predictions."""
    right = (F.col(label_col) == F.col(predicted_col)).cast("int")
    return predictions.agg(F.count(F.lit(1)).alias("messages"), F.avg(right).alias("accuracy"))
